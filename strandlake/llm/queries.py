"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, linededup, packing, pii, tokens, topk, toxicity
from .common import table

QUERIES, ORACLE_SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


#: Symbols are pairs of hexadecimal digits, and END for the mark of a word's end.
ORACLE_SQL["op5_token_counts"] = r"""
WITH RECURSIVE byte AS (
  SELECT b, CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 THEN b
    ELSE 255 + row_number() OVER (PARTITION BY b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 ORDER BY b) END AS letter
  FROM (SELECT CAST(unnest(range(256)) AS INTEGER) AS b)),
letters AS (SELECT map(list(chr(CAST(letter AS INTEGER))), list(printf('%02X', b))) AS m FROM byte),
entry AS (SELECT unnest(json_keys(content, '$.model.vocab')) AS token FROM read_text('PATH')),
e AS (
  SELECT DISTINCT array_to_string(list_transform(string_split(regexp_replace(token, '</w>$', ''), ''), lambda c: m[c]), '')
    || CASE WHEN token LIKE '%</w>' THEN 'END' ELSE '' END AS symbols FROM entry, letters WHERE token <> '</w>'),
longest AS (SELECT max(length(symbols)) // 2 AS n FROM e),
d AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')) AS word FROM documents),
g AS (
  SELECT word, hex(encode(word)) || 'END' AS rest, 0 AS n FROM (SELECT DISTINCT word FROM d)
  UNION ALL
  SELECT word, substr(rest, max(length(symbols)) + 1), n + 1
  FROM (SELECT word, rest, n, left(rest, 2 * k) AS head FROM g, (SELECT unnest(range(1, n + 1)) AS k FROM longest) WHERE rest NOT IN ('', 'END') AND 2 * k <= length(rest) - 3
    UNION ALL SELECT word, rest, n, rest FROM g WHERE rest NOT IN ('', 'END')) h JOIN e ON e.symbols = head
  GROUP BY word, rest, n),
w AS (SELECT word, max(n) FILTER (WHERE rest IN ('', 'END')) AS n FROM g GROUP BY word),
s AS (SELECT doc_id, count(*) AS n_words, sum(coalesce(n, 1)) AS n_tokens, count(*) FILTER (WHERE n IS NULL) AS n_unknown FROM d JOIN w USING (word) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(n_unknown, 0) AS BIGINT) AS n_unknown
FROM documents LEFT JOIN s USING (doc_id)""".replace("PATH", tokens.default_vocabulary())


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(talks.unionByName(extra))


ORACLE_SQL["op6_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(text)
    + 2 * length(role || text) - length(replace(replace(role || text, chr(92), ''), '<', '')) - length(role || text)
    + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, ''
    ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM c GROUP BY conv_id"""


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL["op2_line_dedup"] = """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM parts),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, often.key IS NOT NULL AND k.doc_id <> often.keeper AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE_SQL["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
ORACLE_SQL["op1_decontamination"] = f"""
WITH i AS (
  SELECT item_id, w, least(len(w), 5) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
s AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS shingle FROM i),
z AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - l.n + 2), lambda k: array_to_string(w[k:k + l.n - 1], ' '))) AS shingle
  FROM d, (SELECT DISTINCT n FROM i) l)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(any_value(n_item) AS BIGINT) AS n_item
FROM t JOIN s USING (shingle) JOIN z USING (item_id) GROUP BY doc_id, item_id
HAVING 5 * count(*) >= 4 * any_value(n_item)"""


ORACLE_SQL["op8_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.node = doc_id"""


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), 3, 90, 100)
