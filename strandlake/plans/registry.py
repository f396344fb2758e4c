"""Registered queries by name, and the SQL that gives the same rows.

Prose becomes sequences by ``derived_dna``; DNA in the SQL below is the same rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import alignment_fields as af
from strandlake.functions import composition, distance, matching, quality
from strandlake.functions.alphabet import (
    ALPHABETS,
    amino_acid_code,
    derived_dna,
    nucleotide_code,
    nucleotide_complement,
    nucleotide_letter,
    three_letter,
)
from strandlake.functions.columns import small_batches
from strandlake.functions.ranks import BitEncoding, RankTransform
from strandlake.functions.ranks import qgram_counts as count_qgrams
from strandlake.operators import align, fulltext, length_stats as ls, matrices, orf
from strandlake.operators.stored import fresh
from strandlake.sources import bam, fastx, sam

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", derived_dna(F.col("text")).alias("s"))


AZ = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DNA = f"translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{AZ}', '{'ACGT' * 13}')"
DOCS = f"WITH d AS (SELECT doc_id, {DNA} AS s FROM documents)"
#: Benchmark items as texts with an end mark.
SHORT = f"WITH b AS (SELECT item_id, {DNA} || '$' AS t FROM benchmark)"


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(derived_dna(F.col("text")), F.lit("$")).alias("t"))


# --- aggregates


@query(
    f"""{DOCS},
l AS (SELECT length(s) AS n FROM d),
b AS (SELECT n, count(*) AS c FROM l GROUP BY n),
w AS (SELECT n, c, sum(n * c) OVER (ORDER BY n DESC) AS cum, row_number() OVER (ORDER BY n DESC) AS k, sum(n * c) OVER () AS tot FROM b),
r AS (SELECT n, row_number() OVER (ORDER BY n) AS rn, count(*) OVER () AS m FROM l),
q AS (SELECT n, rn, m, (m + 1) // 2 AS h FROM r)
SELECT CAST(any_value(m) AS BIGINT) AS count, CAST(sum(n) AS BIGINT) AS sum, CAST(min(n) AS BIGINT) AS min, CAST(max(n) AS BIGINT) AS max,
  CAST(sum(n) AS DOUBLE) / any_value(m) AS mean,
  avg(CASE WHEN rn IN ((h + 1) // 2, (h + 2) // 2) THEN n END) AS q1,
  avg(CASE WHEN rn IN ((m + 1) // 2, (m + 2) // 2) THEN n END) AS q2,
  avg(CASE WHEN rn IN (m // 2 + (h + 1) // 2, m // 2 + (h + 2) // 2) THEN n END) AS q3,
  (SELECT CAST(max(n) AS BIGINT) FROM w WHERE cum >= tot * 0.5) AS n50,
  (SELECT CAST(min(k) AS BIGINT) FROM w WHERE cum >= tot * 0.5) AS l50,
  (SELECT CAST(max(n) AS BIGINT) FROM w WHERE cum >= tot * 0.9) AS n90
FROM q"""
)
def length_stats(spark, sf_dir):
    return ls.length_stats(dna_of(spark, sf_dir), F.length("s"))


@query(
    """WITH l AS (SELECT source, length(text) AS n FROM documents WHERE text IS NOT NULL),
b AS (SELECT source, n, count(*) AS c FROM l GROUP BY ALL),
w AS (SELECT *, sum(n * c) OVER (PARTITION BY source ORDER BY n DESC) AS cum, sum(n * c) OVER (PARTITION BY source) AS tot FROM b)
SELECT source, CAST(sum(c) AS BIGINT) AS count, CAST(max(CASE WHEN cum >= tot * 0.5 THEN n END) AS BIGINT) AS n50,
  CAST(max(CASE WHEN cum >= tot * 0.75 THEN n END) AS BIGINT) AS n75 FROM w GROUP BY source"""
)
def length_stats_by_source(spark, sf_dir):
    return ls.length_stats(table(spark, sf_dir, "documents"), F.length("text"), ["source"], (75,)).select("source", "count", "n50", "n75")


@query(
    f"""{DOCS}, b AS (SELECT CAST(length(s) AS BIGINT) AS length, count(*) AS n FROM d GROUP BY 1)
SELECT length, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY length) AS BIGINT) AS seen FROM b"""
)
def length_bins(spark, sf_dir):
    return ls.length_bins(dna_of(spark, sf_dir), F.length("s"))


@query(
    f"""{DOCS}, g AS (SELECT *, regexp_replace(s, '(.).?.?', '\\1', 'g') AS third FROM d)
SELECT doc_id, CAST(length(s) - length(translate(s, 'AT', '')) AS BIGINT) AS n_at, CAST(length(s) - length(translate(s, 'GC', '')) AS BIGINT) AS n_gc,
  CASE WHEN length(s) = 0 THEN 'NaN'::FLOAT ELSE CAST((length(s) - length(translate(s, 'GC', ''))) / length(s) AS FLOAT) END AS gc,
  CASE WHEN length(s) = 0 THEN 'NaN'::FLOAT ELSE CAST((length(third) - length(translate(third, 'GC', ''))) / length(third) AS FLOAT) END AS gc3 FROM g"""
)
def base_composition(spark, sf_dir):
    s = F.col("s")
    return dna_of(spark, sf_dir).select(
        "doc_id",
        composition.count_any(s, "AATT").cast("long").alias("n_at"),
        composition.gc_count(s).cast("long").alias("n_gc"),
        composition.gc_content(s).alias("gc"),
        composition.gc3_content(s).alias("gc3"),
    )


# --- alphabets


@query(
    f"""{DOCS}
SELECT doc_id, md5(translate(s, 'ACGT', 'TGCA')) AS complement, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS revcomp,
  md5(reverse(translate(text, 'acgtrykmswbdhvnxACGTRYKMSWBDHVNX-', 'tgcayrmkswvhdbnxTGCAYRMKSWVHDBNX-'))) AS iupac FROM d JOIN documents USING (doc_id)"""
)
def reverse_complement(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("s", derived_dna(F.col("text")))
    dna, wide = ALPHABETS["dna"], ALPHABETS["dna_redundant"]
    return docs.select(
        "doc_id",
        F.md5(dna.complement(F.col("s"))).alias("complement"),
        F.md5(dna.reverse_complement(F.col("s"))).alias("revcomp"),
        F.md5(wide.reverse_complement(F.col("text"))).alias("iupac"),
    )


@query(
    """SELECT doc_id, CAST(nullif(length(regexp_extract(text, '^[acgtACGT]*')), length(text)) AS INTEGER) AS dna,
  CAST(nullif(length(regexp_extract(text, '^[acgurykmswbdhvnACGURYKMSWBDHVN-]*')), length(text)) AS INTEGER) AS rna_redundant,
  CAST(nullif(length(regexp_extract(text, '^[a-np-tv-zA-NP-TV-Z*-]*')), length(text)) AS INTEGER) AS protein FROM documents"""
)
def first_invalid_letter(spark, sf_dir):
    kinds = ("dna", "rna_redundant", "protein")
    return table(spark, sf_dir, "documents").select("doc_id", *(ALPHABETS[k].first_invalid(F.col("text")).cast("int").alias(k) for k in kinds))


@query(
    """WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents),
n AS (SELECT c, upper(translate(c, 'uU', 'TT')) AS u FROM c WHERE c BETWEEN ' ' AND '~'),
t AS (SELECT c, CAST(nullif(instr('=ACMGRSVTWYHKDBN', u), 0) - 1 AS INTEGER) AS code, CAST(nullif(instr('ARNDCQEGHILKMFPSTWYVUOBZJX*-', upper(c)), 0) - 1 AS INTEGER) AS amino FROM n)
SELECT c, code, CAST(CASE WHEN code IS NOT NULL THEN instr('=ACMGRSVTWYHKDBN', substr('=TGKCYSBAWRDMHVN', code + 1, 1)) - 1 END AS INTEGER) AS pair,
  substr('=ACMGRSVTWYHKDBN', code + 1, 1) AS letter, amino,
  (string_split('Ala Arg Asn Asp Cys Gln Glu Gly His Ile Leu Lys Met Phe Pro Ser Thr Trp Tyr Val Sec Pyl Asx Glx Xle Xaa Ter Gap', ' '))[amino + 1] AS three,
  CAST(nullif(instr('-abcdefghijklmnpqrstvwxyz*', lower(c)), 0) - 1 AS INTEGER) AS protein,
  CASE WHEN instr('acgtnxACGTNX-', c) > 0 THEN translate(c, 'acgtnxACGTNX-', 'tgcanxTGCANX-') END AS complement FROM t"""
)
def letter_codes(spark, sf_dir):
    c = F.col("c")
    letters = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).distinct().where("c between ' ' and '~'")
    code = nucleotide_code(c)
    return letters.select(
        "c",
        code.cast("int").alias("code"),
        F.when(code.isNotNull(), nucleotide_complement(code)).cast("int").alias("pair"),
        nucleotide_letter(code).alias("letter"),
        amino_acid_code(c).cast("int").alias("amino"),
        three_letter(c).alias("three"),
        ALPHABETS["protein"].index(c).cast("int").alias("protein"),
        ALPHABETS["dna"].complement_letter(c).alias("complement"),
    )


# --- qualities


@query(
    """WITH q AS (SELECT DISTINCT l_partkey % 94 AS q FROM lineitem)
SELECT CAST(q AS INTEGER) AS q, round(pow(10.0, -q / 10.0), 12) AS p, CAST(q AS INTEGER) AS again, chr(CAST(q + 33 AS INTEGER)) AS sanger,
  CAST(CASE WHEN q = 0 THEN -5 ELSE round(10 * log10(nullif(pow(10.0, q / 10.0) - 1, 0))) END AS INTEGER) AS solexa,
  CAST(round(10 * log10(pow(10.0, (q - 10) / 10.0) + 1)) AS INTEGER) AS from_solexa, CAST(q AS INTEGER) AS decoded FROM q"""
)
def quality_scores(spark, sf_dir):
    q = F.col("q")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 94).cast("int").alias("q")).distinct()
    p = quality.error_probability(q)
    letter = quality.encode_phred(q, "sanger")
    return rows.select(
        "q",
        F.round(p, 12).alias("p"),
        quality.phred_from_probability(p).alias("again"),
        letter.alias("sanger"),
        quality.phred_to_solexa(q).alias("solexa"),
        quality.solexa_to_phred(q - 10).alias("from_solexa"),
        quality.decode_phred(letter, "illumina_1_8").cast("int").alias("decoded"),
    )


# --- fields of alignments

FLAG_SQL = ", ".join(f"(f & {1 << k}) <> 0 AS {name}" for k, name in enumerate(af.FLAGS))


@query(f"WITH f AS (SELECT DISTINCT CAST(l_partkey % 8192 AS INTEGER) AS f FROM lineitem) SELECT f AS flag, {FLAG_SQL}, f & 4095 AS value FROM f")
def sam_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 8192).cast("int").alias("flag")).distinct()
    return rows.select("flag", af.flags(F.col("flag")).alias("b")).select("flag", "b.*", af.flag_value(F.col("b")).alias("value"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_partkey % 50 + 1 AS b, l_suppkey % 9 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(5 AS INTEGER) AS n_ops, CAST(a + b + c + 3 AS BIGINT) AS query_length, CAST(b + c + 2 * a AS BIGINT) AS reference_length, 'S' AS first_op, CAST(1 AS INTEGER) AS code_of_second FROM l"""
)
def cigar_spans(spark, sf_dir):
    a, b, c = F.col("l_linenumber"), F.col("l_partkey") % 50 + 1, F.col("l_suppkey") % 9
    text = F.concat(F.lit("3S"), a, F.lit("I"), b, F.lit("M"), a * 2, F.lit("N"), c, F.lit("="))
    ops = F.col("ops")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", af.cigar(text).alias("ops"))
        .select(
            "l_orderkey",
            "l_linenumber",
            F.size("ops").alias("n_ops"),
            af.query_length(ops).alias("query_length"),
            af.reference_length(ops).alias("reference_length"),
            af.cigar_op(af.cigar_code(ops[0]["op"])).alias("first_op"),
            af.cigar_code(ops[1]["op"]).cast("int").alias("code_of_second"),
        )
    )


@query(
    """SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS nm, o_orderpriority || ':x' AS md, CAST(o_custkey % 7 AS FLOAT) AS xf, left(o_orderstatus, 1) AS ch,
  CAST(3 AS BIGINT) + o_custkey AS arr_sum, 'S' AS sub, CAST(NULL AS BIGINT) AS absent FROM orders"""
)
def aux_fields(spark, sf_dir):
    key = F.col("o_custkey")
    text = F.concat(
        F.lit("NM:i:"), key, F.lit("\tMD:Z:"), F.col("o_orderpriority"), F.lit(":x\t\tXF:f:"), key % 7, F.lit("\tCH:A:"), F.left("o_orderstatus", F.lit(1)), F.lit("\tAR:B:S,1,2,"), key
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", af.aux_fields(text).alias("x"))
    get = lambda t: af.aux_get(F.col("x"), t)
    return rows.select(
        "o_orderkey",
        get("NM")["i"].alias("nm"),
        get("MD")["s"].alias("md"),
        get("XF")["f"].alias("xf"),
        get("CH")["c"].alias("ch"),
        F.aggregate(af.array_ints(get("AR")), F.lit(0).cast("long"), lambda a, v: a + v).alias("arr_sum"),
        get("AR")["sub"].alias("sub"),
        get("ZZ")["i"].alias("absent"),
    )


# --- ranks, q-grams, bits


@query(
    f"""{DOCS}, c AS (SELECT doc_id, unnest(range(0, length(s))) AS p, unnest(list_transform(string_split(s, ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT))) AS r FROM d WHERE s <> ''),
g AS (SELECT {" + ".join(f"(lead(r, {j}) OVER w << {14 - 2 * j})" for j in range(8))} AS g FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY p))
SELECT CAST(g AS BIGINT) AS qgram, CAST(count(*) AS BIGINT) AS n FROM g WHERE g IS NOT NULL GROUP BY 1"""
)
def qgram_counts(spark, sf_dir):
    return count_qgrams(dna_of(spark, sf_dir), "s", RankTransform("ACGT"), 8)


@query(
    f"""{SHORT}, c AS (SELECT item_id, unnest(range(0, length(t) - 1)) AS p, unnest(list_transform(string_split(left(t, length(t) - 1), ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT))) AS r FROM b),
g AS (SELECT item_id, p, {" + ".join(f"(lead(r, {j}) OVER w << {4 - 2 * j})" for j in range(3))} AS g FROM c WINDOW w AS (PARTITION BY item_id ORDER BY p))
SELECT item_id, list(CAST(g AS BIGINT) ORDER BY p) AS qgrams FROM g WHERE g IS NOT NULL GROUP BY 1"""
)
def qgram_rows(spark, sf_dir):
    rows = short_texts(spark, sf_dir)
    return rows.select("item_id", RankTransform("ACGT").qgrams(3, F.rtrim("t", F.lit("$"))).alias("qgrams")).where("size(qgrams) > 0")


@query(
    f"""{DOCS}, v AS (SELECT doc_id, list_transform(string_split(s, ''), lambda c: instr('ACGT', c) - 1) AS v FROM d WHERE s <> '')
SELECT doc_id, CAST(list_sum(v) AS BIGINT) AS rank_sum, CAST(ceil(len(v) / 10.0) AS BIGINT) AS n_blocks,
  CAST(list_sum(list_transform(range(0, least(10, len(v))), lambda k: CAST(v[k + 1] AS BIGINT) << (3 * k))) AS BIGINT) AS first_block,
  CAST(v[13] AS BIGINT) AS twelfth, true AS same FROM v"""
)
def bit_packing(spark, sf_dir):
    enc, ranks = BitEncoding(3), RankTransform("TGCA")
    small_batches(spark)
    # a filter on the sequence would derive it once more
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[A-Za-z]"))
    rows = docs.select("doc_id", ranks.transform(derived_dna(F.col("text"))).alias("v"))
    rows = rows.select("doc_id", "v", enc.pack(F.col("v")).alias("b"), F.size("v").alias("n"))
    b, n = F.col("b"), F.col("n")
    return rows.select(
        "doc_id",
        F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("rank_sum"),
        enc.blocks_for(n).alias("n_blocks"),
        b[0].alias("first_block"),
        enc.get(b, n, F.lit(12)).alias("twelfth"),
        (enc.unpack(b, n) == F.col("v").cast("array<bigint>")).alias("same"),
    )


# --- distances


@query(
    f"""WITH p AS (SELECT item_id, {DNA} AS s FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, CAST(CASE WHEN length(x.s) = length(y.s) THEN hamming(x.s, y.s) END AS INTEGER) AS hamming, CAST(hamming(x.s, reverse(x.s)) AS INTEGER) AS mirror,
  CAST(levenshtein(x.s, y.s) AS INTEGER) AS levenshtein, CAST(CASE WHEN levenshtein(x.s, y.s) <= 120 THEN levenshtein(x.s, y.s) END AS INTEGER) AS bounded
FROM p x JOIN p y ON y.item_id = x.item_id + 1"""
)
def edit_distances(spark, sf_dir):
    """Each item with the next: an equi-join, never all pairs."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", derived_dna(F.col("text")).alias("s"))
    x, y = rows.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.col("s").alias("x")), rows.select(F.col("item_id").alias("b"), F.col("s").alias("y"))
    a, b = F.col("x"), F.col("y")
    return x.join(y, "b").select(
        "a",
        "b",
        F.when(F.length(a) == F.length(b), composition.count_mismatches(a, b)).alias("hamming"),
        distance.hamming(a, F.reverse(a)).alias("mirror"),
        distance.levenshtein(a, b).alias("levenshtein"),
        distance.bounded_levenshtein(a, b, 120).alias("bounded"),
    )


# --- matching


@query(
    f"""{DOCS}, c AS (SELECT doc_id, unnest(range(0, length(s))) AS p, unnest(string_split(s, '')) AS c FROM d WHERE s <> ''),
w AS (SELECT doc_id, p, string_agg(c, '') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w FROM c)
SELECT doc_id, pattern, CAST(p AS INTEGER) AS position FROM w, (SELECT unnest(['ACGTACGT', 'GAAA', 'CCC']) AS pattern) WHERE starts_with(w, pattern)"""
)
def find_all(spark, sf_dir):
    found = matching.find_patterns(dna_of(spark, sf_dir), "s", ["ACGTACGT", "GAAA", "CCC"])
    return found.select("doc_id", "pattern", F.col("position").cast("int").alias("position"))


@query(f"{DOCS} SELECT doc_id, contains(s, 'GAAAC') AS has, CAST(len(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 2) = 'CC')) AS INTEGER) AS n FROM d")
def match_counts(spark, sf_dir):
    s = F.col("s")
    return dna_of(spark, sf_dir).select("doc_id", matching.contains(s, "GAAAC").alias("has"), matching.count(s, "CC").alias("n"))


@query(
    """SELECT algorithm, key, CAST(value AS BIGINT) AS value FROM (VALUES
  ('kmp', '0', 0), ('kmp', '1', 0), ('kmp', '2', 0), ('kmp', '3', 0), ('kmp', '4', 1), ('kmp', '5', 2), ('kmp', '6', 3), ('kmp', '7', 4),
  ('kmp on A', '8', 5), ('horspool', 'A', 3), ('horspool', 'C', 2), ('horspool', 'G', 1), ('horspool', 'T', 4),
  ('shift-and', 'A', 17), ('shift-and', 'C', 34), ('shift-and', 'G', 68), ('shift-and', 'T', 136), ('shift-and', 'end', 128),
  ('bndm', 'A', 136), ('bndm', 'C', 68), ('bndm', 'G', 34), ('bndm', 'T', 17), ('bndm', 'end', 128),
  ('bom', '0G', 1), ('bom', '0C', 2), ('bom', '1C', 2), ('bom', '0A', 3), ('bom', '2A', 3)) t(algorithm, key, value)"""
)
def matching_tables(spark, sf_dir):
    """What the five exact matchers know about ACGTACGT (the oracle: about ACG)."""
    p = "ACGTACGT"
    rows = [("kmp", str(i), k) for i, k in enumerate(matching.kmp_borders(p))]
    rows += [("kmp on A", str(len(p)), matching.kmp_delta(p, len(p), "A"))]
    rows += [("horspool", c, k) for c, k in matching.horspool_shifts(p).items()]
    for name, masks in (("shift-and", matching.shift_and_masks), ("bndm", matching.bndm_masks)):
        own, end = masks(p)
        rows += [(name, c, k) for c, k in own.items()] + [(name, "end", end)]
    rows += [("bom", f"{state}{c}", to) for state, edges in enumerate(matching.factor_oracle("ACG")) for c, to in edges.items()]
    return spark.createDataFrame(rows, "algorithm string, key string, value long")


# --- reading frames


@query(
    f"""{DOCS}, c AS (SELECT doc_id, unnest(range(0, length(s))) AS p, unnest(string_split(s, '')) AS c FROM d WHERE s <> ''),
p AS (SELECT doc_id, p, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS codon FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT * FROM p WHERE codon IN ('ATG', 'TGA', 'TAG', 'TAA')),
w AS (SELECT *, min(CASE WHEN codon <> 'ATG' THEN p END) OVER (PARTITION BY doc_id, p % 3 ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM k)
SELECT doc_id, CAST(p AS BIGINT) AS start, CAST(stop + 3 AS BIGINT) AS "end", CAST(p % 3 AS TINYINT) AS "offset" FROM w WHERE codon = 'ATG' AND stop + 1 - p > 30"""
)
def orfs(spark, sf_dir):
    return orf.find_orfs(dna_of(spark, sf_dir), "s", ["ATG"], ["TGA", "TAG", "TAA"], 30).select("doc_id", "start", "end", "offset")


# --- full-text index

SA_SQL = f"""{SHORT}, s AS (SELECT item_id, t, unnest(range(0, length(t))) AS p FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY substr(t, p + 1)) - 1 AS r, CASE WHEN p = 0 THEN right(t, 1) ELSE substr(t, p, 1) END AS c FROM s)"""


def _indexed(spark, sf_dir):
    rows = short_texts(spark, sf_dir).withColumn("sa", fulltext.suffix_array("t"))
    return rows.withColumn("bwt", fulltext.bwt(F.col("t"), F.col("sa")))


@query(
    f"""{SA_SQL}, l AS (SELECT item_id, t, r, p, lag(p) OVER (PARTITION BY item_id ORDER BY r) AS q FROM r)
SELECT item_id, CAST(r AS INTEGER) AS r, CAST(p AS BIGINT) AS pos,
  CAST(CASE WHEN q IS NULL THEN -1 ELSE len(list_filter(range(1, length(t)), lambda k: substr(t, p + 1, k) = substr(t, q + 1, k) AND p + k <= length(t) AND q + k <= length(t))) END AS BIGINT) AS lcp FROM l"""
)
def suffix_arrays(spark, sf_dir):
    rows = _indexed(spark, sf_dir).withColumn("lcp", fulltext.lcp("t", "sa"))
    both = F.arrays_zip(F.col("sa").alias("pos"), F.slice("lcp", 1, F.size("sa")).alias("lcp"))
    return rows.select("item_id", F.posexplode(both).alias("r", "x")).select("item_id", "r", F.col("x.pos").alias("pos"), F.col("x.lcp").alias("lcp"))


@query(
    f"""{SA_SQL}, w AS (SELECT item_id, any_value(t) AS t, string_agg(c, '' ORDER BY r) AS bwt FROM r GROUP BY item_id)
SELECT item_id, bwt, t AS inverted, CAST(length(left(bwt, 21)) - length(replace(left(bwt, 21), 'G', '')) AS BIGINT) AS occ_g,
  CAST(1 + length(t) - length(replace(t, 'A', '')) AS BIGINT) AS less_c FROM w"""
)
def bwt_index(spark, sf_dir):
    rows = _indexed(spark, sf_dir)
    return rows.select(
        "item_id",
        "bwt",
        fulltext.invert_bwt("bwt").alias("inverted"),
        fulltext.occ(F.col("bwt"), F.lit(20), F.lit("G")).alias("occ_g"),
        F.element_at(fulltext.less(F.col("bwt")), ord("C") + 1).alias("less_c"),
    )


@query(
    f"""{SHORT}, q AS (SELECT unnest(['ACG', 'TTGA', 'GGGGCCCC', '']) AS pattern),
k AS (SELECT item_id, t, pattern, list_max(list_filter(range(1, length(pattern) + 1), lambda k: contains(t, right(pattern, k)))) AS len FROM b, q),
o AS (SELECT *, CASE WHEN len IS NULL THEN 'absent' WHEN len = length(pattern) THEN 'complete' ELSE 'partial' END AS kind FROM k)
SELECT item_id, pattern, kind, CAST(CASE WHEN kind = 'partial' THEN len END AS INTEGER) AS len,
  list_sort(list_filter(range(0, length(t)), lambda p: len IS NOT NULL AND substr(t, p + 1, len) = right(pattern, len))) AS positions FROM o"""
)
def fm_search(spark, sf_dir):
    rows = _indexed(spark, sf_dir).select("item_id", "sa", "bwt", F.explode(F.array(*map(F.lit, ("ACG", "TTGA", "GGGGCCCC", "")))).alias("pattern"))
    rows = rows.withColumn("hit", fulltext.backward_search(F.col("bwt"), F.col("pattern")))
    found = F.coalesce(F.sort_array(fulltext.occurrences(F.col("sa"), F.col("hit"))), F.array().cast("array<bigint>"))
    return rows.select("item_id", "pattern", F.col("hit.kind").alias("kind"), F.col("hit.len").alias("len"), found.alias("positions"))


# --- files


def _reads(spark, sf_dir):
    """Reads with names and qualities from documents."""
    s = F.col("s")
    return dna_of(spark, sf_dir).where("length(s) > 0").select(
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit(" from documents")).alias("name"), s.alias("seq"), F.translate(s, "ACGT", "@I5+").alias("qual")
    )


@query(f"{DOCS} SELECT 'doc' || doc_id || ' from documents' AS name, md5(s) AS seq, CAST(length(s) AS INTEGER) AS n FROM d WHERE s <> ''")
def fasta_round_trip(spark, sf_dir):
    path = fresh(spark, "reads.fa")
    fastx.write_fasta(_reads(spark, sf_dir), path, width=60)
    return fastx.read_fasta(spark, path).select("name", F.md5("seq").alias("seq"), F.length("seq").alias("n"))


@query(f"{DOCS} SELECT 'doc' || doc_id || ' from documents' AS name, md5(s) AS seq, md5(translate(s, 'ACGT', '@I5+')) AS qual FROM d WHERE s <> ''")
def fastq_round_trip(spark, sf_dir):
    path = fresh(spark, "reads.fq")
    fastx.write_fastq(_reads(spark, sf_dir), path, line_ending="\r\n")
    return fastx.read_fastq(spark, path).select("name", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@query(
    f"""{DOCS} SELECT 'fa' AS kind, 'doc' || doc_id || ' from documents' AS name, md5(s) AS seq, CAST(NULL AS VARCHAR) AS qual FROM d WHERE s <> ''
UNION ALL SELECT 'fq', 'doc' || doc_id || ' from documents', md5(s), md5(translate(s, 'ACGT', '@I5+')) FROM d WHERE s <> ''"""
)
def mixed_files(spark, sf_dir):
    """FASTA and FASTQ files in one folder, told apart by their records."""
    path = fresh(spark, "mixed")
    fastx.write_fasta(_reads(spark, sf_dir), f"{path}/a", width=50, line_ending="\r\n")
    fastx.write_fastq(_reads(spark, sf_dir), f"{path}/b")
    got = fastx.read_fastx(spark, f"{path}/*/part-*")
    return got.select(F.when(F.col("qual").isNull(), "fa").otherwise("fq").alias("kind"), "name", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@query(f"{DOCS} SELECT 'doc' || doc_id AS name, md5(s) AS seq, CAST(length(s) AS BIGINT) AS length FROM d WHERE s <> ''")
def fetch_many(spark, sf_dir):
    """Random access in many files by one index."""
    path = fresh(spark, "many.fa")
    fastx.write_fasta(_reads(spark, sf_dir), path, width=70)
    index = fastx.scan_index(spark, f"{path}/part-*")
    got = fastx.fetch(spark, f"{path}/part-*", index)
    return got.select("name", F.md5("seq").alias("seq"), F.length("seq").cast("long").alias("length"))


@query(
    f"""{DOCS} SELECT 'doc' || doc_id AS name, CAST(length(s) AS BIGINT) AS length, CAST(least(length(s), 60) AS BIGINT) AS line_base, CAST(least(length(s), 60) + 1 AS BIGINT) AS line_width,
  md5(s) AS fetched FROM d WHERE s <> ''"""
)
def fasta_index(spark, sf_dir):
    """One file is indexed, its index written and read again, and every sequence fetched by it."""
    path, parts, fai = fresh(spark, "one.fa"), fresh(spark, "parts.fa"), fresh(spark, "one.fai")
    fastx.write_one_file(spark, lambda to: fastx.write_fasta(_reads(spark, sf_dir), to, width=60), path, parts)
    fastx.write_index(fastx.scan_index(spark, path), fai)
    index = fastx.read_index(spark, fai)
    got = fastx.fetch(spark, f"{path}/part-*", index).select("name", F.md5("seq").alias("fetched"))
    return index.select("name", "length", "line_base", "line_width").join(got, "name")


@query(
    f"""{DOCS} SELECT 'doc' || doc_id AS name, CAST(length(s) AS BIGINT) AS length, CAST(length(s) + 3 AS BIGINT) AS gap, md5(s) AS seq, md5(translate(s, 'ACGT', '@I5+')) AS qual FROM d WHERE s <> ''"""
)
def fastq_index(spark, sf_dir):
    path, parts, fai = fresh(spark, "one.fq"), fresh(spark, "parts.fq"), fresh(spark, "one.fqi")
    fastx.write_one_file(spark, lambda to: fastx.write_fastq(_reads(spark, sf_dir), to), path, parts)
    fastx.write_index(fastx.scan_index(spark, path), fai)
    index = fastx.read_index(spark, fai, fastq=True)
    got = fastx.fetch(spark, f"{path}/part-*", index).select("name", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))
    return index.select("name", "length", (F.col("qual_offset") - F.col("offset")).alias("gap")).join(got, "name")


REFS = [("ref1", 45), ("ref2", 40), ("ref1", 50)]
HEADER = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in REFS) + "@RG\tID:a:b\tSM:x\n@PG\tID:p\n@CO\ta comment\n"


def _alignments(spark, sf_dir):
    """Alignments from line items, without repeats of their names."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    name = F.concat(F.col("l_orderkey"), F.lit("/"), n)
    rname = F.when(k % 5 == 0, "*").when(k % 5 == 1, "ref2").when(k % 5 == 2, "nowhere").otherwise("ref1")
    rnext = F.when(k % 3 == 0, "=").when(k % 3 == 1, "*").otherwise("ref2")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        name.alias("qname"), (k % 4096).cast("int").alias("flag"), rname.alias("rname"), (k % 1000).alias("pos"), (k % 60).cast("smallint").alias("mapq"),
        F.concat(n, F.lit("M2S")).alias("cigar"), rnext.alias("rnext"), (k % 7).alias("pnext"), (-(k % 90)).alias("tlen"),
        F.repeat(F.lit("G"), n + 2).alias("seq"), F.when(k % 2 == 0, "").otherwise(F.repeat(F.lit("5"), n + 2)).alias("qual"),
        k.alias("nm"),
    )


#: Alignments that are written to one file; a file is one task when it is read.
FILE_ROWS = 1_000_000


def _dealt(rows: DataFrame) -> DataFrame:
    """As many partitions as tasks can run at once, however few files the table has, and more where files would get long."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FILE_ROWS)))


ALIGNED_SQL = """WITH l AS (SELECT l_orderkey || '/' || l_linenumber AS qname, l_partkey AS k, l_linenumber AS n FROM lineitem),
a AS (SELECT qname, k, n, CASE WHEN k % 5 = 1 THEN 1 WHEN k % 5 IN (0, 2) THEN -1 ELSE 2 END AS tid FROM l),
m AS (SELECT *, CASE WHEN k % 3 = 0 THEN tid WHEN k % 3 = 1 THEN -1 ELSE 1 END AS mtid FROM a)"""


@query(
    f"""{ALIGNED_SQL} SELECT qname, CAST(k % 4096 AS INTEGER) AS flag, CAST(tid AS INTEGER) AS tid, CAST(mtid AS INTEGER) AS mtid, CAST(k % 1000 AS BIGINT) AS pos,
  n || 'M2S' AS cigar, repeat('G', n + 2) AS seq, CASE WHEN k % 2 = 1 THEN 20 END AS phred, CAST(k AS BIGINT) AS nm FROM m"""
)
def sam_round_trip(spark, sf_dir):
    star = lambda c: F.when(F.col(c) == "", "*").otherwise(F.col(c))
    rows = _alignments(spark, sf_dir)
    line = F.concat_ws("\t", *(star(c).cast("string") if c == "qual" else F.col(c).cast("string") for c in sam.COLUMNS), F.concat(F.lit("NM:i:"), F.col("nm")))
    body = rows.select(line.alias("value"))
    path = fresh(spark, "a.sam")
    head = spark.createDataFrame([(HEADER.rstrip("\n"),)], "value string")
    head.coalesce(1).write.text(path)
    body.write.mode("append").text(path)
    got = sam.read_sam(spark, path)
    phred = F.when(F.col("qual") != "", af.phred_at(F.col("qual"), F.lit(0)))
    return got.select("qname", "flag", "tid", "mtid", "pos", "cigar", "seq", phred.alias("phred"), af.aux_get(af.aux_fields(F.col("aux")), "NM")["i"].alias("nm"))


@query(
    """SELECT * FROM (VALUES ('ref', 'ref1', CAST(45 AS BIGINT)), ('ref', 'ref2', 40), ('ref', 'ref1', 50), ('tid', 'ref1', 2), ('tid', 'ref2', 1),
  ('group', 'a:b', 1), ('program', 'p', 1), ('comment', 'a comment', 1), ('order', 'coordinate/none', 6)) t(kind, name, n)"""
)
def sam_header(spark, sf_dir):
    from strandlake.operators.dictionary import by_name

    path = fresh(spark, "h.sam")
    spark.createDataFrame([(HEADER.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    h = sam.read_header(spark, path)
    one = F.lit(1).cast("long")
    parts = [
        h.refs().select(F.lit("ref").alias("kind"), "name", F.col("len").alias("n")),
        by_name(h.refs()).select(F.lit("tid").alias("kind"), "name", F.col("tid").cast("long").alias("n")),
        h.read_groups().select(F.lit("group").alias("kind"), sam.tag("tags", "ID").alias("name"), one.alias("n")),
        h.programs().select(F.lit("program").alias("kind"), sam.tag("tags", "ID").alias("name"), one.alias("n")),
        h.comments().select(F.lit("comment").alias("kind"), F.col("text").alias("name"), one.alias("n")),
        h.version().select(F.lit("order").alias("kind"), F.concat_ws("/", "sort_order", "group_order").alias("name"), F.col("minor").cast("long").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    f"""{ALIGNED_SQL} SELECT qname, CAST(k % 4096 AS INTEGER) AS flag, CAST(tid AS INTEGER) AS tid, CAST(k % 1000 AS BIGINT) AS pos, n || 'M2S' AS cigar,
  repeat('G', n + 2) AS seq, CASE WHEN k % 2 = 1 THEN repeat('5', n + 2) ELSE '' END AS qual, CAST(-(k % 90) AS BIGINT) AS tlen FROM m"""
)
def bam_round_trip(spark, sf_dir):
    from strandlake.operators.dictionary import resolve

    refs = spark.createDataFrame([(k, n, size) for k, (n, size) in enumerate(REFS)], "tid int, name string, len bigint")
    rows = resolve(_dealt(_alignments(spark, sf_dir)), refs)
    path = fresh(spark, "a.bam")
    bam.write_bam(bam.packed_rows(rows), path, HEADER, REFS)
    return bam.read_bam(spark, f"{path}/part-*").select("qname", "flag", "tid", "pos", "cigar", "seq", "qual", "tlen")


@query(
    f"""{ALIGNED_SQL}
SELECT qname, (['ref1', 'ref2', 'ref1'])[tid + 1] AS ref, CAST(([45, 40, 50])[tid + 1] AS BIGINT) AS ref_length, n + 2 AS l_seq, CAST(0 AS INTEGER) AS bin,
  'NM:i:' || (k % 200) || chr(9) || 'XZ:Z:n' || n || chr(9) || 'XB:B:C,' || (k % 50) || ',7' || chr(9) || 'XF:f:1.5' || chr(9) || 'XA:A:q' AS aux,
  CAST(k % 50 + 7 AS BIGINT) AS arr_sum, 'C' AS sub, CAST(k % 200 AS BIGINT) AS nm, CASE WHEN k % 2 = 1 THEN 20 END AS phred, 'G' AS first_base
FROM (SELECT qname, k, CAST(n AS BIGINT) AS n, CAST(tid AS INTEGER) AS tid FROM m)"""
)
def bam_fields(spark, sf_dir):
    """Binary optional fields, references by ordinal and packed qualities, through BAM files."""
    from strandlake.operators.dictionary import ref_length, ref_name, resolve

    refs = spark.createDataFrame([(k, n, size) for k, (n, size) in enumerate(REFS)], "tid int, name string, len bigint")
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    raw = lambda b: F.lit(b).cast("binary")
    k, n = F.col("nm"), F.split("qname", "/")[1]
    aux = F.concat(raw(b"NMC"), byte(k % 200), raw(b"XZZn"), F.encode(n, "UTF-8"), raw(b"\0XBBC\x02\0\0\0"), byte(k % 50), raw(b"\x07XFf\0\0\xc0\x3fXAAq"))
    path = fresh(spark, "b.bam")
    bam.write_bam(bam.packed_rows(resolve(_dealt(_alignments(spark, sf_dir)), refs).withColumn("aux_raw", aux)), path, HEADER, REFS)
    dictionary = bam.read_bam_refs(spark, f"{path}/part-*").select("tid", "name", "len").distinct()
    own = [(r.name, r.len) for r in dictionary.orderBy("tid").collect()]  # one header's references
    got = bam.read_bam(spark, f"{path}/part-*").withColumn("aux", bam.aux_as_text("aux_raw")).withColumn("x", af.aux_fields(F.col("aux")))
    names, lengths = (F.array(*(F.lit(r[c]) for r in own)) for c in (0, 1))
    tid, array = F.col("tid"), af.aux_get(F.col("x"), "XB")
    return got.select(
        "qname",
        ref_name(names, tid).alias("ref"),
        ref_length(lengths, tid).alias("ref_length"),
        "l_seq",
        "bin",
        "aux",
        F.aggregate(af.array_ints(array), F.lit(0).cast("long"), lambda a, v: a + v).alias("arr_sum"),
        array["sub"].alias("sub"),
        af.aux_get(F.col("x"), "NM")["i"].alias("nm"),
        F.when(~af.quality_unavailable(F.col("qual_raw")), af.phred_at(F.col("qual"), F.lit(0))).alias("phred"),
        F.left(af.packed_bases(F.col("seq_packed"), F.col("l_seq")), F.lit(1)).alias("first_base"),
    )


# --- alignment


def _pairs(spark, sf_dir):
    rows = short_texts(spark, sf_dir).select("item_id", F.rtrim("t", F.lit("$")).alias("t"))
    return rows.select(F.col("item_id").alias("a"), F.col("t").alias("x"), (F.col("item_id") + 1).alias("b")).join(rows.select(F.col("item_id").alias("b"), F.col("t").alias("y")), "b")


def _scores_sql(texts: str, modes: str, letters: str, gap_open: int, gap_extend: int, result: str) -> str:
    """Best alignment scores by recursion over the letters of y, a column of cells a step; the best end of each mode's clips counts.

    texts: rows (item_id, s); modes: rows (mode, xclip, yclip); letters: the score of the letters p and q.
    """
    never = -1_000_000
    return f"""WITH RECURSIVE t AS ({texts}),
p AS (SELECT x.item_id AS a, x.s AS x, y.s AS y FROM t x JOIN t y ON y.item_id = x.item_id + 1),
v AS (SELECT * FROM (VALUES {modes}) v(mode, xclip, yclip)),
l AS (SELECT a, mode, xclip, yclip, y, length(y) AS n, length(x) AS m, unnest(range(0, length(x) + 1)) AS i, string_split('.' || x, '') AS letters FROM p, v),
k AS (SELECT * EXCLUDE letters, letters[i + 1] AS p FROM l),
c AS (
  SELECT a, mode, i, 0::BIGINT AS j, CASE WHEN i = 0 THEN 0 ELSE greatest({gap_open} + {gap_extend} * (i - 1), xclip) END::BIGINT AS s, ({never})::BIGINT AS d FROM k
  UNION ALL
  SELECT a, mode, i, j, greatest(best, {gap_open} + {gap_extend} * (i - 1)
    + coalesce(max(best - {gap_extend} * i) OVER (PARTITION BY a, mode ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {never})), d
  FROM (
    SELECT a, mode, i, j + 1 AS j, greatest(d + {gap_extend}, s + {gap_open}) AS d,
      CASE WHEN i = 0 THEN greatest({gap_open} + {gap_extend} * j, yclip)
      ELSE greatest(before + {letters}, d + {gap_extend}, s + {gap_open}, xclip + greatest(yclip, {gap_open} + {gap_extend} * j)) END AS best
    FROM (SELECT c.*, xclip, yclip, p, substr(y, c.j + 1, 1) AS q, lag(c.s) OVER (PARTITION BY c.a, c.mode ORDER BY c.i) AS before
      FROM c JOIN k ON c.a = k.a AND c.mode = k.mode AND c.i = k.i WHERE c.j < n))),
e AS (SELECT c.a, c.mode, max(c.s + CASE WHEN c.i < m THEN xclip ELSE 0 END + CASE WHEN c.j < n THEN yclip ELSE 0 END) AS score
  FROM c JOIN k ON c.a = k.a AND c.mode = k.mode AND c.i = k.i GROUP BY ALL)
SELECT a, a + 1 AS b, {result} FROM e GROUP BY a"""


MODES = ("global", "semiglobal", "local", "custom")


@query(
    _scores_sql(
        f"SELECT item_id, {DNA} AS s FROM benchmark",
        "('global', -1000000, -1000000), ('semiglobal', -1000000, 0), ('local', 0, 0), ('custom', -1000000, -4)",
        "CASE WHEN p = q THEN 1 ELSE -1 END",
        -5,
        -1,
        ", ".join(f"CAST(max(score) FILTER (WHERE mode = '{m}') AS INTEGER) AS {m}_score" for m in MODES),
    )
)
def pairwise_alignment(spark, sf_dir):
    """Scores of the four modes for neighbouring items."""
    scoring = align.Scoring(-5, -1, align.MatchScore(1, -1)).yclip(-4)
    rows = _pairs(spark, sf_dir)
    for mode in MODES:
        rows = rows.withColumn(mode, align.alignment(scoring, mode)("x", "y"))
    return rows.select("a", "b", *(F.col(f"{m}.score").alias(f"{m}_score") for m in MODES))


@query(
    f"""WITH p AS (SELECT item_id, {DNA} AS s FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, CAST(-levenshtein(x.s, y.s) AS INTEGER) AS score, CAST(levenshtein(x.s, y.s) AS INTEGER) AS edits,
  CAST(length(x.s) AS INTEGER) AS of_x, CAST(length(y.s) AS INTEGER) AS of_y, CAST(0 AS INTEGER) AS xstart, CAST(length(x.s) AS INTEGER) AS xend, CAST(length(y.s) AS INTEGER) AS yend
FROM p x JOIN p y ON y.item_id = x.item_id + 1"""
)
def unit_cost_alignment(spark, sf_dir):
    """Global alignment where each edit costs one: its score is the edit distance, and so is the number of its edits."""
    ops = F.col("r.operations")
    of = lambda *kinds: F.size(F.filter(ops, lambda o: o["op"].isin(*kinds)))
    rows = _pairs(spark, sf_dir).select("a", "b", align.alignment(align.Scoring(-1, -1, align.MatchScore(0, -1)), "global")("x", "y").alias("r"))
    return rows.select(
        "a", "b", "r.score", of("ins", "del", "subst").alias("edits"), of("match", "subst", "ins").alias("of_x"), of("match", "subst", "del").alias("of_y"), "r.xstart", "r.xend", "r.yend"
    )


def _cases():
    """(name, mode, scoring, x, y) of pairs whose best alignments are known."""
    plain, cheap = align.MatchScore(1, -1), align.MatchScore(1, -5)
    blosum = align.FunctionScore(matrices.blosum(62).by_code)
    long = ("ACCGTGGAT", "AAAAACCGTTGAT")
    return [
        ("semiglobal", "semiglobal", align.Scoring(-5, -1, plain), *long),
        ("gaps under a mismatch", "semiglobal", align.Scoring(-1, -1, cheap), *long),
        ("global", "global", align.Scoring(-5, -1, plain), *long),
        ("one long insertion", "global", align.Scoring(-5, -1, align.MatchScore(1, -3)), "ACGAGAACA", "ACGACA"),
        ("local", "local", align.Scoring(-5, -1, plain), *long),
        ("protein, global", "global", align.Scoring(-5, -1, blosum), "AAAA", "AAAA"),
        ("protein, local", "local", align.Scoring(-10, -1, blosum), "LSPADKTNVKAA", "PEEKSAV"),
        ("free clips of y", "custom", align.Scoring(-5, -1, plain).yclip(0), *long),
        ("a function", "global", align.Scoring(-3, -1, align.FunctionScore(lambda a, b: 2 if a == b else -2)), "ACGT", "AGT"),
    ]


@query(
    """SELECT name, mode, CAST(score AS INTEGER) AS score, CAST(xstart AS INTEGER) AS xstart, CAST(xend AS INTEGER) AS xend,
  CAST(ystart AS INTEGER) AS ystart, CAST(yend AS INTEGER) AS yend, ops FROM (VALUES
  ('semiglobal', 'semiglobal', 7, 0, 9, 4, 13, 'MMMMMSMMM'),
  ('gaps under a mismatch', 'semiglobal', 6, 0, 9, 4, 13, 'MMMMDMIMMM'),
  ('global', 'global', -1, 0, 9, 0, 13, 'DDDDMMMMMSMMM'),
  ('one long insertion', 'global', -1, 0, 9, 0, 6, 'MMMIIIMMM'),
  ('local', 'local', 7, 0, 9, 4, 13, 'MMMMMSMMM'),
  ('protein, global', 'global', 16, 0, 4, 0, 4, 'MMMM'),
  ('protein, local', 'local', 16, 2, 9, 0, 7, 'MSSMSSM'),
  ('free clips of y', 'custom', 7, 0, 9, 4, 13, 'Y4MMMMMSMMM'),
  ('a function', 'global', 3, 0, 4, 0, 3, 'MIMM')) t(name, mode, score, xstart, xend, ystart, yend, ops)"""
)
def alignment_cases(spark, sf_dir):
    """Every mode, affine gaps, clips and both kinds of scores, on pairs whose best alignments are known."""
    letters = {"match": "M", "subst": "S", "ins": "I", "del": "D", "xclip": "X", "yclip": "Y"}
    out = None
    for name, mode, scoring, x, y in _cases():
        one = spark.createDataFrame([(name, mode, x, y)], "name string, mode string, x string, y string")
        one = one.select("name", "mode", align.alignment(scoring, mode)("x", "y").alias("r"))
        out = one if out is None else out.unionByName(one)
    letter = F.create_map(*(F.lit(v) for pair in letters.items() for v in pair))
    ops = F.array_join(F.transform("r.operations", lambda o: F.concat(letter[o["op"]], F.coalesce(o["n"].cast("string"), F.lit("")))), "")
    return out.select("name", "mode", "r.score", "r.xstart", "r.xend", "r.ystart", "r.yend", ops.alias("ops"))


_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLOSUM62 = [[matrices.blosum(62).score(a, b) for b in _A_TO_Z] for a in _A_TO_Z]


@query(
    _scores_sql(
        "SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark",
        "('local', 0, 0)",
        f"({_BLOSUM62})[ord(p) - 64][ord(q) - 64]",
        -10,
        -1,
        "CAST(max(score) AS INTEGER) AS score",
    )
)
def protein_alignment(spark, sf_dir):
    """Local alignment of prose under BLOSUM 62."""
    scoring = align.Scoring(-10, -1, align.FunctionScore(matrices.blosum(62).by_code))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("t"))
    pairs = rows.select(F.col("item_id").alias("a"), F.col("t").alias("x"), (F.col("item_id") + 1).alias("b")).join(rows.select(F.col("item_id").alias("b"), F.col("t").alias("y")), "b")
    return pairs.select("a", "b", align.alignment(scoring, "local")("x", "y").alias("r")).select("a", "b", "r.score")


MATRICES = {"blosum30": (matrices.blosum, 30), "blosum45": (matrices.blosum, 45), "blosum62": (matrices.blosum, 62)} | {f"pam{n}": (matrices.pam, n) for n in (40, 120, 200, 250)}


_UNITS = ", ".join(f"('pam{n}', {n}, {u!r})" for n, u in matrices.SCALE.items())
_TRIANGLES = ", ".join(f"('blosum{n}', '{t.strip()}', {matrices.BLOSUM_STAR[n]})" for n, t in matrices.BLOSUM.items())
_PUBLISHED = ", ".join(
    str((f"{kind}{n}", cells[k][0], cells[k][1], int(cells[k + 1])))
    for kind, table in (("blosum", matrices.BLOSUM_PUBLISHED), ("pam", matrices.PAM_PUBLISHED))
    for n, text in table.items()
    for cells in (text.split(),)
    for k in range(0, len(cells), 2)
)


@query(
    f"""WITH RECURSIVE res AS (SELECT unnest(range(20)) AS i, unnest(string_split('{matrices.RESIDUES}', '')) AS a, unnest({matrices.MUTABILITY}) AS mut, unnest({matrices.FREQUENCY}) AS raw),
f AS (SELECT i, a, mut, raw / sum(raw) OVER () AS f FROM res),
rows_ AS (SELECT unnest(range(1, 20)) AS i, unnest(string_split('{matrices.MUTATIONS.strip()}', chr(10))) AS line),
low AS (SELECT i, unnest(range(i)) AS j, CAST(unnest(string_split(line, ' ')) AS DOUBLE) AS n FROM rows_),
counts AS (SELECT i, j, n FROM low UNION ALL SELECT j, i, n FROM low),
rate AS (SELECT 0.01 / sum(f * mut) AS r FROM f),
step AS (
  SELECT c.i, c.j, n / sum(n) OVER (PARTITION BY c.j) * mut * r AS v FROM counts c JOIN f ON f.i = c.j, rate
  UNION ALL SELECT i, i, 1 - mut * r FROM f, rate),
power AS (
  SELECT 1 AS n, i, j, v FROM step
  UNION ALL SELECT n + 1, step.i, power.j, sum(step.v * power.v) FROM power JOIN step ON step.j = power.i WHERE n < 250 GROUP BY n, step.i, power.j),
unit AS (SELECT * FROM (VALUES {_UNITS}) u(matrix, n, unit)),
one AS (SELECT matrix, unit, p.i, p.j, v / f AS o FROM power p JOIN unit USING (n) JOIN f ON f.i = p.i),
odds AS (SELECT x.matrix, x.unit, x.i, x.j, (x.o + y.o) / 2 AS o FROM one x JOIN one y ON x.matrix = y.matrix AND x.i = y.j AND x.j = y.i),
part AS (SELECT a AS g, i, f FROM f UNION ALL SELECT 'B', i, f FROM f WHERE a IN ('N', 'D') UNION ALL SELECT 'Z', i, f FROM f WHERE a IN ('Q', 'E') UNION ALL SELECT 'X', i, f FROM f),
member AS (SELECT g, i, f / sum(f) OVER (PARTITION BY g) AS w FROM part),
pam AS (
  SELECT matrix, x.g AS a, y.g AS b, CASE WHEN 'X' IN (x.g, y.g) THEN sum(x.w * y.w * ln(greatest(o, 1e-12))) ELSE ln(greatest(sum(x.w * y.w * o), 1e-12)) END / any_value(unit) AS v
  FROM odds JOIN member x ON x.i = odds.i JOIN member y ON y.i = odds.j GROUP BY matrix, x.g, y.g),
lines AS (SELECT matrix, star, unnest(range(20)) AS i, unnest(string_split(text, chr(10))) AS line FROM (VALUES {_TRIANGLES}) t(matrix, text, star)),
cells AS (SELECT matrix, i, unnest(range(i + 1)) AS j, CAST(unnest(string_split(line, ' ')) AS INTEGER) AS v FROM lines),
whole AS (SELECT matrix, i, j, v FROM cells UNION SELECT matrix, j, i, v FROM cells),
blosum AS (
  SELECT matrix, x.g AS a, y.g AS b, CASE WHEN 'X' IN (x.g, y.g) THEN -1 ELSE avg(v) END AS v
  FROM whole JOIN part x ON x.i = whole.i JOIN part y ON y.i = whole.j GROUP BY matrix, x.g, y.g),
rule AS (SELECT matrix, a, b, sign(v) * floor(abs(v) + 0.5) AS v FROM (SELECT * FROM pam UNION ALL SELECT * FROM blosum)),
star AS (SELECT matrix, min(v) AS star FROM rule WHERE matrix LIKE 'pam%' GROUP BY matrix UNION SELECT DISTINCT matrix, star FROM lines),
fixed AS (SELECT * FROM (VALUES {_PUBLISHED}) t(matrix, a, b, v)),
known AS (
  SELECT matrix, a, b, coalesce(x.v, y.v, rule.v) AS v FROM rule LEFT JOIN fixed x USING (matrix, a, b) LEFT JOIN (SELECT matrix, b AS a, a AS b, v FROM fixed) y USING (matrix, a, b)),
like_x AS (SELECT matrix, u.l AS a, b, v FROM known, (SELECT unnest(['U', 'O']) AS l) u WHERE a = 'X'),
more AS (SELECT * FROM known UNION ALL SELECT * FROM like_x UNION ALL SELECT matrix, b, a, v FROM like_x),
both_x AS (SELECT matrix, p.l AS a, q.l AS b, v FROM known, (SELECT unnest(['U', 'O']) AS l) p, (SELECT unnest(['U', 'O']) AS l) q WHERE a = 'X' AND b = 'X'),
no_j AS (SELECT * FROM more UNION ALL SELECT * FROM both_x),
j AS (SELECT matrix, b, sign(avg(v)) * floor(abs(avg(v)) + 0.5) AS v FROM no_j WHERE a IN ('I', 'L') GROUP BY matrix, b),
jj AS (SELECT matrix, sign(avg(v)) * floor(abs(avg(v)) + 0.5) AS v FROM j WHERE b IN ('I', 'L') GROUP BY matrix),
letters AS (SELECT * FROM no_j UNION ALL SELECT matrix, 'J', b, v FROM j UNION ALL SELECT matrix, b, 'J', v FROM j UNION ALL SELECT matrix, 'J', 'J', v FROM jj),
ends AS (SELECT DISTINCT matrix, a FROM letters)
SELECT matrix, a, b, CAST(v AS INTEGER) AS score FROM (SELECT * FROM letters
  UNION ALL SELECT matrix, a, '*', star FROM ends JOIN star USING (matrix) UNION ALL SELECT matrix, '*', a, star FROM ends JOIN star USING (matrix)
  UNION ALL SELECT matrix, '*', '*', 1 FROM star)"""
)
def substitution_scores(spark, sf_dir):
    """All seven matrices as a table; the oracle follows the rules from the same fixed values, ``matrix_cells`` holds published cells."""
    rows = [(name, a, b, m.score(a, b)) for name, (of, n) in MATRICES.items() for m in (of(n),) for a in m.letters for b in m.letters]
    return spark.createDataFrame(rows, "matrix string, a string, b string, score int")


# Published scores of pairs of letters, for each matrix.
CELLS = {
    "blosum30": "AA 4 WW 20 CC 17 HH 14 PP 11 NW -7 DE 1 BN 4 ZE 5 JJ 4 OA 0 X* -7 ** 1",
    "blosum45": "AA 5 WW 15 CC 12 HH 10 YF 3 IV 3 BB 4 BZ 2 JL 4 UW -2 A* -5 ** 1",
    "blosum62": "AA 4 WW 11 CC 9 HH 8 HA -2 IL 2 KR 2 BD 4 ZQ 3 XX -1 XZ -1 JI 3 OS 0 O* -4 A* -4 ** 1",
    "pam40": "AA 6 CC 9 WW 13 CW -14 EW -15 IL -1 JI 4 BN 6 XX -4 A* -15 ** 1",
    "pam120": "AA 3 WW 12 WY -2 PS 1 BC -6 FY 4 JK -4 ZE 4 XW -5 R* -8 ** 1",
    "pam200": "AA 3 AT 1 CC 12 CF -6 CN -5 IR -2 NT 0 QV -3 EW -9 MY -3 BB 3 WW 18 JJ 5 K* -9 ** 1",
    "pam250": "AA 2 WW 17 CC 12 II 5 GP 0 PW -6 QS -1 RV -2 BX -1 QX -1 FY 7 JK -3 T* -8 ** 1",
}
CELL_ROWS = [(name, cells[k][0], cells[k][1], int(cells[k + 1])) for name, text in CELLS.items() for cells in (text.split(),) for k in range(0, len(cells), 2)]


@query("SELECT matrix, a, b, CAST(score AS INTEGER) AS score FROM (VALUES " + ", ".join(map(str, CELL_ROWS)) + ") t(matrix, a, b, score)")
def matrix_cells(spark, sf_dir):
    """Scores of the pairs in CELLS, each taken from the pair turned round as well; a matrix that isn't symmetric there would give two rows."""
    rows = [(name, a, b, m.score(*pair)) for name, a, b, _ in CELL_ROWS for m in (MATRICES[name][0](MATRICES[name][1]),) for pair in ((a, b), (b, a))]
    return spark.createDataFrame(rows, "matrix string, a string, b string, score int").distinct()


# --- tables of single operators


@query(
    """SELECT kind, mol_type, letters, ambiguous, CAST(length(letters) AS INTEGER) AS n FROM (VALUES
  ('dna', 'dna', 'acgt', 'n'), ('dna_gapped', 'dna', '-acgt', 'n'), ('dna_redundant', 'dna', '-acgtrykmswbdhvn', 'n'),
  ('rna', 'rna', 'acgu', 'n'), ('rna_gapped', 'rna', '-acgu', 'n'), ('rna_redundant', 'rna', '-acgurykmswbdhvn', 'n'),
  ('protein', 'protein', '-abcdefghijklmnpqrstvwxyz*', 'x')) t(kind, mol_type, letters, ambiguous)"""
)
def alphabet_kinds(spark, sf_dir):
    rows = [(kind, a.mol_type, a.letters, a.ambiguous, len(a)) for kind, a in ALPHABETS.items()]
    return spark.createDataFrame(rows, "kind string, mol_type string, letters string, ambiguous string, n int")


@query(
    """WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents),
a AS (SELECT c, ord(c) AS k FROM c WHERE c BETWEEN '!' AND '~')
SELECT c, CASE WHEN k >= 64 THEN k - 64 END AS illumina_1_3, CAST(round(10 * log10(pow(10.0, (k - 64) / 10.0) + 1)) AS INTEGER) AS solexa,
  CASE WHEN k BETWEEN 64 AND 104 THEN chr(CAST(64 + CASE WHEN k = 64 THEN -5 ELSE round(10 * log10(nullif(pow(10.0, (k - 64) / 10.0) - 1, 0))) END AS INTEGER)) END AS as_solexa FROM a"""
)
def quality_letters(spark, sf_dir):
    """Letters of other encodings; those under an encoding's range have no score."""
    c = F.col("c")
    letters = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).distinct().where("c between '!' and '~'")
    score = quality.decode_phred(c, "illumina_1_3", strict=False)
    return letters.select(
        "c",
        score.alias("illumina_1_3"),
        quality.decode_phred(c, "solexa").alias("solexa"),
        F.when(score.between(0, 40), quality.encode_phred(score, "solexa")).alias("as_solexa"),
    )


@query(
    f"""{SHORT}, v AS (SELECT item_id, list_transform(string_split(left(t, length(t) - 1), ''), lambda c: instr('ACGT', c) - 1) || [2, 2, 2] AS v FROM b WHERE length(t) > 1)
SELECT item_id, CAST(len(v) AS BIGINT) AS n, CAST(list_sum(v) - v[2] + 3 AS BIGINT) AS sum_after_set, CAST(v[len(v)] AS BIGINT) AS last, CAST(3 AS BIGINT) AS second FROM v"""
)
def bit_updates(spark, sf_dir):
    """Values appended before packing, and one replaced after it."""
    enc, ranks = BitEncoding(2), RankTransform("ACGT")
    rows = short_texts(spark, sf_dir).where("length(t) > 1").select("item_id", ranks.transform(F.rtrim("t", F.lit("$"))).alias("v"))
    rows = rows.select("item_id", enc.push(F.col("v"), F.lit(2), F.lit(3)).alias("v")).select("item_id", enc.pack(F.col("v")).alias("b"), F.size("v").alias("n"))
    rows = rows.withColumn("c", enc.set(F.col("b"), F.col("n"), F.lit(1), F.lit(3)))
    c, n = F.col("c"), F.col("n")
    return rows.select(
        "item_id",
        n.cast("long").alias("n"),
        F.aggregate(enc.unpack(c, n), F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_after_set"),
        enc.get(F.col("b"), n, n - 1).alias("last"),
        enc.get(c, n, F.lit(1)).alias("second"),
    )


@query(f"{SA_SQL} SELECT item_id, list(CAST(p AS BIGINT) ORDER BY r) AS sa FROM r GROUP BY item_id")
def integer_suffix_arrays(spark, sf_dir):
    rows = short_texts(spark, sf_dir).select("item_id", RankTransform("$ACGT").transform(F.col("t")).alias("ranks"))
    return rows.select("item_id", fulltext.suffix_array_ints("ranks").alias("sa"))


@query(
    f"""{SA_SQL}, w AS (SELECT item_id, string_agg(c, '' ORDER BY r) AS bwt FROM r GROUP BY item_id),
m AS (SELECT item_id, bwt, unnest(range(0, length(bwt), 32)) AS r FROM w), l AS (SELECT unnest(['$', 'A', 'C', 'G', 'T']) AS letter)
SELECT item_id, CAST(r AS INTEGER) AS r, letter, CAST(r + 1 - length(replace(left(bwt, r + 1), letter, '')) AS BIGINT) AS n FROM m, l WHERE contains(left(bwt, r + 1), letter)"""
)
def occ_samples(spark, sf_dir):
    return fulltext.occ_checkpoints(_indexed(spark, sf_dir), "item_id", "bwt", 32).select("item_id", F.col("r").cast("int").alias("r"), "letter", "n")


@query(
    f"""{SHORT}, s AS (SELECT item_id, left(t, length(t) - 1) AS s FROM b),
c AS (SELECT item_id, s, unnest(range(0, length(s))) AS p FROM s),
k AS (SELECT item_id, p, substr(s, p + 1, 3) AS codon FROM c),
o AS (SELECT a.item_id, a.p AS start, min(z.p) + 3 AS stop FROM k a JOIN k z ON a.item_id = z.item_id AND a.codon = 'ATG' AND z.codon IN ('TGA', 'TAG', 'TAA') AND z.p >= a.p AND z.p % 3 = a.p % 3 GROUP BY ALL)
SELECT item_id, 'orf' AS kind, CAST(start AS BIGINT) AS at, CAST(stop AS BIGINT) AS value FROM o WHERE stop - 2 - start > 6
UNION ALL SELECT item_id, 'match', CAST(p AS BIGINT), NULL FROM c WHERE substr(s, p + 1, 3) = 'GAA'
UNION ALL SELECT item_id, 'qgram', CAST(p AS BIGINT), CAST((instr('ACGT', substr(s, p + 1, 1)) - 1) * 4 + instr('ACGT', substr(s, p + 2, 1)) - 1 AS BIGINT) FROM c WHERE p < length(s) - 1"""
)
def sql_tables(spark, sf_dir):
    """Table functions of SQL: reading frames, matches and q-grams."""
    from strandlake.plans import sql as names

    names.register(spark)
    view = f"items_{uuid.uuid4().hex}"
    short_texts(spark, sf_dir).select("item_id", F.rtrim("t", F.lit("$")).alias("s")).createOrReplaceTempView(view)
    return spark.sql(
        f"""SELECT item_id, 'orf' AS kind, o.start AS at, o.end AS value FROM {view}, LATERAL reading_frames(s, 'ATG', 'TGA,TAG,TAA', 6) o
        UNION ALL SELECT item_id, 'match', m.position, NULL FROM {view}, LATERAL matches(s, 'GAA') m
        UNION ALL SELECT item_id, 'qgram', q.position, q.qgram FROM {view}, LATERAL qgrams(s, 'ACGT', 2) q"""
    )
