"""Each operator against a plain version of itself, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from oracle import DATA
from strandlake.llm import chat, common, decontaminate, graph, jaccard, langid, linededup, packing, pii, tokens, topk, toxicity
from strandlake.llm.common import Scratch

LARGE = "/root/testdata/sf0.1"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, sig long, _leak int, _copy int, _doc int, _keys int, n_lines int"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, *[1] * 6) for i, t in zip(ids, texts)], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


# 1


def test_decontamination(spark):
    rng = random.Random(1)
    items = [prose(rng, 40, 5000) for _ in range(6)] + ["Only three words", None, "", "  ", prose(rng, 5, 5000)]
    texts = [prose(rng, 300, 5000) for _ in range(20)] + [None, "", "ONLY three\twords", "x" * 50_000]
    texts += [f"{prose(rng, 900, 5000)} {items[0].upper()} {prose(rng, 900, 5000)}", " ".join(items[1].split()[:36]), " ".join(items[1].split()[:30])]
    texts += [f"before only three words after {items[10]}", texts[-1]]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contained(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, b in enumerate(items):
            w = words(b)
            n = min(5, len(w))
            if n:
                s, d = shingle_set(b, n), shingle_set(t, n) if len(words(t)) >= n else set()
                if 5 * len(s & d) >= 4 * len(s):
                    want[i, k] = (len(s & d), len(s))
    assert got == want and len(want) >= 4
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert {r.item_id for r in decontaminate.contained(docs, bench, 6).collect()} == {k for _, k in want if len(words(items[k])) >= 6}
    assert decontaminate.contained(docs.limit(0), bench).count() == 0
    assert decontaminate.contained(docs, bench.limit(0)).count() == 0


# 2


def plain_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 3 or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [prose(rng, 8) for _ in range(30)] + ["short", "Ünï çödé line that is long enough"]
    rows = [(i, "\n".join(rng.choice(("", " ", "\t")) + (x.upper() if rng.random() < 0.2 else x) for x in rng.choices(pool, k=rng.randrange(6)))) for i in range(40)]
    rows += [(40, None), (41, ""), (41, pool[0]), (None, pool[0]), (42, "\n\n"), (43, "\n".join(pool * 50)), (5, rows[5][1])]
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.drop("n_lines").columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == plain_lines(rows)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard, part, layers", [(50_000, 100_000, 8), (2, 3, 2), (1, 1, 1)])
def test_line_index_is_reversible(spark, monkeypatch, shard, part, layers):
    """Small numbers: many shards, a hot key in many parts, filters made anew as keys come, tables put together."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard)
    monkeypatch.setattr(linededup, "PART_POSTINGS", part)
    monkeypatch.setattr(common, "PART_ROWS", part)
    monkeypatch.setattr(linededup, "LAYERS", layers)
    rng = random.Random(3)
    pool = [prose(rng, 8) for _ in range(12)]
    rows = [(i, "\n".join([pool[0], *rng.sample(pool[1:], 2)])) for i in range(20)]
    of = lambda r: docs_of(spark, [t for _, t in r], [i for i, _ in r])
    first = linededup.LineIndex.build(of(rows[:4]))
    first = first.insert(of(rows[:12]))
    both = first.insert(of(rows[8:]))
    assert shard > 2 or both.shards > 2
    back = both.delete(of(rows[12:]))
    again = back.insert(of(rows[12:]))
    refs = lambda x: sorted(map(tuple, x.refs.select("h1", "h2", "n_docs", "max_doc").collect()))
    assert refs(first) == refs(back) and refs(both) != refs(first)
    assert refs(both) == refs(linededup.LineIndex.build(of(rows))) == refs(again)
    for index, own in ((both, rows), (back, rows[:12]), (again, rows)):
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in index.apply(of(own)).collect()) == plain_lines(own)
        # the filters hold few keys beyond those found often
        postings = index.postings
        passed = index._probed(postings).count()
        often = postings.join(index.refs.where("n_docs >= 3"), ["h1", "h2"]).count()
        assert often <= passed < postings.count()


def test_cuckoo_filter():
    rng = np.random.default_rng(4)
    h = rng.integers(-(2**63), 2**63 - 1, (3000, 2))
    f = linededup.Cuckoo(3000)
    f.insert(h[:, 0], h[:, 1])
    f = linededup.Cuckoo(state=f.to_bytes())
    assert f.contains(h[:, 0], h[:, 1]).all()
    f.delete(h[:1500, 0], h[:1500, 1])
    assert f.contains(h[1500:, 0], h[1500:, 1]).all() and f.contains(h[:1500, 0], h[:1500, 1]).mean() < 0.01
    tight = linededup.Cuckoo(10)
    tight.insert(h[:200, 0], h[:200, 1])  # more than it has room for
    assert linededup.Cuckoo(state=tight.to_bytes()).contains(h[:200, 0], h[:200, 1]).all() and tight.stash


# 3


@pytest.mark.parametrize("rows, queries, meet", [(4096, 128, 64), (16, 4, 2)])
def test_top_k(spark, monkeypatch, rows, queries, meet):
    for name, n in (("ROWS", rows), ("QUERIES", queries), ("MEET", meet)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=8) * (20 if i % 7 == 0 else 1)], 0) for i in range(130)]
    vectors += [(130, None, 0), (131, [1.0, None] * 4, 0), (132, [float("nan")] * 8, 0), (133, [float("inf")] * 8, 0), (134, vectors[3][1], 0), (None, vectors[3][1], 0), (135, [1e9] * 8, 1), (136, [], 0)]
    vectors += [(140, [1e30, -1e30] * 4, 1), (141, [-1e300] * 8, 1), (150, [1e12] * 3, 1), *[(200 + i, vectors[10][1], 0) for i in range(40)], *[(260, vectors[20][1], 0)] * 3]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 10 = 0"), 5).orderBy("rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    long = lambda x: max(-(2**63), min(2**63 - 1, x))
    q = [(i, [long(int(np.floor(256 * x))) if np.isfinite(256 * x) else (2**63 - 1) * int(np.sign(x)) - (x < 0) for x in v]) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i in sorted({i for i, _ in q if i % 10 == 0}):
        pairs = sorted((-long(sum(a * b for a, b in zip(u, v))), j) for own, u in q if own == i for j, v in q if j != i)[:5]
        assert got.pop(i) == [(n + 1, j, -s) for n, (s, j) in enumerate(pairs)], i
    assert not got
    assert topk.top_k(df.limit(0), df, 5).count() == 0
    assert topk.top_k(df, df.limit(0), 5).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).count() == 2


def test_threshold_prunes():
    """What no node collects isn't resolved; short rows aren't multiplied."""
    rng = np.random.default_rng(6)
    q, v = rng.integers(-9, 9, (20, 8)), rng.integers(-9, 9, (500, 8))
    cuts, whole = topk._slices(8), q @ v.T
    low = np.sort(whole, axis=1)[:, -5]
    r, c, total = topk._collected(q, v, cuts, low)
    assert len(r) < 0.3 * whole.size and (total == whole[r, c]).all()
    found = {(int(a), int(b)) for a, b, t in zip(r, c, total) if t >= low[a]}
    assert found == set(zip(*(x.tolist() for x in np.nonzero(whole >= low[:, None]))))
    assert not len(topk._collected(q, v, cuts, low * 20)[0])
    v[::3, :4] = 0  # too short for the first node
    low = np.sort(q @ v.T, axis=1)[:, -5]
    r, c, total = topk._collected(q, v, cuts, low)
    assert (total == (q @ v.T)[r, c]).all() and {*np.flatnonzero(((q @ v.T) >= low[:, None]).any(0))} <= {*c}


# 4


def test_levenshtein_automaton():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(6)
    terms = {"".join(rng.choices("abc", k=rng.randint(2, 5))): 1.0 for _ in range(30)}
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        w = "".join(rng.choices("abc", k=rng.randint(1, 6)))
        # the first letter is kept, edits come after it
        near = [t for t in terms if t[0] == w[0] and distance(t[1:], w[1:]) <= 1]
        assert trie.within_one(w) == (min(near) if near else None)


def test_first_letter_edits(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(16)
    terms = {"".join(rng.choices("abc", k=rng.randint(2, 5))): 1.0 for _ in range(30)}
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        w = "".join(rng.choices("abc", k=rng.randint(0, 6)))
        near = {t for t in terms if distance(t, w) <= 1}
        assert set(trie.near(w)) == near
        assert trie.first_edited(w) == min((t for t in near if t[0] != w[:1]), default=None)
    model = toxicity.Model({"idiot": 5.0, "stupid": 5.0}, {}, None)
    for word in ("1diot", "xidiot", "tupid"):
        direct, quoted = model.features(f"you are {word} today"), model.features(f'they said "{word}" and left')
        assert direct[toxicity.FIRST] > 0 and quoted[toxicity.FIRST + 1] > 0 and direct.sum() == direct[toxicity.FIRST]
    assert model.features("you are idiott today")[toxicity.FUZZY] > 0
    # learned where labels hold them; each misspelling is too rare to become a term itself
    texts = [prose(rng, 40) + " frumpish blorky zonkhead" * (i % 4 == 0) for i in range(200)]
    some = "abcdefghijklmnopqrstuvxyz0123456789"
    miss = lambda w: rng.choice(some) + w[rng.randrange(2) :]
    texts += [" ".join((prose(rng, 40), miss("frumpish"), miss("blorky"), miss("zonkhead"))) for _ in range(40)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i >= 200)) for i in range(240)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[i] == int(i % 4 == 0 or i >= 200) for i in range(240))


def test_toxicity(spark):
    rng = random.Random(7)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = prose(rng, 60).split()
        for _ in range(3 * bad):
            t.insert(rng.randrange(60), rng.choice(("frumpish", "blorky", "zonkhead")))
        texts.append(" ".join(t))
        labels.append((i, int(bad)))
    texts += [None, "", "the blorkyy one is a frumpsh", texts[0]]
    labels += [(600, None), (601, None), (None, 1), (4, 0), (4, 1)]
    docs, known = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(600))
    assert got[600].predicted == got[601].predicted == 0 and got[602].score > got[601].score
    direct, quoted = model.features("you are blorky today"), model.features('he said "blorky" and left')
    assert direct[0] > 0 and direct[1] == 0 and quoted[0] == 0 and quoted[1] > 0
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    none = toxicity.fit(docs, known.limit(0))
    assert {(r.score, r.predicted) for r in toxicity.score(docs, none).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_intercept_of_all_labels(spark, monkeypatch):
    rng = random.Random(17)
    docs = docs_of(spark, [prose(rng, 30) + " blorky" * (i % 6 == 0) for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int")
    learnable = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    n1 = sum(i % 6 == 0 for i in learnable)
    n0, fitted, plain = len(learnable) - n1, [], toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda *a: fitted.append(plain(*a)) or fitted[-1].copy())
    for toxic, clean, want in ((8000, 16000, 0.0), (20, 40, np.log(n1 / 20) - np.log(n0 / 40)), (8000, 40, -np.log(n0 / 40))):
        monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", toxic)
        monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", clean)
        model = toxicity.fit(docs, labels)
        assert np.isclose(model.weights[0] - fitted[-1][0], want) and (model.weights[1:] == fitted[-1][1:]).all()


# 5


def test_token_counts(spark):
    rng = random.Random(8)
    vocabulary = [b"a", b"b", b"ab", b"abc", b"bca", b"aabb", b"c"]
    for drop in (None, b"c"):
        own = [v for v in vocabulary if v != drop]
        auto = tokens.Automaton(sorted(own))
        for _ in range(2000):
            w = bytes(rng.choices(b"abc", k=rng.randint(1, 9)))
            n, at = 0, 0
            while at < len(w):
                best = max((len(v) for v in own if w.startswith(v, at)), default=0)
                if not best:
                    n = -1
                    break
                n, at = n + 1, at + best
            assert auto.count(w) == n, (w, drop)
    vocabulary = {b"a", b"b", b"ab", b"abc", b"c"}
    marked = [*map(tuple, vocabulary), *[(*v, tokens.END) for v in (b"a", b"bc", b"ca", b"abca")]]

    def greedy(w, entries):
        """Pieces of w, as entries with or without the mark at the end."""
        symbols, n, at = (*w, tokens.END), 0, 0
        while at < len(w):
            best = max((k for k in range(1, min(longest, len(symbols) - at) + 1) if symbols[at : at + k] in entries), default=0)
            if not best:
                return -1
            n, at = n + 1, at + best
        return n

    longest, auto = 5, tokens.Automaton(sorted(marked), marked=True)
    for _ in range(3000):
        w = bytes(rng.choices(b"abcd" if rng.random() < 0.1 else b"abc", k=rng.randint(1, 9)))
        assert auto.count(w) == greedy(w, set(marked)), w
    path = tokens.default_vocabulary()
    real, vocab = tokens.automaton(path), set(tokens.read_vocabulary(path))
    longest = max(map(len, vocab))
    for text in ("internationalisation", "naïve", "été", "日本語", "zzxqj", *prose(rng, 300, 9).split(), *("".join(rng.choices("aeinorstzqé", k=rng.randint(1, 14))) for _ in range(2000))):
        assert real.count(text.encode()) == greedy(text.encode(), vocab)
    texts = ["Hello, World!", None, "", " \n ", "a" * 30_000, "Hello, World!"]
    got = {r.doc_id: tuple(r)[1:] for r in tokens.token_counts(docs_of(spark, texts)).collect()}
    assert got[0] == got[5] and got[0][0] == 4 and got[1] == got[2] == got[3] == (0, 0, 0) and got[4][0] == 1 and got[4][1] > 100


# 6


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <turn> kind"), (1, 1, "user", "a\\l</turn>\nb\\b"), (1, 2, "assistant", "\\"), (2, 0, "user", None), (2, 1, None, "x"), (2, 1, "assistant", ""), (2, 1, "assistant", "")]
    rows += [(None, None, "user", "ü" * 20_000), (3, 0, "we\nird<role>\\n", "</turn>\n<turn>user\n"), (4, 1, "assistant", "late"), (4, 0, "user", "early")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    out = chat.format_chats(df)
    back = {r.conv_id: r for r in chat.parse_chats(out).collect()}
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in own.items():
        assert [(t.role, t.text) for t in back[c].turns] == [t[1:] for t in sorted(turns)]
        assert back[c].loss_text == "".join(t[2] for t in sorted(turns) if t[1] == "assistant")
    assert {c: r.valid for c, r in back.items()} == {1: True, 2: False, None: False, 3: False, 4: True}
    one = {r.conv_id: r for r in chat.digest(df).collect()}[4]
    assert one.turns_sha256 == hashlib.sha256(b"user\nearly\nassistant\nlate\n").hexdigest() and one.loss_chars == 4
    assert {c: r.valid for c, r in back.items()} == {r.conv_id: r.valid for r in chat.digest(df).collect()}
    plan = chat.digest(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "rejected" in plan  # the role machine is part of what runs
    assert chat.digest(df.limit(0)).count() == 0


# 7


def test_language_identification(spark):
    rng = random.Random(9)
    kinds = {"aa": "bakelomi", "bb": "xyzqvwtr", "cc": "éàçùonst"}
    texts, langs = [], []
    for i in range(300):
        lang = list(kinds)[i % 3]
        texts.append(" ".join("".join(rng.choices(kinds[lang], k=5)) for _ in range(30)))
        langs.append(lang)
    texts += [None, "", "123 456", "bakelo"]
    langs += ["aa", None, None, None]
    df = spark.createDataFrame([(i, t, lang, 1.0) for i, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(df)).collect()}
    assert all(got[i].lang_pred == langs[i] and 0 < got[i].score <= 1 for i in range(300))
    assert [(got[i].lang_pred, got[i].score) for i in (300, 301, 302)] == [("und", 0.0)] * 3 and got[303].lang_pred == "aa"
    none = langid.fit(df.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    whole = langid.ngram_counts("abcdefg " * 20)
    langid.CHUNK, before = 16, langid.CHUNK
    parts = langid.ngram_counts("abcdefg " * 20)
    langid.CHUNK = before
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_language_weights_by_brute_force(spark, monkeypatch):
    """Frequencies, vectors, steps of the leader and the temperature, each in plain Python."""
    rng = random.Random(23)
    texts = ["".join(rng.choices("abcdé ", k=rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "xyz"[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(df)

    def grams(t):
        """The places of the n-grams: each n-gram has one, found by asking for a text that holds it alone."""
        t, out = t.lower(), Counter()
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                known = places.get(t[i : i + n])
                if known is None:
                    whole = Counter(dict(zip(*(x.tolist() for x in langid.ngram_counts(t[i : i + n])))))
                    for m in range(1, n):
                        for j in range(n - m + 1):
                            whole[grams_of(t[i + j : i + j + m])] -= 1
                    (known,) = [k for k, v in whole.items() if v]
                    places[t[i : i + n]] = known
                out[known] += 1
        return out

    places = {}

    def grams_of(g):
        if g not in places:
            grams(g)
        return places[g]

    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 and any(map(str.isalpha, texts[i]))]
    df_count = Counter(k for i in learned for k in grams(texts[i]))
    for k, v in df_count.items():
        assert np.isclose(model.idf[k], np.log((1 + len(learned)) / (1 + v)) + 1)
    found, x = langid.weighted(texts[0], model.idf)
    plain = {k: (1 + np.log(v)) * model.idf[k] for k, v in grams(texts[0]).items()}
    size = np.sqrt(sum(v * v for v in plain.values()))
    assert dict(zip(found.tolist(), np.round(x, 12))) == {k: np.round(v / size, 12) for k, v in plain.items()}

    rows = [(np.array(sorted(rng.sample(range(6), 3))), np.array([rng.random() for _ in range(3)]), rng.randrange(3)) for _ in range(12)]
    weights, bias = langid.ftrl(rows, 3, 2)
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]  # place 6 is the bias

    def weight(k, c):
        l1 = 0.0 if k == 6 else langid.L1
        if abs(z[k][c]) <= l1:
            return 0.0
        sign = 1 if z[k][c] > 0 else -1
        return -(z[k][c] - sign * l1) / ((langid.BETA + n[k][c] ** 0.5) / langid.ALPHA + langid.L2)

    for _ in range(2):
        for at, x, y in rows:
            cells = [*zip(at.tolist(), x.tolist()), (6, 1.0)]
            w = {(k, c): weight(k, c) for k, _ in cells for c in range(3)}
            scores = [sum(v * w[k, c] for k, v in cells) for c in range(3)]
            e = [np.exp(s - max(scores)) for s in scores]
            for k, v in cells:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    sigma = ((n[k][c] + g * g) ** 0.5 - n[k][c] ** 0.5) / langid.ALPHA
                    z[k][c] += g - sigma * w[k, c]
                    n[k][c] += g * g
    assert np.allclose(weights[:6], [[weight(k, c) for c in range(3)] for k in range(6)]) and np.allclose(bias, [weight(6, c) for c in range(3)])
    assert not weights[6:].any()

    logits, y = np.random.default_rng(24).normal(size=(200, 3)) * 4, np.random.default_rng(25).integers(0, 3, 200)
    y = np.where(np.arange(200) % 3 > 0, logits.argmax(1), y)
    loss = lambda t: -np.mean([logits[i, c] / t - np.log(np.exp(logits[i] / t).sum()) for i, c in enumerate(y)])
    grid = np.exp(np.linspace(-3, 3, 601))
    assert loss(langid.fit_temperature(logits, y)) <= min(map(loss, grid)) + 1e-9
    # a small bound in bytes leaves a smaller sample, and a language has one document at least
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 1)
    assert langid.fit(df).languages == ["x", "y", "z"]


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test data here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{n}.parquet") for n in ("documents", "labels"))
    lang = langid.identify(docs, langid.fit(docs)).where("held_out").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    right, n = lang.selectExpr("sum(int(lang_pred = lang))", "count(*)").first()
    assert right >= 0.99 * n
    known = labels.where("toxic is not null").select("doc_id", "toxic")
    toxic = toxicity.score(docs, toxicity.fit(docs, labels)).where("held_out").join(known, "doc_id")
    rows = {(r.toxic, r.predicted): r["count"] for r in toxic.groupBy("toxic", "predicted").count().collect()}
    assert rows[1, 1] >= 0.9 * (rows[1, 1] + rows.get((1, 0), 0)) and rows.get((0, 1), 0) <= 0.01 * rows[0, 0]


# 8


def plain_components(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            x, y, j = sets[a], sets[b], rows[b][0]
            if x and y and den * len(x & y) >= num * len(x | y):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return Counter((i, len(s), top(i)) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize(
    "n, num, den, frequent, full, part",
    [(3, 90, 100, 64, 256, 100_000), (5, 80, 100, 64, 3, 100_000), (3, 90, 100, 2, 256, 2), (2, 60, 100, 2, 256, 100_000), (3, 90, 100, 1000, 2, 100_000), (2, 60, 100, 1000, 1, 2)],
)
def test_jaccard_join(spark, monkeypatch, n, num, den, frequent, full, part):
    """frequent 2: nearly every shared token is frequent, so that prefixes consist of combinations; full 1 to 3: single
    tokens' entries overflow, and tokens become frequent for those who index them; part 2: entries are joined in parts."""
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "FULL", full)
    monkeypatch.setattr(common, "PART_ROWS", part)
    rng = random.Random(n * num)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.choice((8, 9, 10, 11, 30, 120, 240)), 3000).split()
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 5))):
                own[rng.randrange(len(own))] = f"v{rng.randrange(3000)}"
            rows.append(" ".join(own))
    rows += [None, "", " \n", "one", "ONE", "one two", "x " * 5000, "x " * 4000, "ünï"]
    rows = list(enumerate(rows))
    got = jaccard.link(docs_of(spark, [t for _, t in rows]), n, num, den)
    assert Counter(map(tuple, got.collect())) == plain_components(rows, n, num, den)


@pytest.mark.parametrize("known", [True, False])
def test_jaccard_index_is_written_once(spark, monkeypatch, known):
    """A passage of 30 documents makes over-full entries where its tokens come early. The sketch puts them last; without it
    (known False) documents extend their prefixes, and only their entries are written and counted anew."""
    monkeypatch.setattr(jaccard, "FULL", 8)
    if not known:
        monkeypatch.setattr(jaccard.Join, "_sketch", lambda self, total: np.zeros(jaccard.BUCKETS, np.uint8), raising=False)
    made, scratch = [], common.Scratch.__call__
    monkeypatch.setattr(common.Scratch, "__call__", lambda self, df, name: made.append(name) or scratch(self, df, name))
    rng = random.Random(6)
    passage = prose(rng, 20, 10**6)
    rows = [f"{prose(rng, 40, 10**6)} {passage}" for _ in range(30)]
    rows += [x + " more" for x in rows[:3]] + [prose(rng, 40, 10**6) for _ in range(30)]
    got = jaccard.link(docs_of(spark, rows), 3, 90, 100)
    assert Counter(map(tuple, got.collect())) == plain_components(list(enumerate(rows)), 3, 90, 100)
    assert made.count("index") == 1 and ("full" in made) != known


def test_jaccard_edges(spark):
    long = prose(random.Random(1), 50, 5000)
    other = prose(random.Random(2), 50, 5000)
    # rows 7 and 7 are one node that ties two texts together; a row without doc_id links nothing
    df = docs_of(spark, [long, other, long, other, long], [7, 7, 3, 5, None])
    got = {r.doc_id: r.component_id for r in jaccard.link(df, 3, 90, 100).collect()}
    assert got == {7: 3, 3: 3, 5: 3, None: None}
    kept = jaccard.keep_one(df, 3, 90, 100)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 3), (True, None)]
    assert jaccard.link(df.limit(0), 3, 90, 100).count() == 0


def test_entries_give_their_tokens():
    rng = np.random.default_rng(21)
    t = rng.integers(0, 2**64, 500, dtype=np.uint64)
    assert (jaccard.unmix(jaccard.mix(t)) == t).all()
    assert (jaccard.entry_tokens(jaccard.mix(t ^ jaccard.SINGLE)) == t).all()


def test_shingle_sets():
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(30)) for _ in range(50)] + [None, "", "A\x0bb\x85c d", "é" * 3, " lead and trail "]
    sets = list(jaccard.shingle_sets(pa.array(texts), 3))
    assert [len(s) for s in sets] == [len(shingle_set(t, 3)) for t in texts]
    before, jaccard.PART = jaccard.PART, 40
    parts = list(jaccard.shingle_sets(pa.array(texts).slice(5), 3))
    jaccard.PART = before
    assert all((a == b).all() for a, b in zip(sets[5:], parts))


@pytest.mark.parametrize("part", [100_000, 3])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(common, "PART_ROWS", part)
    rng = random.Random(11)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    up = {i: i for e in edges for i in e}
    for _ in range(70):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: up[i] for i in linked}


# 9

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]]))


def test_personal_data(spark):
    rng = random.Random(12)
    for _ in range(4000):
        t = "".join(rng.choices("ab1 4.@+-()9é", k=rng.randint(0, 40)))
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == plain_spans(t), t
    texts = [None, "", "mail x.y@a.b.co or +1 (523) 555-1055, 4111 1111 1111 1111 at 10.0.0.255 not 10.0.0.256", "a" * 40_000 + "@b.c"]
    texts += ["IBAN: DE89 3704 0044 0532 0130 00.", "account number: 123-456-7890", "12 Old Street, or Calle 5", "https://me:pw@host/x"]
    got = {r.doc_id: r for r in pii.personal_data(docs_of(spark, texts)).collect()}
    assert (got[2].n_email, got[2].n_ip, got[2].n_card, got[2].n_phone) == (1, 1, 1, 1) and got[3].n_email == 1
    assert got[0].spans == got[1].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(pii.joined(plain_spans(texts[2])).encode()).hexdigest()
    kinds = [{s.split(":")[0] for s in got[i].spans.split(",")} for i in (4, 5, 6, 7)]
    assert "iban" in kinds[0] and "account" in kinds[1] and "street" in kinds[2] and "login" in kinds[3]


def test_identifiers_in_running_text():
    number, plain = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    for text in (f"IBAN: {number} for the rent.", f"IBAN: {plain} please", f"iban {number} x {plain}", f"iBaN {plain}", f"my IBAN {number}, thanks", f"IBAN {number} is what you asked me for, number by number"):
        found = [text[a:b] for kind, a, b in pii.find(text) if kind == "iban"]
        assert found == [number if number in text else plain], text
    # a longer end that happens to be valid as well gives way to the country's length
    longer = next(w for k in range(1000) if pii.iban_valid(plain + (w := f" a{k:03}")))
    assert ("iban", 5, 5 + len(plain)) in pii.find(f"IBAN {plain}{longer}")
    assert not [s for s in pii.find(f"IBAN: {plain}please and DE88 3704 0044 0532 0130 00 for it") if s[0] == "iban"]
    for cue in pii.ACCOUNT_CUES:
        for form in (cue, cue.upper(), cue.title(), cue.capitalize(), cue.swapcase()):
            assert ("account", len(form) + 1, len(form) + 9) in pii.find(f"{form} 12345678"), form
    assert pii.find("12 Old StReEt") == [("street", 0, 13)]
    assert pii.find("İ me@a.b Account Number 12345678") == [("email", 2, 8), ("account", 24, 32)]


# 10


def test_packing(spark):
    rng = random.Random(13)
    texts = [prose(rng, rng.choice((3, 40, 200, 700))) for _ in range(60)] + [None, "", "<|endoftext|> 日本語", " " * 3000, "x" * 9000, "same", "same"]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    rows = packing.pack_documents(docs_of(spark, texts, ids)).collect()
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in zip(ids, texts):
        own = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(own) % 1024 or 1024
        starts = [0, *range(first, len(own), 1024)]
        for k, a in enumerate(starts):
            part = own[a : starts[k + 1] if k + 1 < len(starts) else None]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= 1024
    small = sorted((r.length for r in rows), reverse=True)
    assert len(bins) <= len(packing.best_fit(small, 1024))
    assert packing.pack_documents(docs_of(spark, texts, ids).limit(0)).count() == 0
    plain = docs_of(spark, texts[:5])
    packed = packing.pack_documents(plain)
    assert sum(len(r.ids) for r in packing.with_ids(packed, plain).collect()) == sum(r.length for r in packed.collect())


def test_ids_of_both_libraries(spark):
    """Texts of plain letters take the faster library; its ids are those of the file."""
    tok, rng = packing.tokenizer(), random.Random(18)
    tok.ids("日")  # loads the other
    own = lambda t: tok.slow.encode(t, add_special_tokens=False).ids
    letters = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), 0x20AC)]
    for _ in range(3000):
        t = "".join(rng.choices(letters, k=rng.randrange(30))) + "".join(rng.choices(" \n\t'sStT0½a\xa0\x85\x1f", k=rng.randrange(20)))
        assert tok.ids(t) == own(t), t
    if os.path.isdir(DATA):
        texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").where("text is not null").collect()]
        assert all(tok.ids(t) == own(t) for t in texts)


@pytest.mark.parametrize("low, high, gain", [(200, 600, 5), (100, 700, 1)])
def test_genetic_packing_beats_best_fit(spark, low, high, gain):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(1500)] + [1024] * 3
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(pieces).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == Counter(enumerate(lengths))
    plain = len(packing.best_fit(sorted(lengths, reverse=True), 1024))
    found = len({r.sequence_id for r in rows})
    assert packing.least_bins(np.bincount(lengths, minlength=1025), 1024) <= found <= plain - gain


def test_least_bins():
    rng = random.Random(19)
    for _ in range(300):
        capacity = rng.choice((10, 11, 16))
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 8))]

        def fewest(left, bins):
            if not left:
                return len(bins)
            n, *rest = left
            return min([fewest(rest, [*bins[:k], r - n, *bins[k + 1 :]]) for k, r in enumerate(bins) if r >= n] + [fewest(rest, [*bins, capacity - n])])

        best = fewest(lengths, [])
        assert -(-sum(lengths) // capacity) <= packing.least_bins(np.bincount(lengths, minlength=capacity + 1), capacity) <= best
        assert len(packing.evolve(np.bincount(lengths, minlength=capacity + 1), [], capacity, 1, 30)[0]) >= best


def test_genetic_packing_keeps_every_piece():
    rng = random.Random(14)
    lengths = [rng.randint(1, 1023) for _ in range(800)]
    hist = np.bincount(lengths, minlength=1025)
    for bins in packing.evolve(hist, [], 1024, 1, 4):
        assert Counter(n for b in bins for n in b) == Counter(lengths) and max(map(sum, bins)) <= 1024
        assert packing.from_bytes(packing.to_bytes(bins)) == bins


# pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(15)
    bench = [prose(rng, 40, 9000) for _ in range(5)]
    texts, toxic = [], []
    for i in range(300):
        t = prose(rng, 80, 9000)
        toxic.append(i % 6 == 0)
        texts.append(t + " blorky zonkhead blorky" * toxic[-1])
    common = "this very line is found in many documents"
    for i in (1, 2, 3, 4):
        texts[i] += "\n" + common
    texts[7] += " " + bench[0]
    texts[9] = texts[8] + " more"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == corpus_pipeline.COLUMNS
        sizes.append({r.doc_id: r for r in now.collect()})
    clean = {i for i in range(300) if not toxic[i]}
    assert set(sizes[0]) == clean
    assert set(sizes[1]) == clean and [i for i in (1, 2, 3, 4) if common in sizes[1][i].text] == [4]
    assert all(r.n_chars == len(r.text) for r in sizes[1].values())
    assert set(sizes[2]) == clean - {9} and set(sizes[3]) == clean - {9, 7}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(sizes[3])


def test_pipeline_by_brute_force(spark, tmp_path):
    """All stages in plain Python, over rows of every kind."""
    rng = random.Random(22)
    bench = [prose(rng, 40, 9000) for _ in range(4)] + [None, ""]
    rows = []
    for i in range(160):
        t = prose(rng, rng.choice((4, 30, 80, 200)), 9000) + " blorky zonkhead blorky" * (i % 5 == 0)
        rows.append((i, t))
    common_lines = [f"{prose(rng, 9)} is found in many" for _ in range(3)]
    rows = [(i, "\n".join([t, *rng.sample(common_lines, rng.choice((0, 0, 1, 2)))])) for i, t in rows]
    rows += [(200 + i, " ".join(x if rng.random() > 0.01 else "changed" for x in rows[i][1].split(" "))) for i in range(1, 60, 2)]
    rows += [(300 + i, f"{prose(rng, 50, 9000)} {bench[i % 4].upper()}") for i in range(6)]
    rows += [(400, None), (401, ""), (402, " \n\n "), (403, "x " * 4000), (404, rows[7][1]), (404, rows[8][1]), (None, rows[9][1]), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)] + [(400, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    now = [(i, t) for i, t in rows if model.score(t) < 0.5]
    assert {i for i, _ in rows} - {i for i, _ in now} >= {i for i in range(160) if i % 5 == 0}
    now = [(i, kept) for i, _, _, kept in plain_lines(now).elements()]
    # a doc_id of two rows is one node that has both sets
    up = {i: i for i, _ in now}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingle_set(t, 5)) for i, t in now if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[max(top(i), top(j))] = min(top(i), top(j))
    now = [(i, t) for i, t in now if i is None or top(i) == i]
    items = [s for b in bench for s in [shingle_set(b, 5)] if s]
    leaked = {i for i, t in now if i is not None and any(5 * len(s & shingle_set(t, 5)) >= 4 * len(s) for s in items)}
    assert leaked and len(now) < len(rows)
    now = [(i, t) for i, t in now if i not in leaked]

    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, lengths = Counter(), []
    for i, t in now:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        for k, (a, n) in enumerate(packing.cut(len(ids))):
            want[i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += 1
            lengths.append(n)
    held = common.mark()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(a == sum(n for _, n in sorted(own)[:k]) and a + m <= 1024 for own in bins.values() for k, (a, m) in enumerate(sorted(own)))
    assert packing.least_bins(np.bincount(lengths, minlength=1025), 1024) <= len(bins) <= len(packing.best_fit(sorted(lengths, reverse=True), 1024))
    # two tables are left, which the result reads, and they go when asked
    assert common.mark() - held == 2
    common.release(spark, held)
    assert common.mark() == held


def test_nothing_is_left(spark, tmp_path):
    """Files of the shared folder, once a result has been read and released."""
    docs = docs_of(spark, [prose(random.Random(i % 3), 60) for i in range(9)])
    folder = common.shared_dir(spark)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs}
    common.release(spark)
    before = files()
    items = docs.selectExpr("doc_id as item_id", "text").limit(1)
    for result in (linededup.dedup_lines, lambda d: jaccard.link(d, 3, 90, 100), packing.pack_documents, lambda d: decontaminate.clean(d, items)):
        result(docs).collect()
        assert files() > before
        common.release(spark)
        assert files() == before
