"""Goldens and properties of the sequence functions, operators and sources."""

import os
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment_fields as af
from strandlake.functions import composition, distance, matching, quality
from strandlake.functions.alphabet import ALPHABETS, AMINO_ACIDS, amino_acid_code, amino_acid_letter, three_letter
from strandlake.functions import ranks as ranks_module
from strandlake.functions.ranks import BitEncoding, RankTransform
from strandlake.operators import align, fulltext, length_stats, matrices, orf
from strandlake.operators.dictionary import resolve
from strandlake.operators.stored import fresh
from strandlake.plans import sql as names
from strandlake.sources import bam, bgzf, fastx, sam
from strandlake.streaming import lengths


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_alphabets(spark):
    dna, wide = ALPHABETS["dna"], ALPHABETS["dna_redundant"]
    r = one(
        spark,
        a=dna.reverse_complement(F.lit("AACG")),
        b=wide.complement(F.lit("r")),
        c=dna.first_invalid(F.lit("ACGTxA")),
        d=dna.first_invalid(F.lit("")),
        e=three_letter(F.lit("W")),
        f=three_letter(F.lit("*")),
        g=dna.complement_letter(F.lit("z")),
        h=ALPHABETS["protein"].index(F.lit("o")),
        i=dna.letter(F.lit(2)),
        j=F.concat(*(amino_acid_letter(amino_acid_code(F.lit(c))) for c in AMINO_ACIDS.lower())),
    )
    assert tuple(r) == ("CGTT", "y", 4, None, "Trp", "Ter", None, None, "g", AMINO_ACIDS)


def test_quality(spark):
    r = one(
        spark,
        a=quality.decode_phred(F.lit("I"), "sanger"),
        b=quality.phred_from_probability(F.lit(0.01)),
        c=quality.phred_from_probability(F.lit(0.0)),
        d=quality.solexa_to_phred(quality.phred_to_solexa(F.lit(30))),
        e=quality.phred_to_solexa(F.lit(0)),
        f=quality.encode_phred(F.lit(40), "illumina_1_3"),
        g=quality.error_probability(F.lit(20)),
    )
    assert tuple(r) == (40, 20, 255, 30, -5, "h", 0.01)


def test_flags_cigar_aux(spark):
    ops = af.cigar(F.lit("8M2I5M"))
    r = one(spark, f=af.flags(F.lit(99)), v=af.flag_value(af.flags(F.lit(99 + 4096))), q=af.query_length(ops), s=af.reference_length(ops), e=F.size(af.cigar(F.lit("*"))))
    assert [k for k, v in r.f.asDict().items() if v] == ["paired", "proper_pair", "mate_reverse", "read1"] and tuple(r)[1:] == (99, 15, 13, 0)
    x = af.aux_fields(F.lit("XA:A:P\tXF:f:3.5\tXB:B:c,1,-2,3\tMD:Z:a:b"))
    r = one(spark, a=af.aux_get(x, "XA")["c"], f=af.aux_get(x, "XF")["f"], b=af.array_ints(af.aux_get(x, "XB")), z=af.aux_get(x, "MD")["s"], n=af.aux_get(x, "QQ")["s"])
    assert tuple(r) == ("P", 3.5, [1, -2, 3], "a:b", None)
    for bad in ("M", "10", "5Q", "99999999999M"):
        with pytest.raises(Exception, match="bad CIGAR"):
            one(spark, x=af.cigar(F.lit(bad)))


def test_ranks_and_bits(spark):
    t = RankTransform("ACGTacgt")
    assert t.width == 3 and RankTransform("A").width == 0
    r = one(spark, a=t.transform(F.lit("aAcCgGtT")), b=t.qgrams(2, F.lit("ACGT")), c=t.qgrams(5, F.lit("ACGT")), d=RankTransform("ACGT").qgrams(32, F.lit("T" * 32)))
    assert tuple(r) == ([4, 0, 5, 1, 6, 2, 7, 3], [1, 10, 19], [], [-1])
    for w in range(1, 9):
        e = BitEncoding(w)
        values = [(3 * k + 1) & e.mask for k in range(70)]
        v = F.array(*map(F.lit, values))
        b = e.pack(v)
        r = one(spark, u=e.unpack(b, F.lit(70)), n=F.size(b), m=e.blocks_for(F.lit(70)), x=e.get(b, F.lit(70), F.lit(70)), s=e.get(e.set(b, F.lit(70), F.lit(5), F.lit(1)), F.lit(70), F.lit(5)))
        assert r.u == values and r.n == r.m == -(-70 // (32 // w)) and r.x is None and r.s == 1


def test_optional_fields_are_matched_once(spark):
    """One regular expression for each field, not one for each member of its struct; BAM files are dealt evenly, few rows a file."""
    from strandlake.plans import registry

    df = spark.createDataFrame([("NM:i:3\t\tMD:Z:\tXB:B:c,1,,2",), ("",), (None,)], "t string")
    plan = df.select(af.aux_fields(F.col("t")).alias("x"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1
    assert [None if r.x is None else [(f.tag, f.type, f.i, f.s, f.sub, f.arr) for f in r.x] for r in plan.collect()] == [
        [("NM", "i", 3, None, None, None), ("MD", "Z", None, "", None, None), ("XB", "B", None, None, "c", ["1", "2"])], [], None
    ]
    for bad in ("NM:i:", "NM:q:1", "NM"):
        with pytest.raises(Exception, match="bad optional field"):
            one(spark, x=af.aux_fields(F.lit(bad)))
    few = registry._dealt(spark.range(0, 40, numPartitions=1))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    before, registry.FILE_ROWS = registry.FILE_ROWS, 5
    try:
        assert registry._dealt(spark.range(0, 40, numPartitions=1)).rdd.getNumPartitions() == 8
    finally:
        registry.FILE_ROWS = before


def test_bits_of_many_rows(spark):
    """No lambda runs for each letter; nulls, empty arrays and sizes beyond the blocks are as before."""
    rng, e = random.Random(6), BitEncoding(3)
    rows = [[rng.randrange(-9, 99) for _ in range(rng.randrange(40))] for _ in range(50)] + [None, [], [1, None, 2], [7] * 10 + [None]]
    df = spark.createDataFrame([(i, v, None if v is None else "".join("ACGT"[(x or 0) % 4] for x in v)) for i, v in enumerate(rows)], "i int, v array<int>, t string")
    df = df.withColumn("b", e.pack(F.col("v"))).select("*", e.unpack(F.col("b"), F.lit(12)).alias("u"), e.unpack(F.col("b"), F.when(F.col("i") < 3, F.col("i") - 1)).alias("w"), RankTransform("ACGT").transform(F.col("t")).alias("r"))
    for r in df.collect():
        parts = [] if r.v is None else [r.v[k : k + 10] for k in range(0, len(r.v), 10)]
        blocks = [None if None in p else sum((x & 7) << 3 * k for k, x in enumerate(p)) for p in parts]
        assert r.b == (None if r.v is None else blocks)
        assert r.u == [blocks[k // 10] >> 3 * (k % 10) & 7 if k // 10 < len(blocks) and blocks[k // 10] is not None else None for k in range(12)]
        assert r.w == (r.u[: max(r.i - 1, 0)] if r.i < 3 else None)
        assert r.r == (None if r.t is None else ["ACGT".index(c) for c in r.t])
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="no rank for x"):
        one(spark, x=RankTransform("ACGT").transform(F.lit("ACxG")))


def test_length_stats(spark):
    def stats(*values):
        r = length_stats.length_stats(spark.createDataFrame([(v,) for v in values], "n long"), F.col("n")).first()
        return r.asDict()

    assert stats(10, 20, 30)["q2"] == 20
    s = stats(2, 3, 4, 8, 2, 8, 3, 2)
    assert (s["n50"], s["l50"], s["count"], s["sum"]) == (8, 1, 8, 32)
    s = stats(*range(1, 8))
    assert (s["q1"], s["q2"], s["q3"]) == (2.5, 4.0, 5.5)
    s = stats(10, 20, 30, 40)
    assert (s["q1"], s["q2"], s["q3"]) == (15.0, 25.0, 35.0)
    assert set(stats().values()) == {0}


def test_composition(spark):
    r = one(spark, a=composition.gc_count(F.lit("GGCCatAT")), b=composition.gc_content(F.lit("GATATACA")), c=composition.gc3_content(F.lit("GATATACA")), d=composition.gc_content(F.lit("")), e=composition.count_any(F.lit("banana"), "anna"))
    assert r.a == 4 and r.b == 0.25 and abs(r.c - 2 / 3) < 1e-6 and np.isnan(r.d) and r.e == 5


def test_distances(spark):
    r = one(spark, h=distance.hamming(F.lit("GTCTGCATGCG"), F.lit("TTTAGCTAGCG")), l=distance.levenshtein(F.lit("ACCGTGGAT"), F.lit("AAAAACCGTTGAT")), k=distance.bounded_levenshtein(F.lit("ACCGTGGAT"), F.lit("AAAAACCGTTGAT"), 5), n=distance.bounded_levenshtein(F.lit("ACCGTGGAT"), F.lit("AAAAACCGTTGAT"), 4), b=distance.levenshtein(distance.as_bytes(F.lit("äö")), F.lit("ab")))
    assert tuple(r) == (5, 5, 5, None, 4)


def test_matching(spark):
    for text, pattern, want in (
        ("ACGGCTAGAAAAGGCTAGAAAA", "GAAAA", [7, 17]),
        ("ACGGCTAGGAAAAAGACTGAGGACTGAAAA", "GAAAA", [8, 25]),
        ("CCTCCTCCC", "CC", [0, 3, 6, 7]),
        ("aaaaabbabbbbbbbabbab", "abbab", [4, 15]),
        ("ab", "abc", []),
    ):
        r = one(spark, a=matching.find_all(F.lit(text), pattern), n=matching.count(F.lit(text), pattern), c=matching.contains(F.lit(text), pattern))
        assert r.a == want and r.n == len(want) and r.c == bool(want)
    with pytest.raises(ValueError):
        matching.find_all(F.lit("a"), "")
    assert matching.kmp_borders("ababaca") == [0, 0, 1, 2, 3, 0, 1]
    assert matching.horspool_shifts("AACB") == {"A": 2, "C": 1}
    rng = random.Random(1)
    for _ in range(200):
        p, t = "".join(rng.choices("ab", k=rng.randint(1, 5))), "".join(rng.choices("ab", k=30))
        state, hits = 0, []
        for i, c in enumerate(t):
            state = matching.kmp_delta(p, state, c)
            if state == len(p):
                hits.append(i - len(p) + 1)
        assert hits == [i for i in range(len(t)) if t.startswith(p, i)]
        masks, accept = matching.shift_and_masks(p)
        state, found = 0, []
        for i, c in enumerate(t):
            state = (state << 1 | 1) & masks.get(c, 0)
            if state & accept:
                found.append(i - len(p) + 1)
        assert found == hits
        oracle = matching.factor_oracle(p)
        for a in range(len(p)):
            for b in range(a, len(p)):
                k = 0
                for c in p[::-1][a : b + 1]:
                    k = oracle[k][c]


def test_orfs(spark):
    def found(s):
        return [tuple(x) for x in one(spark, x=orf.open_reading_frames(F.lit(s), ["ATG"], ["TGA", "TAG", "TAA"], 5)).x]

    assert found("ACGGCTAGAAAAGGCTAGAAAA") == []
    assert found("GGGATGGGGTGAGGG") == [(3, 12, 0)]
    assert found("ATGGGGATGGGGGGATGGAAAAATAAGTAG") == [(14, 26, 2), (0, 30, 0), (6, 30, 0)]
    rng = random.Random(2)
    for _ in range(20):
        s = "".join(rng.choices("ATG", k=60))
        want = []
        for p in range(len(s) - 2):
            if s[p : p + 3] == "ATG":
                stop = next((q for q in range(p, len(s) - 2, 3) if s[q : q + 3] in ("TGA", "TAG", "TAA")), None)
                if stop is not None and stop + 3 - p - 2 > 5:
                    want.append((p, stop + 3, p % 3))
        assert found(s) == sorted(want, key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("of", ["find_patterns", "find_orfs"])
def test_long_texts_go_in_small_batches(spark, of):
    """A text goes to one function once, few rows at once; rows without a text have no match."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        texts = [(0, "AAAATGCCCTAAGATGAAATGA"), (1, None), (2, ""), (3, "CCGG")]
        df = spark.createDataFrame(texts, "id int, s string")
        if of == "find_patterns":
            found = matching.find_patterns(df, "s", ["AA", "ATG", "GG"])
            want = [(i, s, p, k) for i, s in texts for p in ("AA", "ATG", "GG") for k in range(len(s or "")) if s.startswith(p, k)]
        else:
            found = orf.find_orfs(df, "s", ["ATG"], ["TGA", "TAA"], 5)
            want = [(0, texts[0][1], 3, 12, 0), (0, texts[0][1], 13, 22, 1)]
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert spark.conf.get(key) == "1000"
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1
    finally:
        spark.conf.set(key, before)


def test_fulltext(spark):
    rng = random.Random(3)
    texts = ["GCCTTAACATTATTACGCCTA$", "TGTGTGTGTG$", "$"] + ["".join(rng.choices("AC", k=rng.randint(1, 60))) + "$" for _ in range(10)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("sa", fulltext.suffix_array("t"))
    df = df.withColumn("bwt", fulltext.bwt(F.col("t"), F.col("sa"))).withColumn("lcp", fulltext.lcp("t", "sa")).withColumn("back", fulltext.invert_bwt("bwt"))
    for r in df.collect():
        order = sorted(range(len(r.t)), key=lambda p: r.t[p:])
        assert r.sa == order and r.back == r.t and r.bwt == "".join(r.t[p - 1] for p in order)
        assert r.lcp[0] == r.lcp[-1] == -1
        for k in range(1, len(order)):
            a, b = r.t[order[k] :], r.t[order[k - 1] :]
            assert r.lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    first = df.where(F.col("t") == texts[0])
    hit = lambda p: first.select(fulltext.backward_search(F.col("bwt"), F.lit(p)).alias("h"), "sa").select("h", fulltext.occurrences(F.col("sa"), F.col("h")).alias("o")).first()
    assert hit("TTA").o == [3, 12, 9] and hit("TTA").h.kind == "complete"
    assert hit("").h.kind == "absent" and (hit("AAA").h.kind, hit("AAA").h.len) == ("partial", 2) and hit("X").h.kind == "absent"
    r = spark.range(1).select(fulltext.bwt_find(F.lit("cabca$")).alias("f"), fulltext.less(F.lit("CAB")).alias("l"), fulltext.suffix_array_ints(F.array(*map(F.lit, (3, 2, 2, 0)))).alias("i")).first()
    assert r.f == [5, 1, 4, 2, 0, 3] and r.l[ord("C")] == 2 and r.i == [3, 2, 1, 0]
    text = "".join(rng.choices("ACGT", k=80)) + "$"
    rows = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(text)], "pos long, rank long")
    got = [r.pos for r in fulltext.suffix_array_rows(rows).orderBy("rank").collect()]
    assert got == sorted(range(len(text)), key=lambda p: text[p:])


def best_score(x, y, s):
    @lru_cache(None)
    def go(i, j, last):
        best = (0 if i == len(x) else s.xclip_suffix) + (0 if j == len(y) else s.yclip_suffix)
        if i < len(x) and j < len(y):
            best = max(best, (s.scores.match if x[i] == y[j] else s.scores.mismatch) + go(i + 1, j + 1, ""))
        if i < len(x):
            best = max(best, (s.gap_extend if last == "i" else s.gap_open) + go(i + 1, j, "i"))
        if j < len(y):
            best = max(best, (s.gap_extend if last == "d" else s.gap_open) + go(i, j + 1, "d"))
        return best

    starts = [(i, j) for i in range(len(x) + 1) for j in range(len(y) + 1)]
    return max((s.xclip_prefix if i else 0) + (s.yclip_prefix if j else 0) + go(i, j, "") for i, j in starts)


def replayed(r, x, y, s):
    """The score of the operations, from the start of both sequences."""
    i = j = total = 0
    last, cell = "", {"ins": (1, 0), "del": (0, 1), "match": (1, 1), "subst": (1, 1)}
    for k, (op, n) in enumerate(r["operations"]):
        if op in cell:
            if op in ("match", "subst"):
                assert (x[i] == y[j]) == (op == "match")
                total += s.scores.match if op == "match" else s.scores.mismatch
            else:
                total += s.gap_extend if last == op else s.gap_open
            i, j = i + cell[op][0], j + cell[op][1]
        else:
            prefix = not any(o in cell for o, _ in r["operations"][:k]) and (i == 0 if op == "xclip" else j == 0) and any(o in cell for o, _ in r["operations"][k:])
            total += getattr(s, f"{op}_{'prefix' if prefix else 'suffix'}")
            i, j = (i + n, j) if op == "xclip" else (i, j + n)
        last = op
    assert (i, j) == (len(x), len(y))
    return total


def test_alignment(spark):
    plain = align.Scoring(-5, -1, align.MatchScore(1, -1))
    a = align.Aligner(plain)
    r = a.align("ACCGTGGAT", "AAAAACCGTTGAT", "local")
    assert (r["score"], r["xstart"], r["ystart"], r["xend"], r["yend"]) == (7, 0, 4, 9, 13) and [o for o, _ in r["operations"]] == ["match"] * 5 + ["subst"] + ["match"] * 3
    r = a.align("ACCGTGGAT", "AAAAACCGTTGAT", "global")
    assert [o for o, _ in r["operations"]] == ["del"] * 4 + ["match"] * 5 + ["subst"] + ["match"] * 3
    rng = random.Random(4)
    for _ in range(250):
        x, y = ("".join(rng.choices("ACG", k=rng.randint(1, 7))) for _ in "xy")
        e = -rng.randint(0, 3)
        s = align.Scoring(e - rng.randint(0, 4), e, align.MatchScore(rng.randint(1, 3), -rng.randint(0, 3))).xclip(-rng.randint(1, 6)).yclip(-rng.randint(1, 6))
        for mode in ("global", "semiglobal", "local", "custom"):
            got = align.Aligner(s).align(x, y, mode)
            assert got["score"] == best_score(x, y, s.for_mode(mode)), (x, y, s, mode)
            if mode in ("global", "custom"):
                assert replayed(got, x, y, s.for_mode(mode)) == got["score"], (x, y, s, got)
    f = align.alignment(plain, "semiglobal")
    r = spark.createDataFrame([("CCGTCCGG", "AACCGTCCGGTT"), (None, "A")], "x string, y string").select(f("x", "y").alias("r")).collect()
    assert r[0].r.score == 8 and r[0].r.ystart == 2 and r[0].r.operations[0].op == "match" and r[1].r.score is None


def test_matches_of_linear_forms(spark):
    rng = random.Random(20)
    texts = ["".join(rng.choices("ACGT", k=rng.randrange(60))) + "$" for _ in range(40)]
    df = spark.createDataFrame([(t, "".join(rng.choices("ACG", k=rng.randrange(1, 5)))) for t in texts] + [(None, "A"), ("A$", None)], "t string, p string")
    df = df.withColumn("sa", fulltext.suffix_array("t")).withColumn("b", fulltext.bwt("t", "sa"))
    for r in df.withColumn("hit", fulltext.backward_search("b", "p")).collect():
        if r.t is None or r.p is None:
            assert r.hit.kind is None
            continue
        sa = sorted(range(len(r.t)), key=lambda i: r.t[i:])
        assert r.sa == sa and r.b == "".join(r.t[i - 1] for i in sa)
        n = next((k for k in range(len(r.p), 0, -1) if r.p[-k:] in r.t), 0)
        rows = [k for k, i in enumerate(sa) if n and r.t[i:].startswith(r.p[-n:])]
        assert (r.hit.kind, r.hit.len) == (("absent", None) if not n else ("complete", None) if n == len(r.p) else ("partial", n))
        assert not n or (r.hit.lower, r.hit.upper) == (rows[0], rows[-1] + 1)
    for q in (1, 3, 11):
        got = {r.qgram: r.n for r in ranks_module.qgram_counts(df, "t", ranks_module.RankTransform("$ACGT"), q).collect()}
        want = Counter()
        for t in texts + ["A$"]:
            for i in range(len(t) - q + 1):
                want[sum("$ACGT".index(c) << 3 * (q - 1 - k) for k, c in enumerate(t[i : i + q]))] += 1
        assert got == want


def test_matrices():
    for n, want in ((40, 6), (120, 3), (200, 3), (250, 2)):
        m = matrices.pam(n)
        assert m.score("A", "A") == want and all(m.score(a, b) == m.score(b, a) for a in m.letters for b in m.letters)
    for m in map(matrices.blosum, (30, 45, 62)):
        assert all(m.score(a, b) == m.score(b, a) and m.score(a, "O") == m.score(a, "X") for a in m.letters for b in m.letters)
    m = matrices.blosum(62)
    # rows of the published table, in alphabetical order
    for c, row in (("B", "-2 4 -3 4 1 -3 -1 0 -3 -4 0 -4 -3 3 -1 -2 0 -1 0 -1 -1 -3 -4 -3 1 -1 -4"), ("J", "-1 -4 -1 -4 -3 0 -4 -3 3 3 -3 3 2 -3 -1 -3 -3 -3 -2 -1 -1 2 -3 -1 -3 -1 -4")):
        assert [m.score(c, x) for x in "ABCDEFGHIJKLMNOPQRSTUVWYZX*"] == [int(v) for v in row.split()]
    assert matrices.pam(250).score("W", "W") == 17 and matrices.pam(250).score("C", "C") == 12 and matrices.pam(120).score("W", "W") == 12
    m = matrices.Matrix.parse("# a comment\n   A  R  *\nA  4 -1 -4\nR -1  5 -4\n* -4 -4  1\n")
    assert m.score("A", "R") == -1 and m.score("Q", "A") == -4 and m.by_code(65, 65) == 4


def test_fasta_and_fastq(spark, tmp_path):
    r = one(spark, a=fastx.fasta_record(F.lit("s3"), F.lit("ACGTACGTAC"), 4), b=fastx.fasta_record(F.lit("s5"), F.lit("")), c=fastx.fasta_record(F.lit("s"), F.lit("ACG"), 2, "\r\n"))
    assert tuple(r) == (">s3\nACGT\nACGT\nAC", ">s5\n", ">s\r\nAC\r\nG")
    path = tmp_path / "a.fq"
    path.write_bytes(b"@one x\nACGT\nAC\n+\n@III\nII\n@two\nA\n+two\n+\n>three\r\nGG\r\nT\r\n@four\n\n+\n\n@five\n+\n")
    got = [tuple(r) for r in fastx.read_fastx(spark, str(path)).collect()]
    assert got == [("one x", "ACGTAC", "@IIIII"), ("two", "A", "+"), ("three", "GGT", None), ("four", "", ""), ("five", "", "")]
    for bad in (b"ACGT\n", b"@a\nACGT\n+\nIIIII\n", b"@a\nAC\nGT\n+\nIIII\n", b"@a\n>b\n", b">a\nAC\nACG\nAC\n"):
        with pytest.raises(fastx.RecordError):
            list(fastx.records(bad))
    with pytest.raises(fastx.RecordError):
        list(fastx.records(b"@a\nACGT\n", strict=True))
    (tmp_path / "b.fa").write_text(">x one\nACGT\nACGT\nA\n>y\nGG\n")
    fa = str(tmp_path / "b.fa")
    assert [tuple(r)[:2] for r in fastx.read_fasta(spark, fa).collect()] == [("x one", "ACGTACGTA"), ("y", "GG")]
    (tmp_path / "odd.fa").write_text("\r\n\n>a\r\nAC\r\nG\r\n\r\n>b\n+\nII\n>c\n")
    assert [tuple(r) for r in fastx.read_fasta(spark, str(tmp_path / "odd.fa")).collect()] == [("a", "ACG", None), ("b", "", None), ("c", "", None)]
    (tmp_path / "no.fa").write_text("ACGT\n>x\nAC\n")
    with pytest.raises(ValueError, match="begins with 'A'"):
        fastx.read_fasta(spark, str(tmp_path / "no.fa"))
    (tmp_path / "uneven.fa").write_text(">x\nAC\nACG\nAC\n")
    with pytest.raises(Exception, match="differ in length"):
        fastx.read_fasta(spark, str(tmp_path / "uneven.fa")).collect()
    index = fastx.scan_index(spark, fa).drop("path")
    assert [tuple(r) for r in index.collect()] == [("x", 9, 7, 4, 5, None), ("y", 2, 22, 2, 3, None)]
    assert {tuple(r) for r in fastx.fetch(spark, fa, index).collect()} == {("x", "ACGTACGTA", None), ("y", "GG", None)}
    (tmp_path / "bad.fai").write_text("x\t1\t2\n")
    with pytest.raises(Exception, match="unexpected number of columns"):
        fastx.read_index(spark, str(tmp_path / "bad.fai")).collect()


@pytest.mark.parametrize("size", [64, 150, 1 << 20])
def test_fastq_in_parts(spark, tmp_path, size):
    """Small parts cut files inside records; quality lines begin with all letters, records of several lines and FASTA are there too."""
    rng = random.Random(size)
    want = []
    for name, lines in (("plain", 1), ("several", 2), ("empty", 0)):
        text = ""
        for i in range(30 if lines else 1):
            n = rng.randrange(0 if lines == 1 else 4, 60)
            seq, qual = "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+>I5", k=n))
            width = n if lines == 1 else n // 2
            cut = lambda t, w=width, k=n: "\n".join(t[a : a + w] for a in range(0, k, w)) if w else t
            end = rng.choice(("\n", "\r\n"))
            if lines:
                text += f"@{name}{i} x\n{cut(seq)}\n+\n{cut(qual)}\n".replace("\n", end)
                want.append((f"{name}{i} x", seq, qual))
        (tmp_path / f"{name}.fq").write_text(text, newline="")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = fastx.read_fastq(spark, str(tmp_path / "*.fq"))
        assert size > 200 or df.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, df.collect())) == sorted(want)
        assert sorted(map(tuple, fastx.read_fastx(spark, str(tmp_path / "*.fq")).collect())) == sorted(want)
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="differ in l"):
        fastx.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


@pytest.mark.parametrize("size", [40, 150, 400])
def test_files_of_several_parts(spark, tmp_path, monkeypatch, size):
    """Index and rows of files cut into parts are those of whole files, however the parts are guessed to begin; nothing holds a whole file."""
    rng = random.Random(size)
    texts = {}
    for name in ("fq", "fa", "mixed"):
        out = []
        for i in range(40):
            n, end = rng.randrange(0, 70), rng.choice(("\n", "\r\n"))
            seq, w = "".join(rng.choices("ACGT", k=n)), 25
            cut = lambda t, w=w, end=end: end.join(t[a : a + w] for a in range(0, max(len(t), 1), w))
            # qualities that look like headers
            qual = "".join(rng.choices("@>+I", k=n))
            fq = f"@r{i} x{end}{cut(seq)}{end}+{end}{cut(qual)}{end}"
            fa = f">r{i} x{end}{cut(seq)}{end}"
            out.append(fq if name == "fq" or name == "mixed" and i % 3 else fa)
        texts[name] = "".join(out).encode()
        (tmp_path / f"{name}.seq").write_bytes(texts[name])
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        monkeypatch.setattr(fastx, "parsed", None)  # one task a file
        for name, data in texts.items():
            path = str(tmp_path / f"{name}.seq")
            assert sorted(map(tuple, fastx.read_fastx(spark, path).collect())) == sorted(fastx._rows(data), key=str)
            index = fastx.scan_index(spark, path)
            assert index.rdd.getNumPartitions() > 3
            assert sorted(map(str, (tuple(r)[1:] for r in index.collect()))) == sorted(str(fastx._index(*r)) for r in fastx._records(fastx._lines(lambda at, n, d=data: d[at : at + n], 0, len(data)), True))
            assert sorted(map(str, (r.seq for r in fastx.fetch(spark, path, index.drop("path")).collect()))) == sorted(r[1] for r in fastx._rows(data))
        (tmp_path / "late.fq").write_text("@a\nACGT\n+\nIIII\n" * 40 + "@a\nACGT\n+\nIII\n")
        with pytest.raises(Exception, match="differ in l"):
            fastx.read_fastx(spark, str(tmp_path / "late.fq")).collect()
    finally:
        spark.conf.set(key, before)


def test_one_file_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 50, numPartitions=7).select(F.concat(F.lit("r"), "id").alias("name"), F.lit("ACGTA").alias("seq"))
    fastx.write_one_file(spark, lambda to: fastx.write_fasta(rows, to, 3), str(tmp_path / "one"), str(tmp_path / "parts"))
    (one,) = [f for f in os.listdir(tmp_path / "one") if f.startswith("part-")]
    assert (tmp_path / "one" / one).read_text() == "".join(f">r{i}\nACG\nTA\n" for i in range(50)) and not (tmp_path / "parts").exists()


def test_fetch_from_many_files(spark, tmp_path, monkeypatch):
    for name in "abc":
        (tmp_path / f"{name} 1.fa").write_text(f">{name}1 x\nACGT\nAC{name.upper()}\n>{name}2\n\n>{name}3\nGG\n")
    index = fastx.scan_index(spark, f"{tmp_path}/*.fa")
    want = {(f"{n}{k}", s, None) for n in "ab" for k, s in ((1, f"ACGTAC{n.upper()}"), (2, ""), (3, "GG"))}
    assert {tuple(r) for r in fastx.fetch(spark, f"{tmp_path}/[ab]*.fa", index).collect()} == want
    monkeypatch.setattr(fastx, "_opened", lambda path: None)
    assert {tuple(r) for r in fastx.fetch(spark, f"{tmp_path}/[ab]*.fa", index).collect()} == want


def test_fetch_takes_one_file(spark, tmp_path):
    for name, seq in (("a", "ACGT"), ("b", "GGTT")):
        (tmp_path / f"{name}.fa").write_text(f">{name}\n{seq}\n")
    index = fastx.scan_index(spark, str(tmp_path / "b.fa")).drop("path")
    assert [tuple(r) for r in fastx.fetch(spark, str(tmp_path / "b*"), index).collect()] == [("b", "GGTT", None)]
    with pytest.raises(ValueError, match="matches 2"):
        fastx.fetch(spark, f"{tmp_path}/*.fa", index)


def test_sam_and_bam(spark, tmp_path):
    text = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:ref1\tLN:45\n@SQ\tSN:ref2\tLN:40\n@CO\thello\n"
    rows = "r1\t99\tref1\t7\t30\t8M2I4M1D3M\t=\t37\t39\tTTAGATAAAGGATACTG\tIIIIIIIIIIIIIIIII\tNM:i:1\nr5\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n\n"
    (tmp_path / "a.sam").write_text(text + rows)
    got = {r.qname: r for r in sam.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    assert (got["r1"].tid, got["r1"].mtid, got["r5"].tid, got["r5"].seq, got["r5"].cigar) == (0, 0, -1, "", "")
    (tmp_path / "bad.sam").write_text(text + rows.replace("8M2I", "10M2I"))
    with pytest.raises(Exception, match="lengths contradict"):
        sam.read_sam(spark, str(tmp_path / "bad.sam")).collect()
    refs = spark.createDataFrame([(0, "ref1", 45), (1, "ref2", 40)], "tid int, name string, len long")
    packed = bam.packed_rows(resolve(sam.read_sam(spark, str(tmp_path / "a.sam")), refs).withColumn("aux_raw", F.lit(b"NMC\x01XZZhi\0XBBs\x02\0\0\0\x01\0\xfe\xff").cast("binary")))
    out = fresh(spark, "t.bam")
    bam.write_bam(packed.coalesce(1), out, text, [("ref1", 45), ("ref2", 40)])
    back = {r.qname: r for r in bam.read_bam(spark, f"{out}/part-*").withColumn("aux", bam.aux_as_text("aux_raw")).collect()}
    assert back["r1"].seq == got["r1"].seq and back["r1"].qual == got["r1"].qual and back["r1"].cigar == got["r1"].cigar and back["r5"].qual == ""
    assert back["r1"].aux == "NM:i:1\tXZ:Z:hi\tXB:B:s,1,-2" and back["r1"].pos == 7 and back["r5"].pos == 0
    assert [(r.name, r.len) for r in bam.read_bam_refs(spark, f"{out}/part-*").orderBy("tid").collect()] == [("ref1", 45), ("ref2", 40)]


def test_bgzf():
    data = random.Random(5).randbytes(200_000)
    assert bgzf.inflate(bgzf.deflate(data)) == data and bgzf.deflate(b"").endswith(bgzf.EOF_BLOCK)
    for bad in (b"x" * 40, bgzf.deflate(b"abc")[:20]):
        with pytest.raises(bgzf.InvalidBgzf):
            bgzf.inflate(bad)
    with pytest.raises(bam.BamError):
        bam.header(bam.Stream(bgzf.deflate(b"nope" * 10)))


def test_stream_and_sql(spark, tmp_path):
    spark.createDataFrame([("ACGT",), ("AC",), ("GT",)], "s string").write.text(str(tmp_path / "in"))
    stream = spark.readStream.text(str(tmp_path / "in"))
    q = lengths.length_bins_stream(stream, F.length("value")).writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("bins").collect()} == {(4, 1), (2, 2)}
    names.register(spark)
    r = spark.sql("SELECT dna_revcomp('AACG') AS a, gc_count('GGAT') AS b, cigar_query_length('8M2I4M1D3M') AS c, cigar_reference_length('8M2I4M1D3M') AS d, suffix_array('BA$') AS e").first()
    assert tuple(r) == ("CGTT", 2, 17, 16, [2, 1, 0])
