"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are quantised and stored in blocks of rows; each block is cut into ``PARTS`` column slices,
which are the nodes: a node holds, for each query, a list of local scores, the inner products over
its columns. The total of a vector is the sum of its local scores.

1. The nodes of the lead blocks (one of each slot) gather their local lists and send the totals of their
   heads. A query's k-th best of them is a cutoff t that no result can be under.
2. The cutoff goes to the nodes of all blocks. A vector with a total of t or more has a local score of at
   least t / PARTS in one node, so each node collects its entries of that score or more. Rows whose slice is too
   short to reach it (by the norms of the slices) aren't multiplied at all.
3. The remaining scores of the entries collected are resolved exactly; a task keeps the best k of each query.

Row blocks and query blocks meet on a grid of slots and shares, so that a task meets at most ``MEET``
blocks of either side; what it sends doesn't grow with the blocks it has met. Ties go to the smaller vec_id.

Defined results: null vectors and such with null, NaN or infinite components take no part, nor
do rows without vec_id; vectors of different length than the query's score over the shorter length (missing components are 0);
rows that repeat a vec_id are candidates each, and queries that repeat one share its k places; a query's own vec_id is no
candidate; quantised components and scores beyond 64 bits count as the nearest 64-bit number; other columns are
ignored; without candidates a query gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stored

PARTS = 2
#: Rows of a block, queries of a block.
ROWS, QUERIES = 4096, 128
#: Slots and shares of the grid at least (if there are so many blocks), and blocks of a slot or share at most.
SLOTS, SHARES, MEET = 4, 8, 64
LONG = np.iinfo(np.int64)


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, q): floor(256 * x) of vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = embeddings.select("vec_id", x.alias("x")).where(
        "vec_id is not null and x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
    )
    return whole.select("vec_id", F.transform("x", lambda v: F.floor(v * 256)).alias("q"))


BLOCK = "block long, ids binary, width int, kind string, m binary"


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors in blocks of about so many rows, numbered: ids, and the matrix in the shortest kind of number that holds it."""
    n = max(1, -(-vectors.count() // rows))

    def pack(frames):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId(), [], 0

        def block(parts):
            ids, qs = np.concatenate([i for i, _ in parts]), [q for _, own in parts for q in own]
            width = max(map(len, qs), default=0)
            m = np.zeros((len(qs), width), np.int64)
            for k, q in enumerate(qs):
                m[k, : len(q)] = q
            kind = next(t for t in ("<i2", "<i4", "<i8") if not m.size or (np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max))
            return pd.DataFrame({"block": [number], "ids": [ids.tobytes()], "width": [width], "kind": [kind], "m": [m.astype(kind).tobytes()]})

        for pdf in frames:
            held.append((pdf.vec_id.to_numpy(np.int64), list(pdf.q)))
            size += len(pdf)
            if size >= 2 * rows:  # parts are dealt evenly, so this is rare
                yield block(held)
                number, held, size = number + n, [], 0
        if size:
            yield block(held)

    return vectors.repartition(n).mapInPandas(pack, BLOCK)


def _matrix(b) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b["ids"], np.int64)
    return ids, np.frombuffer(b["m"], b["kind"]).reshape(len(ids), b["width"])


def _largest(m: np.ndarray) -> int:
    return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products over the columns both have, in the fastest kind of number that holds all sums."""
    w = min(q.shape[1], v.shape[1])
    q, v = q[:, :w], v[:, :w]
    if not w or not len(q) or not len(v):
        return np.zeros((len(q), len(v)), np.int64)
    bound = w * _largest(q) * _largest(v)
    for limit, kind in ((2**24, np.float32), (2**53, np.float64), (2**62, np.int64)):
        if bound < limit:
            return (q.astype(kind) @ v.astype(kind).T).astype(np.int64)
    return q.astype(object) @ v.astype(object).T


def _long(total: np.ndarray) -> np.ndarray:
    return total if total.dtype != object else np.clip(total, int(LONG.min), int(LONG.max)).astype(np.int64)


def _slices(width: int) -> list[slice]:
    cuts = [width * p // PARTS for p in range(PARTS + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable").groupby("query_id").head(k)


FOUND = "query_id long, vec_id long, score long"


def _heads(cuts: list[slice], k: int):
    """Phase 1: the best totals among the heads of the nodes' local lists."""

    def run(frames):
        for pdf in frames:
            for q, v in zip(pdf.q, pdf.v):
                (qi, qm), (vi, vm) = _matrix(q), _matrix(v)
                parts = [_scores(qm[:, c], vm[:, c]) for c in cuts]
                head, n = np.zeros((len(qi), len(vi)), bool), min(k + 1, len(vi))
                for s in parts:
                    np.put_along_axis(head, np.argpartition(-s, n - 1, axis=1)[:, :n], True, axis=1)
                r, c = np.nonzero(head)
                found = pd.DataFrame({"query_id": qi[r], "vec_id": vi[c], "score": _long(sum(s[r, c] for s in parts))})
                yield _best(found[found.query_id != found.vec_id], k)

    return run


def _collected(q: np.ndarray, v: np.ndarray, cuts: list[slice], low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 for a block: row and column of the entries that a node collects, with their totals; low: a cutoff for each query."""
    least = -((-low.astype(object)) // PARTS)  # a total of low needs a local score of this
    open_ = low == LONG.min
    # no query with a cutoff of 0 or less can tell short rows apart
    bounded = not open_.any() and (least > 0).all()
    local: list[tuple[np.ndarray, np.ndarray]] = []
    collected = np.zeros((len(q), len(v)), bool)
    for cut in cuts:
        a, b = q[:, cut], v[:, cut]
        rows = np.arange(len(v))
        if bounded and len(q):
            w = min(a.shape[1], b.shape[1])
            asked, own = (np.sqrt((x[:, :w].astype(float) ** 2).sum(1)) for x in (a, b))
            with np.errstate(divide="ignore"):
                rows = np.flatnonzero(own * (1 + 1e-9) >= (least.astype(float) / asked).min())
        s = _scores(a, b[rows])
        place = np.full(len(v), -1)
        place[rows] = np.arange(len(rows))
        local.append((place, s))
        limit = least if s.dtype == object else np.clip(least, int(LONG.min), int(LONG.max)).astype(np.int64)
        collected[:, rows] |= ((s >= limit[:, None]) | open_[:, None]).astype(bool)
    r, c = np.nonzero(collected)
    total = np.zeros(len(r), np.int64)
    for cut, (place, s) in zip(cuts, local):
        known = place[c] >= 0
        if known.all():
            total = total + s[r, place[c]]
        else:
            own = _pairs(q[r][:, cut], v[c][:, cut])
            own = own.astype(object) if s.dtype == object else own
            own[known] = s[r[known], place[c[known]]]
            total = total + own
    return r, c, _long(total)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with rows."""
    w = min(a.shape[1], b.shape[1])
    kind = np.int64 if w * _largest(a) * _largest(b) < 2**62 else object
    return (a[:, :w].astype(kind) * b[:, :w].astype(kind)).sum(1) if w else np.zeros(len(a), np.int64)


def _resolved(cuts: list[slice], k: int):
    """The best k of each query over all blocks of a task."""

    def run(frames):
        best: dict[int, pd.DataFrame] = {}
        for pdf in frames:
            for q, v in zip(pdf.q, pdf.v):
                (qi, qm), (vi, vm) = _matrix(q), _matrix(v)
                cutoff = {x["query_id"]: x["cutoff"] for x in (q["limits"] if q["limits"] is not None else ())}
                low = np.array([cutoff.get(i, LONG.min) for i in qi.tolist()], np.int64)
                r, c, total = _collected(qm, vm, cuts, low)
                keep = (total >= low[r]) & (qi[r] != vi[c])
                found = pd.DataFrame({"query_id": qi[r[keep]], "vec_id": vi[c[keep]], "score": total[keep]})
                if q["block"] in best:
                    found = pd.concat([best[q["block"]], found])
                best[q["block"]] = _best(found, k)
        yield from best.values()

    return run


def top_k(embeddings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each row of queries (vec_id, embedding): query_id, rank, vec_id, score of its k best rows of embeddings."""
    spark = embeddings.sparkSession
    with Scratch(spark) as scratch:
        data = scratch(_blocks(quantised(embeddings), ROWS), "topk-rows")
        asked = scratch(_blocks(quantised(queries), QUERIES), "topk-queries")
        width, blocks = data.agg(F.coalesce(F.max("width"), F.lit(0)), F.count("*")).first()
        slots = max(1, min(blocks, SLOTS), -(-blocks // MEET))
        mine = asked.count()
        shares = max(1, min(mine, SHARES), -(-mine // MEET))
        every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
        whole = lambda name, *more: F.struct("block", "ids", "width", "kind", "m", *more).alias(name)
        share, slot = F.pmod("block", F.lit(shares)).alias("share"), F.pmod("block", F.lit(slots)).alias("slot")
        # a node cuts by the widest vector anywhere, so that all blocks cut alike
        cuts = _slices(width)

        lead = data.where(F.col("block") < slots).select(slot, every(shares, "share"), whole("v"))
        heads = asked.select(share, every(slots, "slot"), whole("q")).join(lead, ["slot", "share"]).mapInPandas(_heads(cuts, k), FOUND)
        kth = Window.partitionBy("query_id").orderBy(F.desc("score"))
        cutoffs = heads.withColumn("n", F.row_number().over(kth)).where(F.col("n") == k).select("query_id", F.col("score").alias("cutoff"))
        cutoffs = scratch(cutoffs, "topk-cutoffs")

        ids = asked.mapInPandas(lambda frames: (pd.DataFrame({"block": b, "query_id": np.frombuffer(i, np.int64)}) for pdf in frames for b, i in zip(pdf.block, pdf.ids)), "block long, query_id long")
        limits = ids.join(cutoffs, "query_id").groupBy("block").agg(F.collect_set(F.struct("query_id", "cutoff")).alias("limits"))
        told = asked.join(limits, "block", "left").select(share, every(slots, "slot"), whole("q", "limits"))
        met = told.join(data.select(slot, every(shares, "share"), whole("v")), ["slot", "share"])
        final = met.mapInPandas(_resolved(cuts, k), FOUND)
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = final.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        return stored(ranked.select("query_id", "rank", "vec_id", "score"), "topk")
