"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

Texts become byte-level BPE ids and one end id. A longer text than a sequence is cut into
full pieces, of which the first may be shorter. Full pieces are sequences of their own; the others are
dealt by a hash into groups of about ``GROUP`` pieces, each an independent bin-packing problem of
bounded size. Every group is solved on ``ISLANDS`` islands: an individual is a list of bins;
crossover injects whole full bins of one parent into the other, removes bins that
would hold a piece twice and badly filled ones, and best-fits the displaced pieces; after each epoch an
island's best goes to the next one. A group ends early once it needs no more bins than a lower bound says.
Pieces of equal length are interchangeable, so that bins are tuples of lengths until
the winner is dealt out to pieces.

Defined results: a null or empty text is the end id alone; repeated rows and equal doc_ids are
packed as rows of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CAPACITY, END_ID = 1024, 2
#: Pieces of a group; islands of a group, and individuals of an island; epochs, and children of an island in each.
GROUP, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 8192, 2, 6, 3, 50
#: An epoch ends after so many children in a row that were no gain.
PATIENCE = 30
#: A bin filled to less than a share drawn from these is taken apart, and this share of the bins with pieces for gaps.
FILLED, DISSOLVED = (0.85, 0.95, 0.999), 0.75
#: What is added to lengths before they are ordered, at most.
NOISES = (0, 16, 64, 200)
#: Texts of other characters than these go through the slower library: there both agree on what a letter is.
_PLAIN = re.compile("[^\\x00-\\u024F\\u2010-\\u2027\\u20AC]")
SPECIAL = "<|endoftext|>"


class Tokenizer:
    """Ids as the `tokenizers` library gives them for the JSON file.

    The file's vocabulary is also given as ranks; the library that reads those is four times as
    fast and gives the same ids for plain texts. Others, and texts with the special token's
    string, go through `tokenizers` itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_path, self.slow = json_path, None
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if SPECIAL not in text and not _PLAIN.search(text):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # its pattern engine gives up on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer as Slow

            self.slow = Slow.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids


_TOKENIZERS: dict = {}


def tokenizer() -> Tokenizer:
    if not _TOKENIZERS:
        import public_tokenizers as p

        _TOKENIZERS[0] = Tokenizer(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    return _TOKENIZERS[0]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((a, capacity) for a in range(first, length, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid long"


def _pieces(capacity: int):
    def rows(batches):
        from pyspark import TaskContext

        tok, n = tokenizer(), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*(tok.ids(text) if text else ()), END_ID], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), n))
                    n += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "pid"])

    return rows


Bins = list[tuple[int, ...]]


def best_fit(lengths, capacity: int, bins: Bins = ()) -> Bins:
    """Each length in the order given goes to the fullest bin that has room, else to a new one."""
    by_room: dict[int, Bins] = {}
    mask, done = 0, []
    for b in bins:
        room = capacity - sum(b)
        if room:
            by_room.setdefault(room, []).append(b)
            mask |= 1 << room
        else:
            done.append(b)
    for x in lengths:
        fits = mask >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                mask ^= 1 << room
        else:
            room, b = capacity, ()
        room -= x
        if room:
            by_room.setdefault(room, []).append((*b, x))
            mask |= 1 << room
        else:
            done.append((*b, x))
    return done + [b for own in by_room.values() for b in own]


class Packed:
    """An individual: its bins, how full they are, and its fitness: fewer bins first, then fuller full ones and emptier empty ones."""

    def __init__(self, bins: Bins):
        self.bins, self.sums, self._set = bins, list(map(sum, bins)), None
        self.fitness = -len(bins), sum([n * n for n in self.sums])

    @property
    def known(self) -> set:
        if self._set is None:
            self._set = set(self.bins)
        return self._set


def least_bins(histogram: np.ndarray, capacity: int) -> int:
    """A lower bound of any packing's bins (Martello and Toth's L2): pieces over half a bin never share one,
    and small pieces can only use what room those leave."""
    count, total = np.cumsum(histogram), np.cumsum(histogram * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    for k in range(1, half + 1):
        large = int(count[-1] - count[half])
        middle, length = int(count[capacity - k] - count[half]), int(total[capacity - k] - total[half])
        small = int(total[half] - total[k - 1])
        best = max(best, large + max(0, -(-(small - middle * capacity + length) // capacity)))
    return best


def shuffled_down(lengths: list[int], noise: float, rng: random.Random) -> list[int]:
    """Decreasing lengths, with so much noise."""
    return sorted(lengths, key=lambda n: -n - rng.random() * noise) if noise else sorted(lengths, reverse=True)


def cross(a: Packed, b: Packed, capacity: int, rng: random.Random) -> Packed:
    """A child of a with whole full bins of b.

    Bins of a that hold a piece of an injected bin are removed, as are badly filled ones, and most of those
    that spend a piece small enough to fill a gap elsewhere. Their other pieces are displaced and best-fitted.
    """
    least, known = rng.choice(FILLED) * capacity, a.known
    full = [x for n, x in zip(b.sums, b.bins) if n == capacity]
    injected = [x for x in rng.sample(full, min(len(full), rng.randint(1, max(1, len(a.bins) // 100)))) if x not in known]
    owed = Counter([n for x in injected for n in x])
    gap = capacity - min([n for n in a.sums if n >= FILLED[0] * capacity], default=capacity)
    displaced, kept, partly = [], injected, []
    free, draw = owed.keys().isdisjoint, rng.random
    for n, x in zip(a.sums, a.bins):
        if n >= least and free(x) and (min(x) > gap or draw() >= DISSOLVED):
            (kept if n == capacity else partly).append(x)
            continue
        for piece in x:
            if piece not in owed:
                displaced.append(piece)
            elif owed[piece] == 1:
                del owed[piece]
            else:
                owed[piece] -= 1
    return Packed(kept + best_fit(shuffled_down(displaced, rng.choice(NOISES), rng), capacity, partly))


def evolve(histogram: np.ndarray, population: list[Bins], capacity: int, seed: int, generations: int) -> list[Bins]:
    """histogram: pieces by length. The population, best first, after so many children, or when none can be better."""
    rng = random.Random(seed)
    lengths = np.repeat(np.arange(capacity + 1), histogram).tolist()
    least = least_bins(histogram, capacity)
    population = list(population) or [best_fit(shuffled_down(lengths, 0, rng), capacity)]
    while len(population) < POPULATION and len(population[0]) > least:
        population.append(best_fit(shuffled_down(lengths, rng.choice(NOISES[1:]), rng), capacity))
    ranked = sorted(map(Packed, population), key=lambda p: p.fitness, reverse=True)
    idle = 0
    for _ in range(generations):
        if len(ranked[0].bins) <= least or idle > PATIENCE:
            break
        child = cross(*rng.sample(ranked, 2), capacity, rng)
        idle = 0 if child.fitness > ranked[0].fitness else idle + 1
        if all(child.fitness != p.fitness for p in ranked):
            ranked = sorted([*ranked, child], key=lambda p: p.fitness, reverse=True)[:POPULATION]
    return [p.bins for p in ranked]


def to_bytes(bins: Bins) -> bytes:
    """Lengths as 16-bit numbers, 0 after each bin."""
    return np.array([n for b in bins for n in (*b, 0)], np.uint16).tobytes()


def from_bytes(data: bytes) -> Bins:
    out, own = [], []
    for n in np.frombuffer(data, np.uint16).tolist():
        if n:
            own.append(n)
        else:
            out.append(tuple(own))
            own = []
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, pid), with sequence_id and offset for pid."""
    import pandas as pd

    small = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-small.count() // GROUP))
    dealt = small.withColumn("g", F.pmod(F.xxhash64("pid"), F.lit(groups)))
    tasks = groups * ISLANDS

    # the histogram is what an island gets; it is summed before it moves
    hist = dealt.groupBy("g", "length").count()
    hist = hist.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("length", "count"))).alias("h"))
    island = hist.select("g", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.lit(False).alias("guest"), "h", F.lit(None).cast("array<binary>").alias("pop"))

    def epoch(number: int):
        def run(key, pdf):
            g, k = int(key[0]), int(key[1])
            own = pdf[~pdf.guest.astype(bool)].iloc[0]
            histogram = np.zeros(capacity + 1, np.int64)
            for cell in own.h:
                histogram[cell["length"]] = cell["count"]
            population = [from_bytes(p) for p in (own["pop"] if own["pop"] is not None else ())]
            for pop in pdf[pdf.guest.astype(bool)]["pop"]:
                population = [from_bytes(pop[0]), *population[: POPULATION - 1]]
            population = evolve(histogram, population, capacity, hash((g, k, number)), GENERATIONS)
            mine = {"g": g, "island": k, "guest": False, "h": list(own.h), "pop": [to_bytes(p) for p in population]}
            guest = {"g": g, "island": (k + 1) % ISLANDS, "guest": True, "h": [], "pop": mine["pop"][:1]}
            return pd.DataFrame([mine, guest])

        return run

    schema = "g long, island int, guest boolean, h array<struct<length: long, count: long>>, pop array<binary>"
    for number in range(EPOCHS):
        island = island.repartition(tasks, "g", "island").groupBy("g", "island").applyInPandas(epoch(number), schema)
    size = F.octet_length(F.element_at("pop", 1))  # pieces and bins: fewer bins, fewer bytes
    best = island.where("not guest").groupBy("g").agg(F.min_by(F.element_at("pop", 1), F.struct(size, "island")).alias("bins"))

    def deal(key, pdf, won):
        bins = from_bytes(won.bins.iloc[0])
        places: dict[int, list] = {}
        for s, b in enumerate(bins):
            at = 0
            for n in sorted(b, reverse=True):
                places.setdefault(n, []).append((s, at))
                at += n
        pdf = pdf.sort_values("pid")
        got = [places[n].pop() for n in pdf.length]
        return pd.DataFrame({**{c: pdf[c] for c in names}, "sequence_id": [((int(key[0]) << 20 | s) << 1) for s, _ in got], "offset": [at for _, at in got]})

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.repartition(groups, "g").groupBy("g").cogroup(best.groupBy("g")).applyInPandas(deal, out)
    full = pieces.where(F.col("length") == capacity).select(*names, (F.col("pid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(capacity), PIECES)
    return pack(stored(pieces, "pieces"), capacity)


def with_ids(packed: DataFrame, docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: sequence_id, ids. docs: one row for each doc_id."""

    def rows(batches):
        tok = tokenizer()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = [*(tok.ids(text) if text else ()), END_ID]
                out += [(doc, k, ids[a : a + n]) for k, (a, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int32())))], names=["doc_id", "piece", "ids"])

    ids = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, piece int, ids array<int>")
    parts = packed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
