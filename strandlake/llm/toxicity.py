"""Toxicity from a learned lexicon, fuzzy matching and context windows.

The lexicon holds words, and stems (first 4 to 6 letters), that are far likelier in documents
labelled toxic. It is a trie; a Levenshtein automaton of distance 1 run against it finds
misspelled terms. Edits of the first letter are features of their own, since clean words can be
of that form. Each hit is weighed by the words around it: quotation marks and reporting
words within ``WINDOW`` words speak for quotation, so quoted and direct hits are separate features of a logistic
regression. Lexicon and regression are one classifier, fitted on a bounded sample of labelled
rows: ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` rows with the smallest hashes of doc_id. The intercept
is that of all learnable labels, whatever share of a class the sample holds.

Defined results: null and empty texts get the score of a text without hits; without labels
every score is 0; several labels of one document count as the highest; null labels teach
nothing; repeated rows each give their row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_fold, may_learn

SAMPLE_TOXIC, SAMPLE_CLEAN = 8000, 16000
#: A term occurs in so many toxic documents of the sample at least: this share, and this number.
MIN_SHARE, MIN_DOCS = 0.004, 4
#: ln of how much likelier a term is in toxic documents.
MIN_LOG_ODDS = 4.0
STEMS = (4, 5, 6)
WINDOW = 5
#: Shortest term that is matched with an error.
FUZZY_LENGTH = 5
CACHE = 300_000
_WORD = re.compile(r"\w+")
_QUOTES = re.compile("[\"“”„«»‘’]|(?<!\\w)'|'(?!\\w)")
# Words that report what others have said.
REPORTING = frozenset("said says wrote called quoted quote term word insult sagte schrieb nannte dit écrit appelé mot dijo escribió llamó palabra".split())
FEATURES = ("direct", "quoted", "fuzzy", "fuzzy_quoted", "first", "first_quoted", "stem", "density")
DIRECT, FUZZY, FIRST, STEM, DENSITY = 0, 2, 4, 6, 7


class Trie:
    """Terms with their log odds. Nodes are dicts by letter; "" holds a term."""

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term

    def near(self, word: str) -> list[str]:
        """The terms at distance 1 or 0.

        The automaton's states (errors so far) run along the trie, from its root, and the word at once.
        """
        exact, wrong = self.root, []  # nodes reached without and with an error
        for c in word:
            new = [n[c] for n in wrong if c in n]
            if exact is not None:
                new.append(exact)  # c is too many
                for letter, child in exact.items():
                    if letter:
                        if letter != c:
                            new.append(child)  # c stands for another letter
                        if c in child:
                            new.append(child[c])  # a letter is missing before c
                exact = exact.get(c)
            wrong = new
            if exact is None and not wrong:
                return []
        found = [n[""] for n in wrong if "" in n]
        if exact is not None:
            found += [n[""] for n in (exact,) if "" in n] + [n[""] for letter, n in exact.items() if letter and "" in n]
        return found

    def within_one(self, word: str) -> str | None:
        """The smallest term at distance 1 or 0 whose first letter is the word's; None without one."""
        return min((t for t in self.near(word) if t[0] == word[:1]), default=None)

    def first_edited(self, word: str) -> str | None:
        """The smallest term at distance 1 whose first letter is not the word's; None without one."""
        return min((t for t in self.near(word) if t[0] != word[:1]), default=None)


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray | None

    def __post_init__(self):
        self.trie = Trie({w: v for w, v in self.words.items() if len(w) >= FUZZY_LENGTH})
        self.verdicts: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def verdict(self, word: str) -> tuple[int, float]:
        """(kind, log odds): 0 none, 1 a term, 2 a stem, 3 a misspelled term, 4 one whose first letter is misspelled."""
        found = self.verdicts.get(word)
        if found is None:
            if len(self.verdicts) >= CACHE:
                self.verdicts.clear()
            found = (0, 0.0)
            if (w := self.words.get(word)) is not None:
                found = (1, w)
            elif stems := [s for k in STEMS if (s := self.stems.get(word[:k])) is not None and len(word) >= k]:
                found = (2, max(stems))
            elif len(word) >= FUZZY_LENGTH - 1 and (near := self.trie.near(word)):
                same = [t for t in near if t[0] == word[0]]
                found = (3, self.words[min(same)]) if same else (4, self.words[min(near)])
            self.verdicts[word] = found
        return found

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        if not text:
            return out
        low = text.lower()
        words = _WORD.findall(low)
        found = [self.verdict(w) for w in words]
        hits = [k for k, v in enumerate(found) if v[0]]
        if not hits:
            return out
        spans = [m.span() for m in _WORD.finditer(low)]
        marks = np.fromiter((m.start() for m in _QUOTES.finditer(low)), np.int64)
        for k in hits:
            kind, odds = found[k]
            a, b = max(0, k - WINDOW), min(len(words), k + WINDOW + 1)
            before = np.searchsorted(marks, spans[k][0]) - np.searchsorted(marks, spans[a][0])
            after = np.searchsorted(marks, spans[b - 1][1]) - np.searchsorted(marks, spans[k][1])
            quoted = bool(before and after) or not REPORTING.isdisjoint(words[a:b])
            if kind == 2:
                out[STEM] += odds * (0.5 if quoted else 1.0)
            else:
                out[{1: DIRECT, 3: FUZZY, 4: FIRST}[kind] + quoted] += odds
        # first-letter edits count by their own features alone
        out[DENSITY] = sum(found[k][0] != 4 for k in hits) / len(words)
        out[:DENSITY] = np.log1p(out[:DENSITY])
        return out

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = float(self.weights[0] + self.weights[1:] @ self.features(text))
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def _units(batches):
    """Documents by unit (word, or stem with a star), for toxic and other rows of this task."""
    n = (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall((text or "").lower()))
            n[toxic].update(words)
            n[toxic].update({f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k})
    # units that no toxic row of this task holds matter too: another task's rows may
    units = list(n[1].keys() | n[0].keys())
    for a in range(0, len(units), 50_000):
        part = units[a : a + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array([n[1][u] for u in part], pa.int64()), pa.array([n[0][u] for u in part], pa.int64())],
            names=["unit", "toxic", "clean"],
        )


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton's method for logistic regression with a Gaussian prior around ``prior`` (intercept first, unpenalised nearly)."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = prior.copy(), np.full(len(prior), strength)
    pull[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    with Scratch(docs.sparkSession) as scratch:
        return _fit(docs, labels, scratch)


def _fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & may_learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    labelled = dict(known.groupBy("toxic").count().collect())
    sample = scratch(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text"), "toxicity-sample")
    size = dict(sample.groupBy("toxic").count().collect())
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model({}, {}, None)
    least = max(MIN_DOCS, MIN_SHARE * n1)
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    counted = sample.select("toxic", "text").mapInArrow(_units, "unit string, toxic long, clean long")
    # so many units reach the least share that a lexicon is at most (units of a text) / MIN_SHARE long
    terms = counted.groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= least).select("unit", odds.alias("odds")).where(F.col("odds") >= min(MIN_LOG_ODDS, np.log(2.0 * least * (n0 + 1) / (n1 + 1)))).collect()
    model = Model({u: w for u, w in terms if u[-1] != "*"}, {u[:-1]: w for u, w in terms if u[-1] == "*"}, None)

    def featured(batches):
        for batch in batches:
            rows = [model.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["toxic", "x"])

    got = sample.select("toxic", "text").mapInArrow(featured, "toxic int, x binary").toArrow()  # a few numbers a row
    x = np.array([np.frombuffer(b) for b in got.column("x").to_pylist()]).reshape(-1, len(FEATURES))
    y = np.array(got.column("toxic").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # sums in one order, however tasks ended
    prior = np.array([-2.0, 1.0, 0.4, 0.5, 0.2, 0.5, 0.2, 0.7, 1.0])
    model.weights = logistic(x[order], y[order], prior)
    # from the sample's ratio of classes to that of all labels
    model.weights[0] += np.log(max(1.0, labelled[1] / SAMPLE_TOXIC)) - np.log(max(1.0, labelled[0] / SAMPLE_CLEAN))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""

    def rows(batches):
        for batch in batches:
            s = [model.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    asked = docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "text")
    return asked.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    at = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
