"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes and the mark of a word's end. Every node has a failure link and the number of
tokens that following it pops, so that greedy longest-match piece counts come from one pass over a word, without
backtracking and without building pieces. A piece inside a word is an entry without the mark; the last one may
be an entry with it, or one without (a mark that is left over counts nothing), so that pieces are entries of the file.

Words are runs of word characters and single other non-space characters, lower-cased.

Defined results: a null or empty text has 0 words and 0 tokens; a word that the vocabulary
cannot spell counts as one token and one unknown word; repeated rows each give their row;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

_WORD = re.compile(r"\w+|[^\w\s]")
#: Words whose counts are kept at once in a worker.
CACHE = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in published byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


#: The symbol of a word's end, beside the 256 bytes.
END = 256


def read_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Entries of a word-BPE file as bytes, with END where they carry the mark of a word's end."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    stems = ((token.removesuffix("</w>"), token.endswith("</w>")) for token in vocab)
    return sorted((*(letters[c] for c in s), *([END] if marked else [])) for s, marked in stems if s and all(c in letters for c in s))


class Automaton:
    """child[node * 512 + symbol], fail[node] (-1: the word can't be spelled), popped[node].

    tokens are sequences of symbols. With marked, words end with END, which alone is a token that counts nothing.
    """

    def __init__(self, tokens, marked: bool = False):
        child: dict[int, int] = {}
        parent, symbol, final = [0], [0], [False]
        self.marked = marked
        for token in [*tokens, *([(END,)] if marked else [])]:
            node = 0
            for s in token:
                key = node * 512 + s
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(parent)
                    parent.append(node)
                    symbol.append(s)
                    final.append(False)
                node = nxt
            final[node] = True
        fail, popped = [-1] * len(parent), [0] * len(parent)
        depth = [0] * len(parent)
        for node in range(1, len(parent)):  # a parent has a smaller number than its child
            depth[node] = depth[parent[node]] + 1
        alone = child.get(END) if marked else None
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[node]:
                fail[node], popped[node] = 0, int(node != alone)
                continue
            z, n, s = fail[parent[node]], popped[parent[node]], symbol[node]
            while z >= 0 and z * 512 + s not in child:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[node], popped[node] = child[z * 512 + s], n
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of the word, or -1 if it can't be spelled."""
        child, fail, popped = self.child, self.fail, self.popped
        node = n = 0
        for s in (*word, END) if self.marked else word:
            while (nxt := child.get(node * 512 + s)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = nxt
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(read_vocabulary(path), marked=True)
    return _AUTOMATA[path]


class Counts(dict):
    """Pieces by word; -1 for unknown words."""

    def __init__(self, auto: Automaton):
        super().__init__()
        self.auto = auto

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = self.auto.count(word.encode("utf-8", "surrogatepass"))
        return n


def count_text(text: str | None, counts: Counts) -> tuple[int, int, int]:
    found = list(map(counts.__getitem__, _WORD.findall(text.lower()))) if text else []
    unknown = found.count(-1)
    return len(found), sum(found) + 2 * unknown, unknown


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens, n_unknown.

    vocabulary: a path that every executor can read; by default the installed public one.
    """

    def rows(batches):
        counts = Counts(automaton(vocabulary or default_vocabulary()))
        for batch in batches:
            found = [count_text(t, counts) for t in batch.column(1).to_pylist()]
            cols = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_words long, n_tokens long, n_unknown long")
