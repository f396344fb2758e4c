"""Substitution scores: the PAM family by rule, BLOSUM 30, 45 and 62 as published, others from a file.

PAM n is the n-th power of the one-step mutation matrix of Dayhoff, Schwartz and Orcutt (1978),
as rounded log odds; where published tables differ from that, they count. BLOSUM scores of the 20 residues
are fixed values. Letters for several residues follow rules: B and Z are means of the two residues they
stand for, J is that of I and L, U and O score as X does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np

RESIDUES = "ARNDCQEGHILKMFPSTWYV"
# Fixed values (Dayhoff, Schwartz, Orcutt 1978): accepted point mutations, times ten, below the diagonal; mutabilities; frequencies.
MUTATIONS = """
30
109 17
154 0 532
33 10 0 0
93 120 50 76 0
266 0 94 831 0 422
579 10 156 162 10 30 112
21 103 226 43 10 243 23 10
66 30 36 13 17 8 35 0 3
95 17 37 0 0 75 15 17 40 253
57 477 322 85 0 147 104 60 23 43 39
29 17 0 0 0 20 7 7 0 57 207 90
20 7 7 0 0 0 0 17 20 90 167 0 17
345 67 27 10 10 93 40 49 50 7 43 43 4 7
772 137 432 98 117 47 86 450 26 20 32 168 20 40 269
590 20 169 57 10 37 31 50 14 129 52 200 28 10 73 696
0 27 3 0 0 0 0 0 3 0 13 0 0 10 0 17 0
20 3 36 0 30 0 10 0 40 13 23 10 0 260 0 22 23 6
365 20 13 17 33 27 37 97 30 661 303 17 77 10 50 43 186 0 17
"""
MUTABILITY = [100, 65, 134, 106, 20, 93, 102, 49, 66, 96, 40, 56, 94, 41, 56, 120, 97, 18, 41, 74]
FREQUENCY = [0.087, 0.041, 0.040, 0.047, 0.033, 0.038, 0.050, 0.089, 0.034, 0.037, 0.085, 0.081, 0.015, 0.040, 0.051, 0.070, 0.058, 0.010, 0.030, 0.065]
# Cells of the published tables that differ from the rule.
PAM_PUBLISHED = {
    40: "CC 9",
    120: "BC -6 PS 1 WY -2",
    200: "AT 1 CC 12 CF -6 CN -5 IR -2 NT 0 QV -3 EW -9 MY -3 BB 3",
    250: "BX -1 GP 0 II 5 PW -6 QS -1 QX -1 RV -2",
}
# Fixed values (Henikoff and Henikoff 1992): scores of the residues on and below the diagonal, in the order of RESIDUES.
BLOSUM = {
    30: """
4
-1 8
0 -2 8
0 -1 1 9
-3 -2 -1 -3 17
1 3 -1 -1 -2 8
0 -1 -1 1 1 2 6
0 -2 0 -1 -4 -2 -2 8
-2 -1 -1 -2 -5 0 0 -3 14
0 -3 0 -4 -2 -2 -3 -1 -2 6
-1 -2 -2 -1 0 -2 -1 -2 -1 2 4
0 1 0 0 -3 0 2 -1 -2 -2 -2 4
1 0 0 -3 -2 -1 -1 -2 2 1 2 2 6
-2 -1 -1 -5 -3 -3 -4 -3 -3 0 2 -1 -2 10
-1 -1 -3 -1 -3 0 1 -1 1 -3 -3 1 -4 -4 11
1 -1 0 0 -2 -1 0 0 -1 -1 -2 0 -2 -1 -1 4
1 -3 1 -1 -2 0 -2 -2 -2 0 0 -1 0 -2 0 2 5
-5 0 -7 -4 -2 -1 -1 1 -5 -3 -2 -2 -3 1 -3 -3 -5 20
-4 0 -4 -1 -6 -1 -2 -3 0 -1 3 -1 -1 3 -2 -2 -1 5 9
1 -1 -2 -2 -2 -3 -3 -3 -3 4 1 -2 0 1 -4 -1 1 -3 1 5
""",
    45: """
5
-2 7
-1 0 6
-2 -1 2 7
-1 -3 -2 -3 12
-1 1 0 0 -3 6
-1 0 0 2 -3 2 6
0 -2 0 -1 -3 -2 -2 7
-2 0 1 0 -3 1 0 -2 10
-1 -3 -2 -4 -3 -2 -3 -4 -3 5
-1 -2 -3 -3 -2 -2 -2 -3 -2 2 5
-1 3 0 0 -3 1 1 -2 -1 -3 -3 5
-1 -1 -2 -3 -2 0 -2 -2 0 2 2 -1 6
-2 -2 -2 -4 -2 -4 -3 -3 -2 0 1 -3 0 8
-1 -2 -2 -1 -4 -1 0 -2 -2 -2 -3 -1 -2 -3 9
1 -1 1 0 -1 0 0 0 -1 -2 -3 -1 -2 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -1 -1 2 5
-2 -2 -4 -4 -5 -2 -3 -2 -3 -2 -2 -2 -2 1 -3 -4 -3 15
-2 -1 -2 -2 -3 -1 -2 -3 2 0 0 -1 0 3 -3 -2 -1 3 8
0 -2 -3 -3 -1 -3 -3 -3 -3 3 1 -2 1 0 -3 -1 0 -3 -1 5
""",
    62: """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
""",
}
# Cells of B, Z and X that differ from the rules (means; -1 for X), and the score of a ``*`` against letters.
BLOSUM_PUBLISHED = {
    30: "BN 4 BG 0 BL -1 BW -5 BZ 0 ZA 0 ZR 0 ZC 0 ZQ 4 ZE 5 ZL -1 ZP 0 ZZ 4 XA 0 XN 0 XC -2 XQ 0 XI 0 XL 0 XK 0 XM 0 XS 0 XT 0 XW -2 XV 0 XZ 0",
    45: "BA -1 BC -2 BH 0 BM -2 BS 0 BT 0 BZ 2 ZR 0 ZH 0 ZF -3 ZW -2 XA 0 XC -2 XS 0 XT 0 XW -2",
    62: "BN 3 BK 0 BS 0 ZC -3 ZQ 3 ZR 0 XA 0 XC -2 XP -2 XS 0 XT 0 XW -2",
}
BLOSUM_STAR = {30: -7, 45: -5, 62: -4}
#: Score units by distance: half bits up to PAM 120 or so, third bits beyond.
SCALE = {40: log(2) / 2, 120: log(2) / 2, 200: log(2) / 3, 250: log(2) / 3}


@dataclass(frozen=True)
class Matrix:
    """Scores by letter; letters that it doesn't know score as ``*`` does, or the least."""

    letters: str
    rows: tuple[tuple[int, ...], ...]

    @classmethod
    def parse(cls, text: str) -> Matrix:
        lines = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
        letters = "".join(lines[0])
        rows = tuple(tuple(int(v) for v in line[1:]) for line in lines[1:])
        if any(line[0] != c or len(row) != len(letters) for line, c, row in zip(lines[1:], letters, rows)) or len(rows) != len(letters):
            raise ValueError("rows and letters of the matrix differ")
        return cls(letters, rows)

    @classmethod
    def read(cls, path: str) -> Matrix:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    def score(self, a: str, b: str) -> int:
        star = self.letters.find("*")
        i, j = (k if (k := self.letters.find(c)) >= 0 else star for c in (a, b))
        return min(map(min, self.rows)) if min(i, j) < 0 else self.rows[i][j]

    def by_code(self, a: int, b: int) -> int:
        """For FunctionScore."""
        return self.score(chr(a), chr(b))


def _one_step() -> np.ndarray:
    counts = np.zeros((20, 20))
    for i, line in enumerate(MUTATIONS.split("\n")[1:-1], 1):
        counts[i, :i] = [float(v) for v in line.split()]
    counts += counts.T
    f, m = np.array(FREQUENCY), np.array(MUTABILITY, float)
    f = f / f.sum()
    rate = 0.01 / (f @ m)  # one accepted mutation in a hundred residues
    step = counts / counts.sum(0) * m * rate
    step[np.diag_indices(20)] = 1 - m * rate
    return step


def _rounded(x: np.ndarray) -> np.ndarray:
    """Nearest whole numbers, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def _finished(scores: np.ndarray, published: str, star: int) -> Matrix:
    """The matrix of the residues, B, Z and X (scores, before published cells replace some), J, U, O and ``*``."""
    letters = RESIDUES + "BZX"
    cells = published.split()
    for pair, v in zip(cells[::2], cells[1::2]):
        i, j = map(letters.index, pair)
        scores[i, j] = scores[j, i] = int(v)
    i, el, x = (letters.index(c) for c in "ILX")
    j = _rounded((scores[i] + scores[el]) / 2)
    own = _rounded((j[i] + j[el]) / 2)
    more = np.vstack((j, scores[x], scores[x]))  # J, U, O
    corner = np.array([[own, j[x], j[x]], [j[x], scores[x, x], scores[x, x]], [j[x], scores[x, x], scores[x, x]]])
    full = np.full((27, 27), star)
    full[:26, :26] = np.block([[scores, more.T], [more, corner]])
    full[26, 26] = 1
    return Matrix(letters + "JUO*", tuple(tuple(int(v) for v in row) for row in full))


@lru_cache
def pam(n: int) -> Matrix:
    """Scores of the 20 residues, of B and Z (means of what they stand for, by frequency), of X (mean of all) and of J, U, O and ``*``."""
    f = np.array(FREQUENCY)
    f = f / f.sum()
    odds = np.linalg.matrix_power(_one_step(), n) / f[:, None]
    odds = (odds + odds.T) / 2
    unit = SCALE.get(n, log(2) / (2 if n < 170 else 3))
    groups = [[k] for k in range(20)] + [[RESIDUES.index(c) for c in pair] for pair in ("ND", "QE")] + [list(range(20))]
    member = np.array([[f[k] / f[g].sum() if k in g else 0 for k in range(20)] for g in groups])
    real = np.log(np.maximum(member @ odds @ member.T, 1e-12)) / unit
    plain = np.log(np.maximum(odds, 1e-12)) / unit
    real[22, :] = member[22] @ plain @ member.T
    real[:, 22] = real[22, :]
    scores = _rounded(real)
    return _finished(scores, PAM_PUBLISHED.get(n, ""), int(scores.min()))


@lru_cache
def blosum(n: int) -> Matrix:
    """BLOSUM 30, 45 or 62; others are read from a file by ``Matrix.read``."""
    scores = np.full((23, 23), -1.0)
    for i, line in enumerate(BLOSUM[n].split("\n")[1:-1]):
        scores[i, : i + 1] = scores[: i + 1, i] = [int(v) for v in line.split()]
    pairs = [[RESIDUES.index(c) for c in pair] for pair in ("ND", "QE")]
    for k, own in enumerate(pairs, 20):
        scores[k, :20] = scores[:20, k] = _rounded(scores[own, :20].mean(0))
        for m, other in enumerate(pairs, 20):
            scores[k, m] = _rounded(scores[np.ix_(own, other)].mean())
    return _finished(scores, BLOSUM_PUBLISHED[n], BLOSUM_STAR[n])
