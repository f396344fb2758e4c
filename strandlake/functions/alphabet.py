"""Alphabets, complements, IUPAC and amino-acid codes as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of each alphabet (lower case; every alphabet accepts both cases).
LETTERS = {
    "dna": "acgt",
    "dna_gapped": "-acgt",
    "dna_redundant": "-acgtrykmswbdhvn",
    "rna": "acgu",
    "rna_gapped": "-acgu",
    "rna_redundant": "-acgurykmswbdhvn",
    "protein": "-abcdefghijklmnpqrstvwxyz*",
}
# Complement pairs, from and to.
COMPLEMENT = {
    "dna": ("acgtnxACGTNX-", "tgcanxTGCANX-"),
    "dna_redundant": ("acgtrykmswbdhvnxACGTRYKMSWBDHVNX-", "tgcayrmkswvhdbnxTGCAYRMKSWVHDBNX-"),
    "rna": ("acgunxACGUNX-", "ugcanxUGCANX-"),
    "rna_redundant": ("acgurykmswbdhvnxACGURYKMSWBDHVNX-", "ugcayrmkswvhdbnxUGCAYRMKSWVHDBNX-"),
}
COMPLEMENT |= {"dna_gapped": COMPLEMENT["dna"], "rna_gapped": COMPLEMENT["rna"]}
# 4-bit nucleotide codes and their complements, amino acids by ordinal, three-letter names.
NUCLEOTIDES, NUCLEOTIDE_COMPLEMENTS = "=ACMGRSVTWYHKDBN", "=TGKCYSBAWRDMHVN"
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYVUOBZJX*-"
THREE_LETTER = "Ala Arg Asn Asp Cys Gln Glu Gly His Ile Leu Lys Met Phe Pro Ser Thr Trp Tyr Val Sec Pyl Asx Glx Xle Xaa Ter Gap".split()


@dataclass(frozen=True)
class Alphabet:
    """An alphabet by name. All functions ignore case, and are null for null input."""

    kind: str

    @property
    def letters(self) -> str:
        return LETTERS[self.kind]

    @property
    def gap(self) -> str:
        return "-"

    @property
    def ambiguous(self) -> str:
        return "x" if self.kind == "protein" else "n"

    @property
    def mol_type(self) -> str:
        return self.kind.split("_")[0]

    def __len__(self) -> int:
        return len(self.letters)

    def index(self, c: Column) -> Column:
        """Ordinal of a letter, null if it is none."""
        at = F.instr(F.lit(self.letters), F.lower(c))
        return F.when((F.length(c) == 1) & (at > 0), at - 1)

    def letter(self, index: Column) -> Column:
        """The letter at an ordinal, null outside."""
        return F.when((index >= 0) & (index < len(self)), F.substring(F.lit(self.letters), index + 1, F.lit(1)))

    def is_valid(self, c: Column) -> Column:
        return self.index(c).isNotNull()

    def is_gap(self, c: Column) -> Column:
        return c == self.gap

    def is_cased(self) -> bool:
        return False

    def first_invalid(self, seq: Column) -> Column:
        """Index of the first letter that isn't in the alphabet; null if all are."""
        own = "".join(("\\" if c in "-*" else "") + c for c in self.letters + self.letters.upper())
        return F.nullif(F.regexp_instr(seq, F.lit(f"[^{own}]")), F.lit(0)) - 1

    def complement_letter(self, c: Column) -> Column:
        """Case is kept; null for a letter without complement."""
        a, b = COMPLEMENT[self.kind]
        return F.when((F.length(c) == 1) & (F.instr(F.lit(a), c) > 0), F.translate(c, a, b))

    def complement(self, seq: Column) -> Column:
        """Letters without complement stay."""
        return F.translate(seq, *COMPLEMENT[self.kind])

    def reverse_complement(self, seq: Column) -> Column:
        return F.reverse(self.complement(seq))


ALPHABETS = {kind: Alphabet(kind) for kind in LETTERS}


def _ordinal(table: str, c: Column) -> Column:
    at = F.instr(F.lit(table), F.upper(c))
    return F.when((F.length(c) == 1) & (at > 0), at - 1)


def nucleotide_code(c: Column) -> Column:
    """4-bit code; U counts as T, unknown letters are null."""
    return _ordinal(NUCLEOTIDES, F.translate(F.upper(c), "U", "T"))


def nucleotide_letter(code: Column) -> Column:
    return F.when((code >= 0) & (code < 16), F.substring(F.lit(NUCLEOTIDES), code + 1, F.lit(1)))


def nucleotide_complement(code: Column) -> Column:
    """Complement in the space of 4-bit codes."""
    return F.instr(F.lit(NUCLEOTIDES), F.substring(F.lit(NUCLEOTIDE_COMPLEMENTS), code + 1, F.lit(1))) - 1


def amino_acid_code(c: Column) -> Column:
    return _ordinal(AMINO_ACIDS, c)


def amino_acid_letter(code: Column) -> Column:
    return F.when((code >= 0) & (code < len(AMINO_ACIDS)), F.substring(F.lit(AMINO_ACIDS), code + 1, F.lit(1)))


def three_letter(c: Column) -> Column:
    return F.get(F.array(*map(F.lit, THREE_LETTER)), amino_acid_code(c))


def derived_dna(text: Column) -> Column:
    """A sequence from prose: its Latin letters, mapped to ACGT in turn."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), letters, "ACGT" * 13)
