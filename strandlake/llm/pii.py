"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, digits, schemes and identifier
cues); a deterministic parser for each kind then expands from the anchor and validates. No
regular expression is searched for over the text: patterns are only matched at an anchor.

Base kinds (email, ip, card, phone) equal the leftmost non-overlapping matches of the
published patterns. Further kinds that the anchors give: ``iban`` (mod-97 valid, after a cue),
``account`` (6 to 20 digits after an account cue), ``street`` (house number beside a street
word), ``login`` (user information in a URL).

Defined results: a null or empty text has no spans and the hash of the empty string; repeated rows each
give their row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "account", "street", "login")
ORDER = {kind: k for k, kind in enumerate(BASE + EXTRA)}

# Cues that stand before an identifier, and words of street names.
ACCOUNT_CUES = ("account number", "account no", "acct no", "konto-nr", "kontonummer", "numéro de compte", "número de cuenta")
IBAN_CUES = ("iban",)
# Letters of an IBAN by country code.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
        31: "MT SC", 32: "LC",
    }.items()
    for code in codes.split()
}
STREET_CUES = ("street", "avenue", "boulevard", "straße", "strasse", "calle", "avenida")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[\s:]{0,3}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})")
_WORD_END = re.compile(r"(?<=[A-Za-z0-9])(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[.\s:#]{0,3}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
_NUMBER_AFTER = re.compile(r"\s{1,2}([0-9]{1,4}[A-Za-z]?)\b")
_NUMBER_BEFORE = re.compile(r"[0-9]{1,5} (?:[^\W\d_]+ ){1,3}$")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """The end of the valid IBAN at start, which other words may follow up to end.

    Ends are ends of words: that which the country's length gives first, then from the longest.
    """
    ends = [m.start() for m in _WORD_END.finditer(text, start, min(end + 1, len(text))) if m.start() <= end]
    usual = IBAN_LENGTHS.get(text[start : start + 2].upper())
    ends.sort(key=lambda e: (len(text[start:e].replace(" ", "")) != usual, -e))
    return next((e for e in ends if iban_valid(text[start:e])), None)


_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        a.add_word("://", ("scheme", 3))
        for kind, cues in (("account", ACCOUNT_CUES), ("iban", IBAN_CUES), ("street", STREET_CUES)):
            for cue in cues:
                a.add_word(cue, (kind, len(cue)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = 0
    last_digit = -2
    # cues are matched without regard to case; İ is the one letter whose lower case is longer
    for at, (what, size) in _automaton().iter(text.replace("İ", "i").lower()):
        if what == "digit":
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, card_end))
            if at != last_digit + 1 and at >= ip_end and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                    out.append(("ip", at, ip_end))
            last_digit = at
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append(("email", start, email_end))
        elif what == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", at, phone_end))
        else:
            begin, end = at - size + 1, at + 1
            if begin and text[begin - 1].isalnum() and what not in ("scheme", "street"):
                continue
            if what == "scheme":
                if m := _LOGIN.match(text, end):
                    out.append(("login", m.start(), m.end()))
            elif what == "street":
                if end < len(text) and text[end].isalpha():
                    continue
                if m := _NUMBER_AFTER.match(text, end):
                    word = begin
                    while word and text[word - 1].isalpha():
                        word -= 1
                    out.append(("street", word, m.end(1)))
                elif m := _NUMBER_BEFORE.search(text[max(0, begin - 80) : begin]):
                    out.append(("street", max(0, begin - 80) + m.start(), end))
            elif what == "iban":
                if (m := _IBAN.match(text, end)) and (last := iban_end(text, *m.span(1))):
                    out.append(("iban", m.start(1), last))
            elif m := _ACCOUNT.match(text, end):
                out.append(("account", *m.span(1)))
    return sorted(set(out), key=lambda x: (x[1], ORDER[x[0]], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _rows(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column(1).to_pylist():
            spans = find(text) if text else []
            base = [s for s in spans if s[0] in BASE] if spans else []
            for k, kind in enumerate(BASE):
                cols[k].append(sum(s[0] == kind for s in base) if base else 0)
            cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[5].append(joined(spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of base kinds, base_sha256, spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_rows, schema)
