"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds email, ip, card and phone are the base: their spans stay whatever their score. iban (mod-97) and ssn are
added by the method: an iban by its checksum, with the length of its country where that is known and fits, an ssn only where a context word stands near it. Offsets are code
points, ends exclusive. Null and empty texts have no spans; repeated rows each get their own; a column named as the
output is replaced. Every pattern is matched in time linear in the text, so very long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultframe.llm.common import tidy

#: The kinds in the order of ties.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

#: Words that, within CONTEXT characters of a span, make its kind likelier.
CONTEXT = 40
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "pan"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social security"),
}
#: Score of a confirmed span without context, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
BOOST, KEEP = 0.3, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match of four numbers ends with a whole run of digits, so none begins inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN, by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}.items()
    for c in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(found: str) -> int:
    """Where the IBAN that a match begins with ends (0: it is none): by its country's length, or else with the match; of an unknown country with any word, the later the better."""
    n = IBAN_LENGTHS.get(found[:2])
    ends = [k for k, c in enumerate(found) if c == " "]
    own = [e for e in [*ends, len(found)] if e - found.count(" ", 0, e) == n]
    for e in [*own, len(found), *([] if n else reversed(ends))]:
        if 15 <= e - found.count(" ", 0, e) <= 34 and mod97(found[:e]):
            return e
    return 0


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IBAN.search(text, at):
        end = _iban_end(m[0])
        if end:
            yield m.start(), m.start() + end
        at = m.start() + (end or 4)  # what looked like one can hold another


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each @: a match begins with the longest run of local characters before it that no earlier match has taken."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1 if at + 1 > free else free)
    return out


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def candidates(text: str):
    """(kind, start, end) of every span whose pattern and checksum hold."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if _ip_ok(m[0]):
                yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for s, e in _ibans(text):
        yield "iban", s, e
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", *m.span()


def spans(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind; each with a score between 0 and 1."""
    out = []
    for kind, s, e in candidates(text or ""):
        near = (text[max(0, s - CONTEXT) : s] + " " + text[e : e + CONTEXT]).lower()
        score = min(1.0, PRIOR[kind] + BOOST * any(w in near for w in WORDS[kind]))
        if kind in BASE or score >= KEEP:
            out.append({"kind": kind, "start": s, "end": e, "score": score})
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))


@F.arrow_udf(SPAN)
def _spans(text: pa.Array) -> pa.Array:
    return pa.array([spans(x.as_py()) for x in text], _ARROW)


def detect(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """df with a column of spans (kind, start, end, score)."""
    return df.withColumn(into, _spans(F.col(text).cast("string")))


def cut(text: str | None, found: list[dict]) -> str | None:
    """The text with each span (joined where they overlap) replaced by its kind in brackets."""
    if not found:
        return text
    out, at = [], 0
    for x in found:
        if x["start"] >= at:
            out += [text[at : x["start"]], f"[{x['kind'].upper()}]"]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


@F.arrow_udf(T.StringType())
def _redacted(text: pa.Array) -> pa.Array:
    out = pa.array([cut(t := x.as_py(), spans(t)) for x in text], pa.string())
    tidy()
    return out


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the personal data in its text column replaced by placeholders; null stays null."""
    return df.withColumn(text, _redacted(F.col(text).cast("string")))


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from a detected table."""
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
