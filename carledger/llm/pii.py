"""Personal data: patterns propose, checksums confirm, context weighs.

For each kind a regular expression proposes spans, a validator confirms or
drops them (number of digits, parts of an address, Luhn for cards, mod 97
for bank accounts), and words near the span raise or lower its score.
Offsets are code points, end exclusive. The first four kinds are kept
whenever they are valid; the others only if their score reaches
``MIN_SCORE``, so a valid checksum or a telling context is needed.

Texts are scanned whole, in time linear in their length: every pattern
either begins with a rare character or cannot begin inside a run that it
has already refused.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carledger.llm.common import ship

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn")
MIN_SCORE = 0.6
CONTEXT_CHARS = 48

SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits refused at its first digit is refused at the others too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that, near a span, speak for its kind or against it.
CONTEXT = {
    "email": (("mail", "contact", "@"), ()),
    "ip": (("ip", "host", "server", "login"), ("version", "section")),
    "card": (("card", "visa", "credit", "payment"), ("isbn", "order", "serial")),
    "phone": (("phone", "tel", "call", "mobile", "fax"), ()),
    "iban": (("iban", "account", "bank", "konto", "cuenta", "compte"), ("serial",)),
    "ssn": (("ssn", "social security", "taxpayer"), ("part", "serial", "model")),
}
#: Score of a validated span before its context is read.
START_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064: the first four characters move to the end, letters count
    10 to 35, and the number leaves 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    """Leftmost matches without overlap. The part before an @ is the whole
    run of allowed characters up to it, cut at the previous match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))


def _ip_ok(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _proposals(text: str):
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if _ip_ok(m[0]):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        # Capitals after the account may have been taken as its last groups.
        s = m[0]
        while len(plain := s.replace(" ", "")) >= 15:
            if len(plain) <= 34 and mod97(plain):
                yield "iban", m.start(), m.start() + len(s)
                break
            s = s.rpartition(" ")[0]
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]).lower()
    found, against = CONTEXT[kind]
    score = START_SCORE[kind] + 0.3 * any(w in near for w in found) - 0.3 * any(w in near for w in against)
    return round(min(1.0, max(0.0, score)), 3)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """Kept spans of one text by kind as listed, then start."""
    if not text:
        return []
    out = [(k, a, b, _score(text, k, a, b)) for k, a, b in _proposals(text)]
    return [s for s in out if s[0] in BASE_KINDS or s[3] >= MIN_SCORE]


def pii_spans(text: Column) -> Column:
    """array<struct<kind, start, end, score>> of a text column."""
    @F.pandas_udf(SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([find_spans(t) for t in texts], dtype=object)
    return spans(text)


def detect(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with one more column of spans (it replaces a column of that
    name). One task reads one row at a time, nothing is shuffled. Null and
    empty texts have no spans; repeated rows give repeated results; an empty
    table gives an empty one."""
    ship(docs.sparkSession)
    return docs.withColumn(out, pii_spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in brackets;
    of overlapping spans the first, then the longest, counts. Null stays
    null."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _redacted(t) for t in texts], dtype=object)
    return docs.withColumn(text, cleaned(F.col(text)))


def _redacted(text: str) -> str:
    out, at = [], 0
    for kind, a, b, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans
    and all spans as text."""
    found = detect(docs.select("doc_id", "text"), "text", "pii")
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    kind = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[F.size(kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
