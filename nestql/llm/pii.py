"""Personal data: regular expressions propose, checksums confirm, context adjusts.

``find_pii`` returns one row per input row with all spans of the whole text.

Defined results
---------------
* null text: as the empty text, no spans;
* null or repeated ``doc_id``: each row is answered by itself;
* empty table: no rows;
* extra columns: ignored, whatever their names;
* very long text: every scan is linear in the text, nothing is cut off.

Base spans (``base`` true) follow fixed rules per kind and always stay: email,
ip (parts up to 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits).
Added spans: iban (mod 97) and national id (context needed). Each span has a
score: a prior by kind, raised by a passed checksum and by context words of the
kind within ``CONTEXT`` code points before it, lowered by words that speak
against it. Added spans below ``MIN_SCORE`` are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.llm.common import beside

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
CONTEXT = 48
MIN_SCORE = 0.5

EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits either starts a match at its first digit or not at all, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "national_id": 0.3}
CHECKED = {"card": 0.3, "iban": 0.4}
SUPPORT = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "tax", "national"),
}
AGAINST = {
    "ip": ("version", "release"),
    "card": ("isbn", "order", "serial"),
    "phone": ("version", "ratio"),
    "iban": ("serial", "sku"),
    "national_id": ("part", "serial", "order"),
}
BONUS = 0.25


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    packed = iban.replace(" ", "")
    if not 15 <= len(packed) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # The local class has no @, so each @ closes at most one run; walking left
    # from it stays linear where a forward scan would be quadratic.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _score(text: str, kind: str, start: int) -> float:
    near = text[max(0, start - CONTEXT) : start].lower()
    score = PRIOR[kind] + CHECKED.get(kind, 0.0)
    if any(w in near for w in SUPPORT[kind]):
        score += BONUS
    if any(w in near for w in AGAINST.get(kind, ())):
        score -= BONUS
    return round(min(1.0, max(0.0, score)), 4)


HAS_DIGIT = re.compile(r"[0-9]")


def spans_of(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind as in KINDS, then start."""
    found = [("email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    if HAS_DIGIT.search(text):
        if text.count(".") >= 3:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    found.append(("ip", m.start(), m.end(), True))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _digits(m[0])
                if 13 <= len(d) <= 19 and luhn(d):
                    found.append(("card", m.start(), m.end(), True))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append(("phone", m.start(), m.end(), True))
        found += [("iban", m.start(), m.end(), False) for m in IBAN.finditer(text) if mod97(m[0])]
        found += [("national_id", m.start(), m.end(), False) for m in NATIONAL_ID.finditer(text)]
    scored = ((k, a, b, _score(text, k, a), base) for k, a, b, base in found)
    return [s for s in scored if s[4] or s[3] >= MIN_SCORE]


SPANS = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``, one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ("kind", "start", "end", "score", "base")
    start = lambda: lambda texts: [[[dict(zip(names, s, strict=True)) for s in spans_of(t or "")] for t in texts]]
    return beside(rows, ["doc_id"], ["text"], f"spans {SPANS}", start).withColumnRenamed("doc_id", id_col)


def redacted(text: str | None, min_score: float = 0.0) -> str | None:
    """The text with every span of at least that score replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for k, a, b, score, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if score < min_score:
            continue
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """``id_col`` and the text with spans replaced; by default all, as base spans always count."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    start = lambda: lambda texts: [[redacted(t, min_score) for t in texts]]
    return beside(rows, ["doc_id"], ["_text"], "text string", start).withColumnsRenamed({"doc_id": id_col, "text": text_col})


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the spans."""
    spans = find_pii(docs)
    listed = lambda s: F.array_join(
        F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
