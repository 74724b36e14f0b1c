"""Personal data in texts: patterns propose spans, checksums confirm them, context words move the score.

Base kinds (always kept when their own test holds): ``email``, ``ip`` (parts at most 255), ``card`` (13 to
19 digits, Luhn), ``phone`` (leading plus, 9 to 15 digits). Further kinds, kept when their score reaches
``THRESHOLD``: ``iban`` (two letters, two check digits, mod-97 over the whole) and ``phone_local`` (7 to 12
digits without a plus, which no checksum confirms, so that only context words lift it over the threshold).
The score is the kind's prior, plus a bonus for a checksum, plus or minus a step for words near the span.

Spans are in code points, end exclusive. Within a kind they are leftmost and do not overlap; a match that
fails its test is dropped and nothing inside it is tried again. All scans take time linear in the text.

Cases: a null text has no spans, as the empty text; texts of any length are read whole; equal texts have
equal spans; an empty table gives no rows; extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "phone_local")
THRESHOLD = 0.6
NEAR = 40
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.5, "phone": 0.7, "iban": 0.5, "phone_local": 0.35}
CHECKSUM = {"card": 0.4, "iban": 0.4}
STEP = 0.3
#: Words that make a kind more likely, and less.
FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "phone_local": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
}
AGAINST = {"ip": ("version", "release"), "card": ("order", "serial", "isbn"), "phone": ("isbn", "serial"), "phone_local": ("isbn", "serial", "order", "version"), "iban": ("serial",)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Groups are as long as they can be, so that there is one way to cut a run into them.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{1,4}+){3,8}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}(?:[ .-][0-9]{3,4})?(?![0-9.-])")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def mod97(code: str) -> bool:
    """International account numbers: the first four characters go last, letters count from 10."""
    code = code[4:] + code[:4]
    rest = 0
    for c in code:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _emails(text: str):
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start])} | {w.lower() for w in _WORD.findall(text[end : end + NEAR])}
    score = PRIOR[kind] + CHECKSUM.get(kind, 0.0)
    score += STEP * bool(near.intersection(FOR[kind])) - STEP * bool(near.intersection(AGAINST.get(kind, ())))
    return min(1.0, max(0.0, round(score, 2)))


def _digits(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed in ``KINDS``, then start."""
    if not text:
        return []
    found = [("email", *x) for x in _emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
        found = [(*x, _score(x[0], text, x[1], x[2])) for x in found]
        taken = [(x[1], x[2]) for x in found]
        for kind, pattern, holds in (("iban", _IBAN, lambda s: 15 <= len(c := s.replace(" ", "")) <= 34 and mod97(c)), ("phone_local", _LOCAL_PHONE, lambda s: 7 <= len(_digits(s)) <= 12)):
            for m in pattern.finditer(text):
                if holds(m.group()) and (score := _score(kind, text, *m.span())) >= THRESHOLD and not any(a < m.end() and m.start() < b for a, b in taken):
                    found.append((kind, *m.span(), score))
    else:
        found = [(*x, _score(x[0], text, x[1], x[2])) for x in found]
    return found


_HAS_DIGIT = re.compile(r"[0-9]")
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, found): array of (kind, start, end, score) of each text."""

    def run(batches):
        for batch in slices(batches, 1):
            rows = [[dict(zip(("kind", "start", "end", "score"), x)) for x in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:int,end:int,score:double>>")


def redacted(text: str | None) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return text if not out else "".join(out) + text[at:]


def redact(docs: DataFrame, col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``col`` replaced by the names of their kinds; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t) for t in texts], dtype=object)

    return docs.withColumn(col, clean(F.col(col)))


def listed(found: str = "found", kinds: tuple[str, ...] = KINDS):
    """Column: kind:start:end of the spans of ``kinds``, comma-joined."""
    of = F.filter(F.col(found), lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
