"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are kept whatever their score.  Kinds that
this operator adds (iban, ssn, local phone, secret) need a score of ``LEAST``: the
pattern gives a start value, a passed checksum raises it, and so does a context
word of the kind within ``NEAR`` characters; a word that speaks against it
lowers it.  A secret is a run of 20 or more letters, digits, _, + and - (no slashes,
which make it a path) with three letters and three digits at least, so only a context
word makes it one.  All positions are code points, ends exclusive.

Cases: null or empty text has no spans; repeated rows and extra columns pass
through; an empty table gives an empty result; spans of different kinds may
overlap, those of one kind never do.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow_text import map_texts

LEAST = 0.6
NEAR = 48
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: no match can begin inside one, since each takes whole runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+-]{20,}+=*+(?![A-Za-z0-9_/])")
_LETTERS, _DIGITS = re.compile(r"(?:[^A-Za-z]*[A-Za-z]){3}"), re.compile(r"(?:[^0-9]*[0-9]){3}")
_DIGIT = re.compile(r"[0-9]")

_FOR = {
    "iban": re.compile(r"\b(?:iban|account|bank|transfer|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|tax id|taxpayer)\b", re.I),
    "local_phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|cell)\b", re.I),
    "secret": re.compile(r"(?:\b|_)(?:tokens?|secrets?|passwords?|passwd|api[ _-]?keys?|access[ _-]?keys?|private[ _-]?keys?|credentials?|auth|bearer)(?:\b|_)", re.I),
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|server|host|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|payment|debit)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|cell)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:isbn|issn|version|order no|part no|invoice|example(?!\.\w))\b", re.I)
_START = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.4, "local_phone": 0.4, "secret": 0.4}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each belongs to one at sign, and begins where the run of allowed characters before it does."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    yield from (("email", a, b) for a, b in emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    around = text[max(0, start - NEAR) : start] + " \0 " + text[end : end + NEAR]
    score = _START[kind] + 0.4 * confirmed + 0.3 * bool(_FOR[kind].search(around)) - 0.3 * bool(_AGAINST.search(around))
    return min(1.0, max(0.0, score))


def spans(text: str) -> list[Span]:
    """All spans by start, then kind as listed in KINDS."""
    out = [Span(k, a, b, _score(text, k, a, b, k == "card")) for k, a, b in base_spans(text)]
    if _DIGIT.search(text):
        taken = sorted((s.start, s.end) for s in out)
        begins = [a for a, _ in taken]
        furthest = list(accumulate((b for _, b in taken), max))  # end of any span that begins so far
        more = [("iban", m, mod97(m[0].replace(" ", ""))) for m in _IBAN.finditer(text) if 15 <= len(m[0].replace(" ", "")) <= 34]
        more += [("ssn", m, False) for m in _SSN.finditer(text) if not re.match(r"000|666|9|...-00|.{7}0000", m[0])]
        more += [("local_phone", m, False) for m in _LOCAL_PHONE.finditer(text)]
        more += [("secret", m, False) for m in _SECRET.finditer(text) if _LETTERS.match(m[0]) and _DIGITS.match(m[0])]
        for kind, m, confirmed in more:
            before = bisect_right(begins, m.start())
            # What lies inside a base span is that; an iban needs its checksum.
            if kind == "iban" and not confirmed or before and furthest[before - 1] >= m.end():
                continue
            if (score := _score(text, kind, m.start(), m.end(), confirmed)) >= LEAST:
                out.append(Span(kind, m.start(), m.end(), score))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redact(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for s in found:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def find(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """``docs`` with column pii_spans and, if asked for, redacted_text (equal to the text where there are no spans); columns of these names are replaced."""

    def make():
        def routine(texts):
            plain = [t.decode("utf-8", "replace") for t in texts]
            found = [spans(t) for t in plain]
            out = {"pii_spans": [[vars(s) for s in f] for f in found]}
            return out | ({"redacted_text": [redact(t, f) for t, f in zip(plain, found, strict=True)]} if redacted else {})

        return routine

    return map_texts(docs, make, [T.StructField("pii_spans", SPANS)] + ([T.StructField("redacted_text", T.StringType())] if redacted else []), text)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("pii_spans", lambda s: s.kind.isin(*BASE))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s.kind == kind)).cast("long")
    counts = {k: count(k).alias(f"n_{k}") for k in KINDS}
    more = [*(counts[k] for k in KINDS if k not in BASE), F.size("pii_spans").cast("long").alias("n_spans")]
    return docs.select("doc_id", *(counts[k] for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), *more)
