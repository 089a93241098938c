"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs before digits, digits, URL schemes
and identifier cues. Around each anchor a small deterministic parser widens to the left and right and
validates what it has found. Base kinds (email, ip, card, phone) follow fixed definitions, leftmost and
non-overlapping per kind; ``url``, ``iban`` and ``secret`` spans come on top and never remove a base span.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.common import list_array, map_batches, texts_of, tidy, with_fields

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "secret")
#: Cues before an identifier or secret, and URL schemes.
CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key")
IBAN_CUES = ("iban",)
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*").match
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+").match
_VALUE = re.compile(r"[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9_+/.~-]{8,})").match
_IBAN = re.compile(r"[\x20\t:=]{1,4}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})").match


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, what in [("@", "at"), *((f"+{d}", "plus") for d in range(10)), *((str(d), "digit") for d in range(10)), *((s, "url") for s in SCHEMES), *((c, "secret") for c in CUES), *((c, "iban") for c in IBAN_CUES)]:
        found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """A-Z in lower case; every other character, and so every position, stays."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start and then by kind as in ``KINDS``."""
    out: list[tuple[int, int, str]] = []
    email_end = ip_next = card_next = phone_next = url_end = secret_end = iban_end = 0
    for end, (what, size) in _anchors().iter(_lowered(text)):
        if what == "digit":
            if end >= ip_next:
                chain = _DOTTED(text, end)
                ip_next = chain.end()
                if chain.group().count(".") >= 3:
                    at, parts = end, chain.group().split(".")
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        stop = at + sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                            out.append((at, stop, "ip"))
                        at = stop + 1
            if end >= card_next:
                run = _CARD(text, end)
                card_next = run.end() if run else end + 1
                if run:
                    digits = run.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((end, card_next, "card"))
        elif what == "at":
            start = end
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (domain := _DOMAIN(text, end + 1)):
                email_end = domain.end()
                out.append((start, email_end, "email"))
        elif what == "plus":
            at = end - 1
            if at >= phone_next and (run := _PHONE(text, at)):
                phone_next = run.end()
                if 9 <= sum(c.isdigit() for c in run.group()) <= 15:
                    out.append((at, phone_next, "phone"))
        elif what == "url":
            at = end - size + 1
            if at >= url_end and (rest := _URL(text, end + 1)):
                stop = rest.end() - (len(rest.group()) - len(rest.group().rstrip(".,;:!?)]")))
                if stop > end + 1:
                    url_end = rest.end()
                    out.append((at, stop, "url"))
        elif what == "secret":
            if end + 1 > secret_end and (value := _VALUE(text, end + 1)):
                secret_end = value.end()
                if any(c.isdigit() for c in value.group(1)):
                    out.append((value.start(1), value.end(1), "secret"))
        elif end + 1 > iban_end and (value := _IBAN(text, end + 1)):
            plain = value.group(1).replace(" ", "").upper()
            moved = plain[4:] + plain[:4]
            if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1:
                iban_end = value.end()
                out.append((value.start(1), value.end(1), "iban"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become the first one's kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    out.append(text[at:])
    return "".join(out)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``pii`` array<struct<start int, stop int, kind string>> for every whole text.

    Null and empty texts have no spans. Rows stay as they are, repeated ones too; a column named ``pii``
    in ``df`` is replaced. Purely row by row: no shuffle, and memory for one Arrow batch.
    """
    df = tidy(df, [text_col], ["pii"])
    return map_batches(df, lambda: lambda batch: _with_spans(batch, text_col, False), with_fields(df, "pii array<struct<start:int,stop:int,kind:string>>"))


def scrub(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``scan``, and the text with every span replaced by ``[KIND]``; null texts stay null, no row goes."""
    df = tidy(df, [text_col], ["pii"])
    return map_batches(df, lambda: lambda batch: _with_spans(batch, text_col, True), with_fields(df, "pii array<struct<start:int,stop:int,kind:string>>"))


def _with_spans(batch: pa.RecordBatch, text_col: str, replace: bool) -> pa.RecordBatch:
    texts = batch.column(text_col).to_pylist()
    found = [find_spans(t) if t else [] for t in texts]
    flat = [s for spans in found for s in spans]
    values = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.string())], ["start", "stop", "kind"])
    column = list_array(values, np.fromiter(map(len, found), np.int64, len(found)))
    if replace:
        at = batch.schema.get_field_index(text_col)
        new = pa.array([redact(t, s) if s else t for t, s in zip(texts, found, strict=True)], batch.schema.field(at).type)
        batch = batch.set_column(at, batch.schema.field(at), new)
    return batch.append_column("pii", column)


def digest(spans) -> str:
    """Hex SHA-256 of the base spans as text."""
    return hashlib.sha256(joined(s for s in spans if s[2] in BASE_KINDS).encode()).hexdigest()
