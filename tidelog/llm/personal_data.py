"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, scheme marks and identifier cues.
A deterministic parser for each kind expands from its anchors to the entity's boundaries and validates it. Parsers
are anchored and possessive, so each reads a stretch of text at most once: time is linear in the text.

Base kinds: ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits passing Luhn's check) and ``phone``
(8 to 15 digits), each leftmost and non-overlapping within its kind; a candidate that fails its check is dropped and
not retried. Kinds added: ``iban`` (mod-97), ``secret`` (a value of 16 or more characters with a digit behind an
identifier cue) and ``url``. Places are code points, ends exclusive.

Defined results: a null or empty text has no spans; a null doc_id is kept; repeated rows each give a row; an empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.cluster import documents, ship, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "url")
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
DOTTED = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TARGET = re.compile(r"[^\s<>\"'|]++")
VALUE = re.compile(r"\s{0,8}[=:]\s{0,8}[\"']?([A-Za-z0-9_/+=.~-]{16,}+)", re.ASCII)
IBAN = re.compile(r"[\s:=#.]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+)")
CUES = {"secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "authorization"), "iban": ("iban",)}


@cache
def _anchors():
    import ahocorasick

    made = ahocorasick.Automaton()
    for mark, kind in (("@", "email"), ("+", "phone"), ("://", "url"), *((d, "digit") for d in "0123456789")):
        made.add_word(mark, (kind, len(mark)))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                made.add_word(form, (kind, len(form)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    own, doubled = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, own)) + sum(int(d) * 2 - 9 * (d > "4") for d in doubled)) % 10 == 0


def _mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Places by kind, ascending."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE + ADDED}
    free = dict.fromkeys(found, 0)  # where the next span of a kind may begin
    for last, (kind, size) in _anchors().iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= free["card"] and (m := NUMBER.match(text, at)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if at >= free["ip"]:
                m = DOTTED.match(text, at)
                free["ip"] = (m or DIGITS.match(text, at)).end()
                if m and all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                    found["ip"].append(m.span())
        elif kind == "email":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                free["email"] = m.end()
        elif kind == "phone":
            if m := PHONE.match(text, at):
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "url":
            start = at
            while start > free["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := TARGET.match(text, at + 3)):
                end = at + 3 + len(m[0].rstrip(".,;:!?)]}"))
                if end > at + 3:
                    found["url"].append((start, end))
                    free["url"] = end
        elif at >= free[kind] and (m := (VALUE if kind == "secret" else IBAN).match(text, last + 1)):
            free[kind] = m.end()
            if any(c.isdigit() for c in m[1]) if kind == "secret" else _mod97(m[1].replace(" ", "")):
                found[kind].append(m.span(1))
    return found


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per document with its spans."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, all_spans = [], []
            for text in batch.column(1):
                found = spans(text.as_py())
                for column, kind in zip(counts, BASE, strict=True):
                    column.append(len(found[kind]))
                digests.append(hashlib.sha256(_joined(found, BASE).encode()).hexdigest())
                all_spans.append(_joined(found, BASE + ADDED))
            rest = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], names=[f.split()[0] for f in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(scan, FOUND)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


QUERIES = {"op8_personal_data": op8_personal_data}
