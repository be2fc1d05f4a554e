"""Secrets in source text, configuration and prose.

Base kinds are patterns over the whole text: `assign`, `access`, `hex`. On top, the text is read as
assignments: every ':' or '=' between a name and a literal is a pair, in the syntax of JSON,
YAML, INI, shell and common languages. A literal that is itself a name seen before ("password = x")
stands for that name's literal, through any number of steps. A literal is scored by its target's
name and by its own letters; from THRESHOLD on it is reported as `literal`, at the place where the
characters stand, unless a base span covers it.

Null text counts as empty. Every row gives one row; columns besides id and text are not read. Names may be of any length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgetide.llm import ship

KINDS = ("assign", "access", "hex", "literal")
# fixed patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more characters
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6

THRESHOLD = 1.0
MIN_LITERAL = 6
DELIMITER = re.compile(r":=|=>|[:=]")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
LITERAL = re.compile(r"""[\x20\t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([^\s"',;(){}\[\]<>]+))""")
REFERENCE = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.\-]*)\}?\Z")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: How strongly a word of the target's name speaks for a secret.
WEIGHTS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9,
           "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.5, "auth": 0.6, "bearer": 0.8,
           "signing": 0.4, "access": 0.3, "api": 0.3, "client": 0.2, "key": 0.5, "cert": 0.4, "salt": 0.6}
PLACEHOLDERS = frozenset("changeme example placeholder password secret none null true false undefined string".split())


def name_score(name: str) -> float:
    """Sum of the weights of the name's words, 1.2 at most."""
    return min(1.2, sum(WEIGHTS.get(part.lower(), 0.0) for part in set(PARTS.findall(name))))


def literal_score(text: str) -> float:
    """Bits of entropy in all letters, as a share of 40 bits; 0 for placeholders."""
    if len(text) < MIN_LITERAL or text.lower() in PLACEHOLDERS or any(c.isspace() for c in text):
        return 0.0
    total = len(text)
    return min(1.0, -sum(n * math.log2(n / total) for n in Counter(text).values()) / 40)


def _name_before(text: str, end: int) -> str | None:
    """The name that stands before a place, in quotes or not, blanks between; null for none and for variables with a $."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start and text[start - 1] in NAME:
        start -= 1
    if start and text[start - 1] == "$":
        return None
    name = text[start:end]
    return name if name and (name[0].isalpha() or name[0] == "_") else None


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose target names them a secret."""
    known: dict[str, tuple[str, int, int]] = {}
    found = set()
    for mark in DELIMITER.finditer(text):
        name = _name_before(text, mark.start())
        after = LITERAL.match(text, mark.end()) if name else None
        if not after:
            continue
        group = after.lastindex
        literal = (after[group], after.start(group), after.end(group))
        reference = REFERENCE.match(literal[0]) if group == 3 or literal[0].startswith("$") else None
        if reference and reference[1] in known:
            literal = known[reference[1]]
        known[name] = literal
        if name_score(name) * literal_score(literal[0]) >= THRESHOLD * 0.5 and name_score(name) >= 0.8:
            found.add(literal[1:])
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    spans = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    return sorted(spans)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    counts = Counter(kind for _, kind, _ in base)
    extra = [(a, 3, b) for a, b in literals(text) if not any(s <= a and b <= e for s, _, e in base)] \
        if ":" in text or "=" in text else []
    shown = spell(base)
    return (counts[0], counts[1], counts[2], hashlib.sha256(shown.encode()).hexdigest(),
            spell(sorted(base + extra)) if extra else shown)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(text or "") for text in batch.column(1).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
