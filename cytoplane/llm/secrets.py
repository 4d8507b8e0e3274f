"""Secrets in text: fixed patterns, and windows of high entropy in candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds and the least length of what they find.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
#: Bits a character over one window; random hex has 3.4 on average, random base64 4.2.
LEAST_BITS = {"entropy_hex": 3.0, "entropy_base64": 3.7}
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
HEX_CLASS = re.compile(r"[0-9A-Fa-f]+")
#: Candidates that are known to be harmless: words joined by marks, plain
#: numbers, UUIDs, file paths, alphabets and rows of one character.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[A-Za-z]+([-_/=+]+[A-Za-z]+)*[-_/=+]*",
        r"[-_/=+]*[0-9]+([-_/=+]+[0-9]+)*[-_/=+]*",
        r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
        r"/?([a-z0-9_.-]{1,15}/)+[a-z0-9_.-]{1,15}",
        r".*(abcdefghij|ABCDEFGHIJ|0123456789).*",
        r"(.)\1+",
    )
)
_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def _hot_windows(s: str, least: float, width: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows of ``s`` whose entropy reaches ``least`` bits.

    H = log2(n) - sum(c log2 c) / n; moving the window by one changes two
    counts, so the sum is carried along.
    """
    counts: dict[str, int] = {}
    total = 0.0
    open_: list[int] | None = None
    for end, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += _LOG[k + 1] - _LOG[k]
        start = end - width + 1
        if start < 0:
            continue
        if math.log2(width) - total / width >= least - 1e-9:
            if open_ and start <= open_[1]:
                open_[1] = end + 1
            else:
                if open_:
                    yield open_[0], open_[1]
                open_ = [start, end + 1]
        c = s[start]
        k = counts[c]
        counts[c] = k - 1
        total += _LOG[k - 1] - _LOG[k]
    if open_:
        yield open_[0], open_[1]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of high entropy within candidate strings that no allow-list pattern covers."""
    found = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if any(p.fullmatch(s) for p in ALLOWED):
            continue
        kind = "entropy_hex" if HEX_CLASS.fullmatch(s) else "entropy_base64"
        if kind == "entropy_base64" and not (re.search(r"[0-9]", s) and re.search(r"[A-Za-z]", s)):
            continue
        found += [(m.start() + a, m.start() + b, kind) for a, b in _hot_windows(s, LEAST_BITS[kind])]
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return found


#: The runs of HEX of at least LEAST_HEX characters: runs are maximal, so the length can be asked at once.
_LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")


def told(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end``, by start and then kind as listed, joined by commas."""
    spans = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for x in batch.column("text"):
            text = x.as_py() or ""
            base = base_spans(text)
            kinds = [s[2] for s in base]
            digest = hashlib.sha256(told(base).encode()).hexdigest()
            out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, told(base + entropy_spans(text))))
        columns = list(zip(*out)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs``.

    Base kinds are the fixed patterns, leftmost and non-overlapping for each
    kind, too short matches dropped; spans are code points, end exclusive.
    Added to them are windows of ``WINDOW`` characters, merged where they
    overlap, whose Shannon entropy reaches the bound of their character class.

    A null or empty text has no spans. Whole texts are scanned; memory follows
    one Arrow batch. Repeated rows give repeated results, other columns are not
    passed on, an empty table gives an empty result.
    """
    shape = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, shape)
