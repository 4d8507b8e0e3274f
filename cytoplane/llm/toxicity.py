"""Severity of toxic text by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import share_if_small

GRADES = 3  # 0 none, 1 mild, 2 severe
#: Labelled documents that the model may learn from: their number and their longest total text.
SAMPLE_DOCS = 6_000
SAMPLE_CHARS = 24_000_000
SLOTS = 1 << 18
LEAST_DOCS = 3
PREFIXES = (4, 5)
_ODD_STEPS = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(16)]
STEPS = 400
RATE = 1.0
PENALTY = 2e-4
#: A word is a feature if its likelihood ratio exceeds what the best of as many
#: unrelated words would be expected to reach, by so much.
MARGIN = 6.0
_STRIP = str.maketrans({c: " " for c in "\t\n\v\f\r.,;:!?|\"'()[]{}<>#*$%&/\\-_=+`~@^"})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def tokens(text: str) -> list[str]:
    return text.lower().translate(_STRIP).split()


def slots_of(word: str) -> tuple[int, ...]:
    """Feature slots of a word: itself, and its beginnings, which inflected forms share."""
    names = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
    return tuple(xxhash.xxh64_intdigest(x) & (SLOTS - 1) for x in names)


@dataclass(frozen=True)
class Model:
    """One weight a feature slot, shared by all thresholds: P(grade <= j) = sigmoid(cut[j] - score)."""

    weights: dict[int, float]
    cuts: tuple[float, ...]

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade, a column for each."""
        below = _sigmoid(np.asarray(self.cuts)[None, :] - scores[:, None])
        edges = np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))])
        return np.diff(edges, axis=1)


def evidence(toxic: np.ndarray, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Likelihood ratio of presence against label, for each slot."""
    n = np.bincount(slots, minlength=SLOTS).astype(float)
    bad = np.bincount(slots, weights=toxic[rows], minlength=SLOTS)
    total, total_bad = float(len(toxic)), float(toxic.sum())
    g = np.zeros(SLOTS)
    for seen, expected in (
        (bad, n * total_bad / total),
        (n - bad, n * (total - total_bad) / total),
        (total_bad - bad, (total - n) * total_bad / total),
        (total - total_bad - n + bad, (total - n) * (total - total_bad) / total),
    ):
        g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return g


def grade(toxic: np.ndarray, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Grades from two-valued labels: toxic documents above the median of telling words are severe.

    A telling word occurs in ``LEAST_DOCS`` documents or more, and in toxic ones
    at ten times the rate of others at least.
    """
    n = np.bincount(slots, minlength=SLOTS)
    bad = np.bincount(slots, weights=toxic[rows], minlength=SLOTS)
    rate = ((bad + 0.5) / (toxic.sum() + 1)) / ((n - bad + 0.5) / ((1 - toxic).sum() + 1))
    telling = (n >= LEAST_DOCS) & (rate >= 10)
    count = np.bincount(rows, weights=telling[slots], minlength=len(toxic))
    own = count[toxic > 0]
    middle = np.median(own) if len(own) else 0
    return np.where(toxic > 0, np.where(count > middle, 2, 1), 0)


def distinct(texts: list[str], toxic: list[int], marks: int = 16) -> tuple[list[str], list[int]]:
    """The sample without copies and near copies, whose words would count as independent evidence.

    A text goes if one of ``marks`` least hashes of its three-word runs is that of a text before it.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, text in enumerate(texts):
        words = tokens(text)
        runs = {" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))}
        hashes = np.array([xxhash.xxh64_intdigest(r) for r in runs], np.uint64)
        own = {(k, int((hashes * np.uint64(_ODD_STEPS[k]) >> np.uint64(8)).min())) for k in range(marks)}
        if not own & seen:
            kept.append(i)
        seen |= own
    return [texts[i] for i in kept], [toxic[i] for i in kept]


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Maximum likelihood with a sparsity penalty, by proximal gradient steps on presence of words."""
    texts, toxic = distinct(texts, toxic)
    y = np.asarray(toxic, float)
    pairs = sorted({(i, k) for i, t in enumerate(texts) for w in set(tokens(t)) for k in slots_of(w)})
    if not pairs or len(set(toxic)) < 2:
        return Model({}, (4.0, 8.0) if not len(y) or not y.any() else (-8.0, 0.0))
    rows, slots = (np.array(c) for c in zip(*pairs))
    g = grade(y, rows, slots)
    n = np.bincount(slots, minlength=SLOTS)
    chance = 2 * np.log(max(np.count_nonzero(n >= LEAST_DOCS), 2))
    used = np.flatnonzero((n >= LEAST_DOCS) & (evidence(y, rows, slots) >= chance + MARGIN))
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    keep = place[slots] >= 0
    rows, cols = rows[keep], place[slots[keep]]
    w = np.zeros(len(used))
    cuts = np.array([np.log((np.sum(g <= j) + 0.5) / (np.sum(g > j) + 0.5)) for j in range(GRADES - 1)])
    share = np.maximum(np.bincount(cols, minlength=len(used)), 1) / len(y)
    speed_w, speed_c = np.zeros(len(used)), np.zeros(GRADES - 1)
    for _ in range(STEPS):
        score = np.bincount(rows, weights=w[cols], minlength=len(y))
        below = np.hstack([np.zeros((len(y), 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((len(y), 1))])
        slope = below * (1 - below)
        at = np.arange(len(y))
        p = np.maximum(below[at, g + 1] - below[at, g], 1e-9)
        up, down = slope[at, g + 1] / p, slope[at, g] / p  # of the log-likelihood, by upper and lower cut
        by_score = (up - down) / len(y)  # of the loss
        grad_w = np.bincount(cols, weights=by_score[rows], minlength=len(used))
        grad_c = np.array([np.sum(down[g == j + 1]) - np.sum(up[g == j]) for j in range(GRADES - 1)]) / len(y)
        speed_w += grad_w**2
        speed_c += grad_c**2
        step = RATE / np.sqrt(speed_w + 1e-10)
        w = w - step * grad_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY * np.sqrt(share), 0)
        cuts = np.sort(cuts - RATE / np.sqrt(speed_c + 1e-10) * grad_c)
    live = np.flatnonzero(w)
    return Model({int(used[i]): float(w[i]) for i in live}, tuple(float(c) for c in cuts))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """At most ``SAMPLE_DOCS`` labelled documents, the least by MD5 of their id, within ``SAMPLE_CHARS``."""
    chosen = (
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("turn", F.md5(F.col("doc_id").cast("string"))).orderBy("turn", "doc_id").limit(SAMPLE_DOCS)
    )
    found = (
        docs.where("text is not null").select(F.col("doc_id"), "text", F.length("text").alias("n"))
        .join(share_if_small(chosen, 80), "doc_id")
    )
    # long texts last, so that the bound on characters keeps as many documents as it can
    found = found.where(F.col("n") <= SAMPLE_CHARS // SAMPLE_DOCS * 4).orderBy("turn", "text").limit(SAMPLE_DOCS)
    rows = found.select("text", "toxic").collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def _grader(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}  # word -> its slots that weigh anything
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, x in enumerate(batch.column("text")):
                found: set[int] = set()
                for word in set(tokens(x.as_py() or "")):
                    live = known.get(word)
                    if live is None:
                        if len(known) > 500_000:
                            known.clear()
                        live = known[word] = tuple(k for k in slots_of(word) if k in model.weights)
                    found.update(live)
                scores[i] = sum(model.weights[k] for k in sorted(found))
            p = model.grades(scores)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(p @ np.arange(GRADES)),
                    pa.array(p.argmax(axis=1).astype(np.int32)),
                    *(pa.array(p[:, j]) for j in range(1, GRADES)),
                    pa.array(p[:, 0] < 0.5),
                ],
                names=["doc_id", "severity", "grade", *(f"p{j}" for j in range(1, GRADES)), "toxic"],
            )

    return run


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity, grade, p1, p2, toxic`` for each row of ``docs(doc_id, text)``.

    ``severity`` is the expected grade (0 to 2), ``toxic`` whether a grade above
    0 is likelier than not. A null or empty text has no words and gets the
    grades of an empty document. Whole texts are read; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty
    result.
    """
    shape = "doc_id long, severity double, grade int, p1 double, p2 double, toxic boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_grader(model), shape)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Severity of every document, learned from a bounded sample of the labelled ones."""
    return severity(docs, fit(*sample(docs, labels)))
