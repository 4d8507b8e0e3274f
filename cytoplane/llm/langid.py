"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads segments of the UTF-8 bytes in both directions, gives every
byte a probability of each language, and a document the mean over all of its
bytes. It is trained in numpy by backpropagation through time. Gates and
candidates use x / (1 + |x|) instead of the exponential forms, which is several
times cheaper and as easy to train.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoplane.llm import bytework

UNKNOWN = "und"
HIDDEN = 8
SEGMENT = 64
#: The sample that is learned from: documents for each language, characters of
#: each (from a place given by the id's hash), languages (the most frequent).
DOCS_PER_LANG = 500
SAMPLE_CHARS = 400
MAX_LANGS = 200
STEPS = 350
BATCH = 256
RATE = 0.01
SEED = 7
_TOGETHER = 4096  # segments stepped at once
_LETTER = re.compile(r"[^\W\d_]")
_SIDES = ("f", "b")


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    scale = np.abs(x)
    scale += 1
    x /= scale
    return x


@dataclass(frozen=True)
class Network:
    langs: tuple[str, ...]
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(langs: tuple[str, ...], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {"bias": np.zeros((len(langs), 1))}
        for side in _SIDES:
            w[f"in_{side}"] = rng.normal(0, 0.5, (3 * hidden, 256))  # update, reset, candidate
            w[f"gate_{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (2 * hidden, hidden))
            w[f"cand_{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden))
            w[f"out_{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (len(langs), hidden))
        return Network(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, side: str, keep: bool):
        """Hidden states for bytes ``x`` (time, batch); with ``keep`` what training needs of each step."""
        w = self.weights
        hidden = w[f"cand_{side}"].shape[0]
        steps, size = x.shape
        states = np.empty((steps, hidden, size), w["bias"].dtype)
        h = np.zeros((hidden, size), w["bias"].dtype)
        trace = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            fed = np.take(w[f"in_{side}"], x[t], axis=1)
            gates = w[f"gate_{side}"] @ h
            gates += fed[: 2 * hidden]
            gates = _soft(gates)
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:hidden], gates[hidden:]
            held = reset * h
            cand = w[f"cand_{side}"] @ held
            cand += fed[2 * hidden :]
            cand = _soft(cand)
            if keep:
                trace.append((t, h, update, reset, held, cand))
            after = cand - h
            after *= update
            after += h
            h = after
            states[t] = h
        return states, trace

    def probabilities(self, x: np.ndarray, keep: bool = False):
        """Probability of each language at each byte: (time, language, batch)."""
        w = self.weights
        sides = {side: self._run(x, side, keep) for side in _SIDES}
        logits = sum(np.matmul(w[f"out_{s}"], sides[s][0]) for s in _SIDES) + w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return (logits, sides) if keep else logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes under ``mask`` (time, batch), and its gradients."""
        w = self.weights
        p, sides = self.probabilities(x, keep=True)
        total = mask.sum()
        at = np.arange(x.shape[1])
        loss = float(-(np.log(np.maximum(p[:, y, at], 1e-12)) * mask).sum() / total)
        d = p.copy()
        d[:, y, at] -= 1
        d *= (mask / total)[:, None, :]
        grad = {"bias": d.sum(axis=(0, 2))[:, None]}
        for side in _SIDES:
            states, trace = sides[side]
            hidden = states.shape[1]
            grad[f"out_{side}"] = np.einsum("tlb,thb->lh", d, states, optimize=True)
            back = np.einsum("lh,tlb->thb", w[f"out_{side}"], d, optimize=True)
            g_in, g_gate, g_cand = (np.zeros_like(w[f"{n}_{side}"]) for n in ("in", "gate", "cand"))
            dh = np.zeros_like(trace[0][1])
            for t, h, update, reset, held, cand in reversed(trace):
                dh = dh + back[t]
                d_cand = dh * update * (1 - np.abs(cand)) ** 2
                d_held = w[f"cand_{side}"].T @ d_cand
                d_update = dh * (cand - h) * 0.5 * (1 - np.abs(2 * update - 1)) ** 2
                d_reset = d_held * h * 0.5 * (1 - np.abs(2 * reset - 1)) ** 2
                d_gate = np.concatenate([d_update, d_reset])
                g_cand += d_cand @ held.T
                g_gate += d_gate @ h.T
                d_all = np.concatenate([d_gate, d_cand])
                order = np.argsort(x[t], kind="stable")
                seen, first = np.unique(x[t][order], return_index=True)
                g_in[:, seen] += np.add.reduceat(d_all[:, order], first, axis=1)
                dh = dh * (1 - update) + d_held * reset + w[f"gate_{side}"].T @ d_gate
            grad |= {f"in_{side}": g_in, f"gate_{side}": g_gate, f"cand_{side}": g_cand}
        return loss, grad


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as (time, segment), which of them are real, and the text of each segment."""
    sizes = np.diff(offsets)
    parts = -(-sizes // length)
    owner = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[:-1][owner] + nth * length
    left = np.minimum(offsets[1:][owner] - start, length)
    at = start[None, :] + np.arange(length)[:, None]
    real = np.arange(length)[:, None] < left[None, :]
    return np.where(real, raw[np.minimum(at, max(len(raw) - 1, 0))], 0) if len(raw) else np.zeros((length, 0), np.uint8), real, owner


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit a network to the texts' languages, by Adam on batches of segments; every language counts alike."""
    names = tuple(sorted(set(langs)))
    net = Network.start(names, seed=seed)
    if len(names) < 2:
        return net
    rng = np.random.default_rng(seed)
    raw = np.frombuffer("".join(texts).encode("utf-8", "replace"), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode("utf-8", "replace")) for t in texts])])
    x, real, owner = segments(raw, offsets)
    y = np.array([names.index(v) for v in langs])[owner]
    by_lang = [np.flatnonzero(y == k) for k in range(len(names))]
    by_lang = [b for b in by_lang if len(b)]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(by_lang), BATCH)
        batch = np.array([by_lang[k][rng.integers(0, len(by_lang[k]))] for k in pick])
        _, grad = net.gradients(x[:, batch], real[:, batch].astype(np.float32), y[batch])
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _labeller(net: Network, added: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, offsets in bytework.blocks(batch.column("text")):
                n = high - low
                x, real, owner = segments(raw, offsets)
                total = np.zeros((len(net.langs), n))
                for s in range(0, x.shape[1], _TOGETHER):
                    part = slice(s, s + _TOGETHER)
                    p = net.probabilities(np.ascontiguousarray(x[:, part]))
                    mine = np.einsum("tlb,tb->lb", p, real[:, part].astype(np.float32), optimize=True)
                    for k in range(len(net.langs)):
                        total[k] += np.bincount(owner[part], weights=mine[k], minlength=n)
                total /= np.maximum(np.diff(offsets), 1)
                best = total.argmax(axis=0) if len(net.langs) else np.zeros(n, int)
                lettered = [bool(_LETTER.search(t.as_py() or "")) for t in batch.column("text").slice(low, n)]
                names = [net.langs[b] if ok and net.langs else UNKNOWN for b, ok in zip(best, lettered)]
                scores = np.where(lettered, np.clip(total.max(axis=0, initial=0), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(low, n).columns, pa.array(names, pa.string()), pa.array(np.round(scores, 6))],
                    names=[*batch.schema.names, *added],
                )

    return run


# ------------------------------------------------------------------ documents


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from: about ``DOCS_PER_LANG`` documents of each language.

    They are those with the least hash of id and text, not held out, each giving
    ``SAMPLE_CHARS`` characters from a place that its hash names.
    """
    usable = docs.where("text is not null and lang is not null and text rlike '\\\\p{L}'").where(
        ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    )
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return [], []
    rates = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 2 * DOCS_PER_LANG / r["count"]))])
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    part = usable.select("lang", turn.alias("turn"), F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"))
    part = part.where(F.col("turn") < F.coalesce(F.element_at(rates, F.col("lang")), F.lit(0.0)))
    rows = part.orderBy("turn", "lang", "text").limit(2 * DOCS_PER_LANG * len(counts)).select("text", "lang").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def label(docs: DataFrame, net: Network, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score under ``names``; columns of these names are replaced.

    A network that has learnt no language gives ``und`` and 0.
    """
    docs = docs.drop(*names)
    if not net.langs:
        return docs.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})
    shape = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(_labeller(net, names), shape)


def predict(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs(doc_id, text, lang)``.

    Without ``net`` one is trained on a bounded sample of rows whose
    crc32(doc_id) mod 3 is not 1 and whose text and language are not null. The
    prediction reads the text alone, all bytes of it. ``lang_pred`` is ``und``
    with score 0 if the text is null or has no letter, or if there is nothing
    to learn from. A null ``doc_id`` is not held out. Repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty
    result.
    """
    net = net or train(*sample(docs))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out, "text")
    return label(rows, net).drop("text")


def reject_unknown(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """``docs`` less those without a language: no letters, or none with ``least_score`` of the probability.

    All columns stay as they are, whatever their names. A null or empty text
    goes. If no document has both text and language, nothing can be learnt and
    no text be told from another, so only those without a letter go. Repeated
    rows share their fate; an empty table gives an empty result.
    """
    net = train(*sample(docs))
    if not net.langs:
        return docs.where("text rlike '\\\\p{L}'")
    known = label(docs, net, ("__lang_pred", "__score"))
    return known.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least_score)).select(*[f"`{c}`" for c in docs.columns])
