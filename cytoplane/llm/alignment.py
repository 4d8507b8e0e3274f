"""How the tokens of two tokenizers cover the same text.

Both token sequences of a text cover the same bytes, so each is an increasing
list of byte offsets at which its tokens end. The shorter list drives a
galloping search into the longer: from where the proportion of the two lists
suggests, exponential steps until the place is passed, then a binary search
between the last two. The rank found says how many tokens of the other list end
before; an equal offset is common to both and cuts the two lists into groups,
and the difference of neighbouring ranks is the range of tokens that a token
overlaps. The search runs over all texts of a block at once.

A text is encoded piece by piece: neither tokenizer joins what stands before
a run of white space to that run, so each distinct piece of a block is encoded
once. White space that some token of the vocabulary does join (as one has
``);`` with a carriage return) ends no piece, and a tokenizer that is not of
the plain kind is given whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import BROADCAST_BYTES
from cytoplane.session import cut

FOLDER = "/opt/tokenizers"
#: Texts are taken in blocks of so many characters (a longer text is a block of its own).
BLOCK_CHARS = 1 << 20
#: Encoded pieces a worker remembers, and links it sums before it hands them on.
REMEMBERED, PAIRS = 150_000, 1 << 19
#: Pieces encoded at a time.
RUN = 512
# white space as Unicode has it, and the public split of the byte-level vocabulary: fixed values
_GAP = "\t-\r \x85\xa0  -     　"
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBES = ("a  b", " a", "a ", "a\tb\n\n c", "ﬁ Ａ ½ é é", "x y　z​", "﻿q\r\nr", "\U0001f600 ok")


# ---------------------------------------------------------------- tokenizers


def _byte_of_letter() -> dict[str, int]:
    """Byte that each letter of a byte-level vocabulary stands for: printable Latin-1 as itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The byte-level tokenizer of a ``tokenizers`` file; ``encode`` takes texts with their leading space."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        letters = _byte_of_letter()
        added = {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
        vocab = {i: t for t, i in spec["model"]["vocab"].items() if i not in added}
        self.bytes = [b""] * (max([*vocab, *added]) + 1)
        for i, token in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for i, token in added.items():
            self.bytes[i] = token.encode()
        whole = Tokenizer.from_str(file.decode())
        whole.encode_special_tokens = True
        self._whole = lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        self.pieces = self._standard(spec)
        self.encode = self._whole
        if self.pieces:
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if i not in added}
            fast = tiktoken.Encoding("byte_level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [fast.encode_ordinary(t) for t in texts]

    def _standard(self, spec: dict) -> bool:
        """Is it the plain byte-level scheme, with merges in the order of their ids?"""
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in pairs]
        return (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and not spec.get("normalizer") and all(a < b for a, b in zip(ids, ids[1:])) and len(set(self.bytes)) == len(self.bytes)
            and all(bytes([b]) in self.bytes[:256] for b in range(256))
        )


class Pieces:
    """The tokenizer of a ``sentencepiece`` model; the space before a text is its own."""

    def __init__(self, file: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=file)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.bytes = [
            bytes([int(n[3:5], 16)]) if self._model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ]
        self._space = self._model.piece_to_id("▁")
        exact = all(b"".join(self.bytes[i] for i in self._model.encode(p)) == f" {p}".encode() for p in _PROBES)
        #: White space that a token joins to what stands before it, the model's own space included.
        self.joined = {g for n in names for g in re.findall(f"(?<=.)[{_GAP}]|(?<=[^{_GAP}▁])▁", n, re.S)}
        self.pieces = exact and "▁" not in self.joined and self._space != self._model.unk_id()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts or pieces, given with the space before them if they have one."""
        spaced = [t[:1] == " " for t in texts]
        found = self._model.encode([t[1:] if s else t for t, s in zip(texts, spaced)], num_threads=1)
        for k, (text, s) in enumerate(zip(texts, spaced)):
            if s and text == " ":
                found[k] = [self._space] if self.pieces else found[k]
            elif not s:  # the model's own space before it, a token by itself
                found[k] = found[k][1:]
        return found


_LOADED: dict[bytes, tuple] = {}


class Encoder:
    """Both tokenizers, and the pieces this worker has met lately with their ids."""

    def __init__(self, one: bytes, other: bytes):
        self.a, self.b = ByteLevel(one), Pieces(other)
        self.sizes = [np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b)]
        self.whole = not (self.a.pieces and self.b.pieces)
        joined = "".join(map(re.escape, sorted(self.b.joined)))
        on = f"(?:[{joined}][{_GAP}]*[^{_GAP}]*)*" if joined else ""
        self._runs = re.compile(f"[{_GAP}]*[^{_GAP}]+{on}|[{_GAP}]+").findall
        self._odd = re.compile(f"[{_GAP}] |[{_GAP}]$").search
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.counts = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.fits = np.zeros(0, bool)

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text without the space before each; others, of odd white space, begin with a NUL."""
        if self.whole:
            return ["\0 " + text]
        if self._odd(" " + text):
            return [p[1:] if p[0] == " " and p[-1] not in _GAP and p[1] not in _GAP else "\0" + p for p in self._runs(" " + text)]
        return text.split(" ")

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code of each piece of all texts, and pieces of each text."""
        if len(self.index) > REMEMBERED:
            self._forget()
        index, before = self.index, len(self.index)
        found, sizes = [], []
        for text in texts:
            held = self._cut(text) if text else []
            sizes.append(len(held))
            found += [index.setdefault(p, len(index)) for p in held]
        if len(index) > before:
            self._learn([p[1:] if p[:1] == "\0" else " " + p for p in islice(index, before, None)])
        return np.array(found, np.int64), np.array(sizes, np.int64)

    def _learn(self, new: list[str]) -> None:
        fits = np.ones(len(new), bool)
        for k, side in enumerate((self.a, self.b)):
            ids, counts = self._encode(side, self.sizes[k], new, fits)
            self.ids[k] = np.concatenate([self.ids[k], ids])
            self.counts[k] = np.concatenate([self.counts[k], counts])
        self.fits = np.concatenate([self.fits, fits])

    def _encode(self, side, sizes: np.ndarray, new: list[str], fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and the number of each's; clears ``fits`` of those not given back byte by byte.

        Pieces are encoded many at a time, one after another as in a text, and told apart by their bytes.
        """
        ids, counts = [], []

        def alone(low: int, high: int) -> None:
            for k, found in enumerate(side.encode(new[low:high]), low):
                fits[k] &= b"".join(map(side.bytes.__getitem__, found)) == new[k].encode()
                ids.append(np.array(found, np.int64))
                counts.append([len(found)])

        low = 0
        while low < len(new):
            high = low
            while high < min(len(new), low + RUN) and new[high][-1] not in _GAP and new[high][0] in _GAP and not self.whole:
                high += 1
            if high == low:
                alone(low, low + 1)
                low += 1
                continue
            own = [p.encode() for p in new[low:high]]
            found = np.array(side.encode(["".join(new[low:high])])[0], np.int64)
            ends, stops = np.cumsum(sizes[found]), np.cumsum([len(p) for p in own])
            at = np.searchsorted(ends, stops)
            if len(ends) and ends[-1] == stops[-1] and (ends[at] == stops).all() and b"".join(map(side.bytes.__getitem__, found.tolist())) == b"".join(own):
                ids.append(found)
                counts.append(np.diff(at, prepend=-1))
            else:
                alone(low, high)
            low = high
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(counts)


def encoder(one: bytes, other: bytes) -> Encoder:
    key = hashlib.sha1(one + other).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(one, other)
    return _LOADED[key]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for each start, ``sizes`` of them."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def encode_texts(texts: list[str], both: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids by A and by B of all texts, and the number of each text's; none for a text they do not both cover."""
    codes, sizes = both.codes(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    bad = np.zeros(len(texts), bool)
    bad[owner[~both.fits[codes]]] = True
    keep = ~bad[owner]
    codes, owner = codes[keep], owner[keep]
    out = []
    for ids, n in zip(both.ids, both.counts):
        each = n[codes]
        out += [ids[_ragged((np.cumsum(n) - n)[codes], each)], np.bincount(owner, each, len(texts)).astype(np.int64)]
    return out[0], out[2], out[1], out[3]


# ----------------------------------------------------------------- alignment


def gallop(want: np.ndarray, held: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """How many of ``held`` (increasing) are below each of ``want``.

    Exponential steps away from ``guess``, then a binary search between the last two.
    """
    low = np.clip(guess, 0, len(held))
    high = low.copy()
    open_ = np.flatnonzero((low > 0) & (held[np.maximum(low - 1, 0)] >= want))
    step = 1
    while len(open_):  # too far right
        high[open_] = low[open_] - 1
        low[open_] = np.maximum(low[open_] - step, 0)
        at = low[open_]
        open_ = open_[(at > 0) & (held[np.maximum(at - 1, 0)] >= want[open_])]
        step *= 2
    open_ = np.flatnonzero((high == low) & (high < len(held)) & (held[np.minimum(high, len(held) - 1)] < want))
    step = 1
    while len(open_):  # too far left
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, len(held))
        at = high[open_]
        open_ = open_[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] < want[open_])]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = held[middle] < want[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


class Alignment:
    """Groups and overlaps of texts of which the ``few`` list of ends is nowhere longer than the ``many`` list."""

    def __init__(self, few: np.ndarray, many: np.ndarray, n_few: np.ndarray, n_many: np.ndarray):
        ends, held = np.cumsum(few), np.cumsum(many)  # the texts one after another, in the same bytes
        text = np.repeat(np.arange(len(n_few)), n_few)
        few0, many0 = np.cumsum(n_few) - n_few, np.cumsum(n_many) - n_many
        guess = many0[text] + (np.arange(len(few)) - few0[text]) * n_many[text] // np.maximum(n_few[text], 1)
        self.rank = gallop(ends, held, guess)
        self.common = held[self.rank] == ends if len(held) else np.zeros(0, bool)
        after = self.rank + self.common
        first = np.concatenate([[0], after[:-1]])[: len(few)]  # texts follow each other, so a text's first is right too
        self.first, self.overlaps = first, self.rank - first + 1
        self.text = text

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Token of ``few`` and token of ``many`` of each link."""
        return np.repeat(np.arange(len(self.first)), self.overlaps), _ragged(self.first, self.overlaps)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of ``few`` and ``many`` tokens of each group."""
        at = np.flatnonzero(self.common)
        return np.diff(at, prepend=-1), np.diff(self.rank[at], prepend=-1)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each id, a row each with room for a sign after them, and their number."""
    names = [str(i).encode() for i in range(size)]
    width = len(names[-1]) + 1
    return np.frombuffer(b"".join(n.ljust(width) for n in names), np.uint8).reshape(size, width), np.array([len(n) for n in names])


class Layout:
    """Writes ``a1,a2|b1;a3|b2,b3`` for many texts at once."""

    def __init__(self, size: int):
        self.rows, self.sizes = _digits(size)

    def __call__(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """``ga``, ``gb``: tokens of each group; ``tokens``: tokens of both kinds of each text."""
        group = np.arange(len(ga))
        at_a = np.arange(len(a)) + (np.cumsum(gb) - gb)[np.repeat(group, ga)]
        at_b = np.arange(len(b)) + np.cumsum(ga)[np.repeat(group, gb)]
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        ends = np.cumsum(ga + gb) - 1
        sign[ends], sign[ends - gb] = ord(";"), ord("|")
        rows, sizes = self.rows[ids], self.sizes[ids]
        rows[np.arange(len(ids)), sizes] = sign
        text = rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes()
        stops = np.concatenate([[0], np.cumsum(sizes + 1)])[np.concatenate([[0], np.cumsum(tokens)])]
        return [text[x : y - 1] for x, y in zip(stops, stops[1:])]


class Aligner:
    """Aligns texts given as ids; ``size_a`` and ``size_b`` are the bytes of each id."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray):
        self.size_a, self.size_b = size_a, size_b

    def parts(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple]:
        """``texts, ids A, ids B, n_a, n_b, alignment, is A the driver`` for texts with fewer A tokens, then the others."""
        for driver in (True, False):
            texts = np.flatnonzero((n_a > 0) & ((n_a <= n_b) == driver))
            if not len(texts):
                continue
            own_a = a[_ragged((np.cumsum(n_a) - n_a)[texts], n_a[texts])]
            own_b = b[_ragged((np.cumsum(n_b) - n_b)[texts], n_b[texts])]
            sides = (self.size_a[own_a], n_a[texts]), (self.size_b[own_b], n_b[texts])
            (few, n_few), (many, n_many) = sides if driver else sides[::-1]
            yield texts, own_a, own_b, n_a[texts], n_b[texts], Alignment(few, many, n_few, n_many), driver

    def links(self, a: np.ndarray, b: np.ndarray, found: Alignment, driver: bool) -> tuple[np.ndarray, np.ndarray]:
        """Text and id pair of each link."""
        few, many = found.links()
        left, right = (few, many) if driver else (many, few)
        return found.text[few], a[left] * len(self.size_b) + b[right]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of rows of bounded length."""
    column, low, held, size = batch.column("text"), 0, [], 0
    for i in range(batch.num_rows):
        text = column[i].as_py() or ""
        if held and size + len(text) > BLOCK_CHARS:
            yield low, held
            low, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield low, held


_WRITTEN = (
    "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, pair long, times long"
)
_FIELDS = [f.split()[0] for f in _WRITTEN.split(", ")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _record(n: int, **columns) -> pa.RecordBatch:
    kinds = [_KINDS[f.split()[1]] for f in _WRITTEN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[f], k) if f in columns else pa.nulls(n, k) for f, k in zip(_FIELDS, kinds)], names=_FIELDS)


def _add_up(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(times), len(keys)).astype(np.int64)


def _aligned(batches: Iterator[pa.RecordBatch], one: bytes, other: bytes) -> Iterator[pa.RecordBatch]:
    """A row for each text, and rows of id pairs with the links of many texts summed."""
    both = encoder(one, other)
    aligner = Aligner(*both.sizes)
    layout = Layout(max(len(both.a.bytes), len(both.b.bytes)))
    store = _store(aligner)
    pairs, times = [], []
    for batch in batches:
        for low, texts in _blocks(batch):
            a, b, n_a, n_b = encode_texts(texts, both)
            n_groups, n_links, digest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [""] * len(texts)
            for own, own_a, own_b, k_a, k_b, found, driver in aligner.parts(a, b, n_a, n_b):
                text, keys = aligner.links(own_a, own_b, found, driver)
                n_links[own] = np.bincount(text, minlength=len(own))
                n_groups[own] = np.bincount(found.text[found.common], minlength=len(own))
                sides = found.groups()
                for k, line in zip(own, layout(own_a, own_b, *(sides if driver else sides[::-1]), k_a + k_b)):
                    digest[k] = hashlib.sha256(line).hexdigest()
                keys, n = np.unique(keys, return_counts=True)
                pairs.append(keys)
                times.append(n)
            yield _record(
                len(texts), rid=batch.column("rid").slice(low, len(texts)), doc_id=batch.column("doc_id").slice(low, len(texts)),
                n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=digest, a=_cut_up(a, n_a, store), b=_cut_up(b, n_b, store),
            )
            if sum(map(len, pairs)) > PAIRS:
                keys, n = _add_up(pairs, times)
                pairs, times = [keys], [n]
                if len(keys) > PAIRS // 2:
                    yield _record(len(keys), pair=keys, times=n)
                    pairs, times = [], []
    if pairs:
        keys, n = _add_up(pairs, times)
        yield _record(len(keys), pair=keys, times=n)


def _store(aligner: Aligner) -> np.dtype:
    """The type ids are kept in between the two passes."""
    return np.dtype(np.uint16 if max(len(aligner.size_a), len(aligner.size_b)) <= 1 << 16 else np.uint32)


def _cut_up(ids: np.ndarray, sizes: np.ndarray, kind: np.dtype) -> list[bytes]:
    data, stops = ids.astype(kind).tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * kind.itemsize
    return [data[x:y] for x, y in zip(stops, stops[1:])]


def _kept_links(batch: pa.RecordBatch, aligner: Aligner) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``batch``, and row (among these) and id pair of each link, for texts written before."""
    kind = _store(aligner)
    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).astype(np.int64) for c in ("a", "b"))
    n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
    low = 0
    while low < len(n_a):  # runs of rows of bounded length, as before
        high = max(low + 1, int(np.searchsorted(np.cumsum(n_a[low:]), BLOCK_CHARS // 4, "right")) + low)
        sums = [(int(n[:low].sum()), int(n[:high].sum())) for n in (n_a, n_b)]
        parts = aligner.parts(a[slice(*sums[0])], b[slice(*sums[1])], n_a[low:high], n_b[low:high])
        for own, own_a, own_b, _, _, found, driver in parts:
            yield own + low, *aligner.links(own_a, own_b, found, driver)
        low = high


def _scored(batches: Iterator[pa.RecordBatch], aligner: Aligner, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """``n_best, count_sum`` of each text, from the counts of all id pairs."""
    keys, counts, best = (table[c].to_numpy() for c in ("pair", "count", "best"))
    for batch in batches:
        n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for rows, row, pair in _kept_links(batch, aligner):
            at = np.searchsorted(keys, pair)
            n_best[rows] = np.bincount(row[best[at]], minlength=len(rows))
            np.add.at(sums := np.zeros(len(rows), np.int64), row, counts[at])
            total[rows] = sums
        head = [batch.column(c) for c in _RESULT[:5]]
        yield pa.RecordBatch.from_arrays([*head, batch.column("groups_sha256"), pa.array(n_best), pa.array(total)], names=[*_RESULT[:5], "groups_sha256", "n_best", "count_sum"])


def _listed(batches: Iterator[pa.RecordBatch], aligner: Aligner) -> Iterator[pa.RecordBatch]:
    """``rid, pair, times`` for each text and each of its id pairs."""
    for batch in batches:
        rids = batch.column("rid").to_numpy()
        for rows, row, pair in _kept_links(batch, aligner):
            order = np.lexsort((pair, row))
            row, pair = row[order], pair[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])[: len(row)])
            yield pa.RecordBatch.from_arrays([pa.array(rids[rows[row[new]]]), pa.array(pair[new]), pa.array(np.diff(new, append=len(row)))], names=["rid", "pair", "times"])


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def align(
    docs: DataFrame,
    byte_level: str = f"{FOLDER}/byte_bpe_50k.json",
    pieces: str = f"{FOLDER}/piece_bpe_32k.model",
    shared_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per row of ``docs(doc_id, text)``.

    A is the byte-level tokenizer of the file ``byte_level``, given a space and
    the text, B the piece tokenizer of ``pieces``, given the text; special
    tokens are plain text. Groups run between byte offsets at which tokens of
    both end; a link is a pair of tokens, one of each, that share bytes. The
    count of an id pair is its number of links in all texts; ``n_best`` counts a
    text's links whose pair has the highest count of its B id (ties included),
    ``count_sum`` adds up the counts of its links. A text that is null or empty,
    or that either tokenizer does not give back byte by byte, has no tokens:
    zeros and an empty digest, and its pairs count nowhere. Rows that repeat an
    id or a text are texts of their own; an empty table gives an empty result;
    other columns are ignored, whatever their names.

    Texts are read and encoded once and not shuffled; their ids go to the shared
    folder (two bytes a token) for the second pass. Links are summed in the
    tasks, so the shuffle grows with the distinct id pairs of a task. The counted
    table of pairs goes to all tasks if it measures up to ``shared_bytes``; else
    each text's pairs are joined to it. A text is held whole by its task, with
    about 60 bytes a token; the vocabulary files are read on the driver.
    """
    one, other = _file(byte_level), _file(pieces)
    both = encoder(one, other)
    aligner = Aligner(*both.sizes)

    def encode(batches):
        return _aligned(batches, one, other)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    written = cut(rows.mapInArrow(encode, _WRITTEN))
    texts = written.where("pair IS NULL").drop("pair", "times")
    summed = written.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("times").alias("count"))
    summed = cut(summed.withColumn("b", F.col("pair") % len(aligner.size_b)))
    tops = summed.groupBy("b").agg(F.max("count").alias("top"))
    pairs = summed.join(tops, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    if 17 * summed.count() <= shared_bytes:
        table = pairs.toArrow().combine_chunks().sort_by("pair")

        def score(batches):
            return _scored(batches, aligner, table)

        found = texts.mapInArrow(score, _SCORED)
    else:

        def split(batches):
            return _listed(batches, aligner)

        each = texts.where("n_links > 0").mapInArrow(split, "rid long, pair long, times long").join(pairs, "pair")
        scores = each.groupBy("rid").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
        )
        found = texts.join(scores, "rid", "left").na.fill(0, ["n_best", "count_sum"])
    return found.select(*_RESULT, "n_best", "count_sum", "groups_sha256")
