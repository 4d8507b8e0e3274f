"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a question asked
again with other values gives the same template. Windows of template tokens
are joined with the benchmark's by hash; the values behind the placeholders must then
correspond one to one throughout a document and an item. Windows are looked up
by their exact words too, so that copies are found whatever their capitals,
their place in a sentence and their share of numbers and names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm import bytework
from cytoplane.llm.common import share_if_small
from cytoplane.session import cut, ship

WINDOW = 8
#: A document is contaminated by an item if it holds this share of its windows.
COVERAGE = 0.3
#: A benchmark text of fewer tokens must be a line of its own in the document; one of fewer still is not looked for.
ALONE, LEAST_TOKENS = 5, 3
#: Words of 64 bits of the sieve that documents' windows must pass before they are joined.
SIEVE_WORDS = 1 << 20

# Unit words and signs.
UNITS = frozenset(
    "% $ € £ ¥ ° mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs "
    "hour hours day days week weeks month months year years hz khz mhz ghz v mv kv w kw mw j kj cal kcal n pa kpa bar psi k °c °f "
    "mph kmh km/h m/s usd eur gbp dollar dollars cent cents euro euros pound pounds meter meters metre metres kilometer kilometers "
    "kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres degree degrees "
    "percent byte bytes kb mb gb tb".split()
)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_EDGE = re.compile(r"^[^\w%$€£¥°+-]+|[^\w%$€£¥°]+$")
LITERAL, NUMBER, UNIT, NAME, NOTHING = range(5)
_SLOT_HASH = np.array([0, 0x1B873593AAAA1111, 0x2545F4914F6CDD1D, 0x3C6EF372FE94F82B, 0], np.uint64)


def core_of(token: str) -> str:
    """The token in lower case, without punctuation around it."""
    return _EDGE.sub("", token).lower()


class _Odd(dict):
    """Tokens with digits or letters beyond Latin-1: (kind, hash of the core), worked out once each."""

    LIMIT = 200_000

    def __missing__(self, token: bytes) -> tuple[int, int]:
        core = core_of(token.decode("utf-8", "replace"))
        kind = LITERAL
        number = _NUMBER.match(core)
        if core in UNITS:
            kind = UNIT
        elif number and (number.end() == len(core) or core[number.end() :].lstrip("-") in UNITS):
            kind = NUMBER
        elif core[:1] in ("$", "€", "£", "¥") and _NUMBER.fullmatch(core[1:]):
            kind = NUMBER
        elif not any(c.isalnum() for c in core):
            kind = NOTHING
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = kind, _hash_of(core)
        return self[token]


def _hash_of(core: str) -> int:
    data = np.frombuffer(core.encode(), np.uint8)
    return int(bytework.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ODD = np.zeros(256, bool)  # digits, and what is beyond Latin-1
_ODD[[*range(0x30, 0x3A), 0xC2, *range(0xC4, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?:;"]] = True
_UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in sorted(UNITS)], np.uint64))


@dataclass
class Tokens:
    """Template tokens of several texts, in order: text, kind, hash, and place in the bytes.

    ``words`` has the hash of the word itself; ``opened`` marks the capitals
    that would make a name if they did not start a sentence.
    """

    rows: np.ndarray
    kind: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray
    words: np.ndarray
    opened: np.ndarray

    def value(self, k: int) -> str:
        return core_of(self.raw[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace"))


def canonical(raw: np.ndarray, offsets: np.ndarray, odd: _Odd) -> Tokens:
    """Template tokens of the texts in ``raw``. A capital makes a name unless it starts a sentence."""
    starts, ends, rows = bytework.word_bounds(raw, offsets)
    if not len(starts):
        return Tokens(rows, np.zeros(0, np.int8), np.zeros(0, np.uint64), starts, ends, raw, np.zeros(0, np.uint64), np.zeros(0, bool))
    second = np.zeros(len(raw), bool)  # of a Latin-1 capital
    second[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    ascii_capital = (raw >= 0x41) & (raw <= 0x5A)
    folded = raw + np.uint8(0x20) * (ascii_capital | second)
    letters = np.append(np.flatnonzero(_LETTER[raw]), len(raw))
    first = letters[np.searchsorted(letters, starts)]
    last = letters[np.searchsorted(letters, ends) - 1] + 1
    empty = first >= ends
    first = np.where(empty, starts, first)
    last = np.where(empty, starts, last)
    hashes = bytework.word_hashes(folded, first, last)
    kind = np.where(empty, NOTHING, LITERAL).astype(np.int8)
    near = np.minimum(np.searchsorted(_UNIT_HASHES, hashes), len(_UNIT_HASHES) - 1)
    kind[(_UNIT_HASHES[near] == hashes) & ~empty] = UNIT
    count = np.concatenate([[0], np.cumsum(_ODD[raw])])
    for i in np.flatnonzero(count[ends] > count[starts]).tolist():
        kind[i], hashes[i] = odd[raw[starts[i] : ends[i]].tobytes()]
    nxt = np.minimum(first + 1, len(raw) - 1)
    capital = (kind == LITERAL) & (ascii_capital[first] | (second[nxt] & (nxt > first)))
    stops = _STOP[raw[ends - 1]]
    keep = kind != NOTHING
    starts, ends, rows, kind, hashes = (x[keep] for x in (starts, ends, rows, kind, hashes))
    capital, stops = capital[keep], stops[keep]
    opens = np.ones(len(rows), bool)
    opens[1:] = stops[:-1] | (rows[1:] != rows[:-1])
    kind[capital & ~opens] = NAME
    return Tokens(rows, kind, np.where(kind == LITERAL, hashes, _SLOT_HASH[kind]), starts, ends, raw, hashes, capital & opens)


def _as_names(t: Tokens) -> Tokens:
    """The same with the first token of each text as it would be amid a sentence."""
    first = t.opened.copy()
    first[1:] &= t.rows[1:] != t.rows[:-1]
    return replace(t, kind=np.where(first, NAME, t.kind).astype(np.int8), hashes=np.where(first, _SLOT_HASH[NAME], t.hashes))


def windows(t: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` tokens with half of them literal or more, and where each starts."""
    n = len(t.rows) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    literal = np.concatenate([[0], np.cumsum(t.kind == LITERAL)])
    good = (t.rows[:n] == t.rows[width - 1 :]) & (2 * (literal[width:] - literal[:n]) >= width)
    return _run_hashes(t.hashes, width, np.flatnonzero(good))


def runs(t: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all windows of ``width`` tokens, and where each starts."""
    n = len(t.rows) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _run_hashes(t.words, width, np.flatnonzero(t.rows[:n] == t.rows[width - 1 :]))


def _run_hashes(hashes: np.ndarray, width: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : n + k] * bytework._STEP[k]
    return bytework.mix(total[start] + np.uint64(width)), start


def _line_edges(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """For each token, whether it is the first, and the last, of its line."""
    feeds = np.concatenate([[0], np.cumsum(t.raw == 0x0A)])
    first = np.ones(len(t.rows), bool)
    first[1:] = (t.rows[1:] != t.rows[:-1]) | (feeds[t.starts[1:]] > feeds[t.ends[:-1]])
    return first, np.append(first[1:], True)[: len(first)]


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.encode("utf-8", "replace") for x in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _slots(t: Tokens, start: int, width: int) -> list[str]:
    """Kind (one digit) and value of each token that is not literal."""
    return [f"{t.kind[k]}{t.value(k)}" for k in range(start, start + width) if t.kind[k] != LITERAL]


_PLACE = "width int, exact boolean, hash long, {own}, slots array<string>"
_ITEM_ROWS = _PLACE.format(own="item_id long, w long, good boolean")
_DOC_ROWS = _PLACE.format(own="doc_id long, copy string, s int")


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of benchmark texts ``item_id, th, text``.

    A text of fewer than ``WINDOW`` tokens has one window, of them all; one of
    fewer than ``LEAST_TOKENS`` has none. The first token is indexed as a
    sentence's first word and, if it has a capital, as a name, since a document
    may have it either way.
    """
    for batch in batches:
        ids, th = batch.column("item_id").to_numpy(), batch.column("th").to_numpy().view(np.uint64)
        for low, _, raw, offsets in bytework.blocks(batch.column("text")):
            t = canonical(raw, offsets, _Odd())
            named = _as_names(t)
            count = np.bincount(t.rows, minlength=len(offsets) - 1)
            head = np.cumsum(count) - count
            rows: list[tuple] = []
            for width in sorted({min(int(c), WINDOW) for c in count if c >= LEAST_TOKENS}):
                own = np.flatnonzero(np.minimum(count, WINDOW) == width)
                hashes, start = windows(t, width)
                good = set(start.tolist())
                more, at = windows(named, width)
                other = named.kind[at] != t.kind[at]
                for exact, forms in ((False, [(t, hashes, start), (named, more[other], at[other])]), (True, [(t, *runs(t, width))])):
                    for form, hs, starts in forms:
                        mine = np.isin(form.rows[starts], own)
                        r = form.rows[starts[mine]]
                        w = bytework.mix(th[low + r] + (starts[mine] - head[r]).astype(np.uint64)).view(np.int64)
                        for h, s, x, k in zip(hs[mine].view(np.int64).tolist(), starts[mine].tolist(), w.tolist(), r.tolist()):
                            rows.append((width, exact, h, int(ids[low + k]), x, s in good, _slots(form, s, width)))
            if rows:
                kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
                names = ["width", "exact", "hash", "item_id", "w", "good", "slots"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _sieve(places: DataFrame) -> np.ndarray:
    """Bits set for the hashes of the benchmark's windows, ``SIEVE_WORDS`` words whatever the benchmark's size.

    What passes it is looked up for real; a larger benchmark lets more windows pass in vain.
    """
    word = F.shiftrightunsigned("hash", 6).bitwiseAND(F.lit(SIEVE_WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    rows = places.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    sieve = np.zeros(SIEVE_WORDS, np.uint64)
    sieve[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return sieve


def _passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    word = sieve[(hashes >> np.uint64(6)) & np.uint64(len(sieve) - 1)]
    return ((word >> (hashes & np.uint64(63))) & np.uint64(1)).astype(bool)


def _doc_rows(shared, forms: list[tuple[int, bool]]):
    """The windows of documents that may be in the benchmark; short ones only where they stand alone on a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, sieve = _Odd(), shared.value
        for batch in batches:
            for low, _, raw, offsets in bytework.blocks(batch.column("text")):
                t = canonical(raw, offsets, odd)
                count = np.bincount(t.rows, minlength=len(offsets) - 1)
                head = np.cumsum(count) - count
                edges = _line_edges(t) if any(width < ALONE for width, _ in forms) else None
                for width, exact in forms:
                    hashes, start = runs(t, width) if exact else windows(t, width)
                    hit = _passes(sieve, hashes)
                    if width < ALONE:
                        hit &= edges[0][start] & edges[1][start + width - 1]
                    hashes, start = hashes[hit], start[hit]
                    if not len(start):
                        continue
                    row = t.rows[start]
                    slots = [[]] * len(start) if exact else [_slots(t, s, width) for s in start.tolist()]
                    source = pa.array(low + row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(start), width, np.int32)), pa.array(np.full(len(start), exact)), pa.array(hashes.view(np.int64)),
                            batch.column("doc_id").take(source), batch.column("copy").take(source),
                            pa.array((start - head[row]).astype(np.int32)), pa.array(slots, pa.list_(pa.string())),
                        ],
                        names=["width", "exact", "hash", "doc_id", "copy", "s", "slots"],
                    )

    return run


def _judge(hits: list[tuple[int, bool, tuple, tuple]], literal: int, every: int) -> tuple[int, int, bool]:
    """Of the matches (item window, half literal, item's slots, document's slots): windows held, slots changed, contaminated.

    Each value of the item must stand for one value in the document and the
    other way round: the most frequent counterpart counts, and windows that
    disagree with it are not held.
    """
    votes: dict[str, Counter] = defaultdict(Counter)
    for _, _, theirs, ours in hits:
        for a, b in zip(theirs, ours):
            votes[a][b] += 1
    there = {a: min(c, key=lambda b: (-c[b], b != a, b)) for a, c in votes.items()}
    back: dict[str, str] = {}
    for a in sorted(there, key=lambda a: (a != there[a], -votes[a][there[a]], a)):
        back.setdefault(there[a], a)
    held = {(w, good) for w, good, theirs, ours in hits if all(there[a] == b and back[b] == a for a, b in zip(theirs, ours))}
    changed = sum(a != b for a, b in there.items() if back[b] == a)
    templates = sum(good for _, good in held)
    enough = templates >= max(1, COVERAGE * literal - 1e-9) or len(held) >= max(1, COVERAGE * every - 1e-9)
    return len(held), changed, enough


def _verdict(hits: pd.Series, literal: pd.Series, every: pd.Series) -> pd.DataFrame:
    rows = []
    for own, n_literal, n_every in zip(hits, literal, every):
        matched = {(x["s"], x["w"]) for x in own if not x["exact"]}  # a window matched as a template needs no second match
        kept = [x for x in own if not (x["exact"] and (x["s"], x["w"]) in matched)]
        pairs = [(x["w"], x["good"], tuple(x["theirs"]), tuple(x["theirs"] if x["exact"] else x["ours"])) for x in kept]
        rows.append(_judge(pairs, n_literal, n_every))
    return pd.DataFrame(rows, columns=["held", "changed", "bad"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text").distinct()


def left_out(benchmark: DataFrame) -> DataFrame:
    """``item_id, text, reason`` of benchmark texts that are not looked for: those of fewer than ``LEAST_TOKENS`` tokens."""

    @F.pandas_udf("int")
    def tokens(texts: pd.Series) -> pd.Series:
        odd = _Odd()
        return texts.map(lambda x: len(canonical(*_bytes([x]), odd).rows) if x else 0)

    ship(benchmark.sparkSession)
    reason = F.concat(F.col("n").cast("string"), F.lit(f" of {LEAST_TOKENS} tokens"))
    return _items(benchmark).withColumn("n", tokens("text")).where(F.col("n") < LEAST_TOKENS).select("item_id", "text", reason.alias("reason"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and each benchmark item that it contains.

    ``n_windows`` of the item's ``item_windows`` windows are held, as they are or
    as templates with consistent slots; ``n_changed`` slot values differ from the
    item's own. A document contains an item if it holds 30 % or more, one at
    least, of its windows or of those with half literal tokens. The others have
    no template and are held only word for word (case and signs aside).
    Benchmark texts of fewer than ``ALONE`` tokens are held only by documents
    that have them as a line of their own; those of fewer than ``LEAST_TOKENS``
    by none (``left_out`` lists them).

    Windows of both sides are joined by their hash; the benchmark's are sent to
    all executors if they are measured to be small. Windows that a sieve of bits
    knows not to be in the benchmark never leave their task. Slots are checked
    after the join, for each document and item. Items with the same texts are
    looked for once.

    Null and empty texts and items contain nothing and are in nothing. Repeated
    documents give repeated rows, repeated items (same id and text) count once;
    texts that share an ``item_id`` are one item's windows. A null ``doc_id``
    or ``item_id`` is passed on (the latter as -1). Other columns are ignored;
    empty tables give an empty result. ``copy`` is the MD5 of the text.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("copy"))
    items = cut(_items(benchmark).withColumn("th", F.xxhash64("text")))
    marks = [F.count("*"), F.bit_xor("th"), F.bit_xor(F.xxhash64(F.lit(1), F.col("text"))), F.min(F.md5("text"))]
    alike = items.groupBy("item_id").agg(*[m.alias(f"m{k}") for k, m in enumerate(marks)])
    first = alike.groupBy("m0", "m1", "m2", "m3").agg(F.min("item_id").alias("first"))
    alike = cut(alike.join(first, ["m0", "m1", "m2", "m3"]).select("item_id", "first"))

    firsts = items.join(alike.where("item_id = first").select("item_id"), "item_id", "left_semi")
    places = cut(firsts.select("item_id", "th", "text").mapInArrow(_item_rows, _ITEM_ROWS))
    sizes = places.where("exact").groupBy("item_id").agg(F.count("*").alias("every"), F.count_if("good").alias("literal"))
    forms = [(r["width"], r["exact"]) for r in places.select("width", "exact").distinct().orderBy("exact", "width").collect()]
    known = places.withColumnRenamed("slots", "theirs")
    bytes_ = 80 + F.aggregate("theirs", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    found = rows.mapInArrow(_doc_rows(spark.sparkContext.broadcast(_sieve(places)), forms), _DOC_ROWS)
    hits = found.join(share_if_small(known, bytes_), ["width", "exact", "hash"])
    match = ["exact", "s", "w", "good", "theirs", F.col("slots").alias("ours")]
    hits = hits.groupBy("doc_id", "copy", "item_id", F.struct(*match).alias("hit")).agg(F.count("*").alias("times"))
    per = hits.groupBy("doc_id", "copy", "item_id").agg(F.collect_list("hit").alias("hits"), F.max("times").cast("int").alias("times"))
    verdict = F.pandas_udf(_verdict, "struct<held:bigint,changed:bigint,bad:boolean>")
    judged = per.join(share_if_small(sizes, 40), "item_id").withColumn("v", verdict("hits", "literal", "every")).where("v.bad")
    again = judged.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumnRenamed("item_id", "first")
    return again.join(share_if_small(alike, 32), "first").select(
        "doc_id", "copy", "item_id", F.col("v.held").alias("n_windows"), F.col("every").alias("item_windows"),
        F.col("v.changed").alias("n_changed"), F.col("v.bad").alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__i"), F.col("copy").alias("__c")).distinct()
    marked = docs.withColumn("__copy", F.md5(F.coalesce("text", F.lit(""))))
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("__i")) & (F.col("__copy") == F.col("__c"))
    return marked.join(share_if_small(cut(bad), 100), met, "left_anti").drop("__copy")

