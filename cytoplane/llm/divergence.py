"""How far the sources of a language differ in their words, in exact whole numbers.

For each language the kept terms are those of at least ``MIN_DOCS`` of its
documents. The price of a term between two sources depends on nothing but the
two counts, so a pair of sources is priced from its joint table: how many kept
terms have count x in the one and y in the other. All joint tables come from
one-hot products. In a block of terms, every (source, count level) is an
indicator column over the terms, level zero included; the transpose of these
columns times the columns holds the joint tables of all pairs of sources of the
block. Entries are numbers of terms, exact in floating point, and prices are
whole numbers.

Blocks hold terms of like frequency, so they have few levels, and at most
``BLOCK_TERMS`` terms and twice ``BLOCK_SOURCES`` sources, so a task is bounded
whatever a language or source holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoplane.llm.common import share_if_small
from cytoplane.session import cut

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
BLOCK_TERMS = 256
BLOCK_SOURCES = 64
#: Indicator columns multiplied at a time.
BLOCK_COLUMNS = 2048
_ENTRIES = 1 << 18
_SLICE = 1 << 22
_TO_TERMS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


# -------------------------------------------------------------------- counts


def _slices(data: bytes) -> Iterator[bytes]:
    """``data`` in slices cut at blanks, so that a long text is never a list of all its words."""
    low = 0
    while low < len(data):
        high = data.find(b" ", low + _SLICE)
        high = len(data) if high < 0 else high
        yield data[low:high]
        low = high


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group in a partition, summed in parts.

    A group itself is a row without a term.
    """
    times: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def rows() -> pa.RecordBatch:
        out: tuple = ([], [], [], [], [])
        for (lang, source), counts in times.items():
            held = docs[lang, source]
            for column, values in zip(
                out,
                (
                    [lang] * (len(counts) + 1),
                    [source] * (len(counts) + 1),
                    [None, *(t.decode() for t in counts)],
                    [0, *counts.values()],
                    [0, *(held[t] for t in counts)],
                ),
            ):
                column.extend(values)
        times.clear()
        docs.clear()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch.column("text")
        for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
            counts, held = times.setdefault(key, Counter()), docs.setdefault(key, Counter())
            own: set = set()
            for part in _slices(texts[i].as_py().encode().translate(_TO_TERMS)):
                words = part.split()
                counts.update(words)
                own.update(words)
            held.update(own)
            if len(counts) > _ENTRIES:
                yield rows()
        if sum(map(len, times.values())) > _ENTRIES:
            yield rows()
    yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term; a row with null term for each group."""
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = text.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """Smoothed share of a count in units of 1e-9, rounded down, plus one; decimals do not overflow."""
    whole = f"(CAST({n} AS DECIMAL(19, 0)) + 2) * {UNIT} div (CAST({total} AS DECIMAL(19, 0)) + 2 * CAST(v AS DECIMAL(18, 0)))"
    return F.expr(f"1 + {whole}").cast("long")


# -------------------------------------------------------------- joint tables


def _prices(counts: np.ndarray, total: int, v: int) -> list[int]:
    return [1 + UNIT * (int(c) + 2) // (total + 2 * v) for c in counts]


def _indicators(counts: np.ndarray, totals: list[int], v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each source column of ``counts``: level of each term, first indicator column, and price of each indicator column."""
    codes = np.empty(counts.shape, np.int64)
    starts, prices, n = [], [], 0
    for s, total in enumerate(totals):
        levels, codes[:, s] = np.unique(counts[:, s], return_inverse=True)
        codes[:, s] += n
        starts.append(n)
        prices += _prices(levels, total, v)
        n += len(levels)
    return codes, np.array(starts, np.int64), np.array(prices, np.int64)


def _one_hot(codes: np.ndarray, low: int, high: int) -> np.ndarray:
    out = np.zeros((codes.shape[0], high - low), np.float32)
    at, s = np.nonzero((codes >= low) & (codes < high))
    out[at, codes[at, s] - low] = 1
    return out


def joint_tables(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], weights: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``column of left, column of right, terms`` for all non-zero entries of the product of indicators.

    ``left`` and ``right`` are the codes of the terms (rows) in each source and
    the number of indicator columns; a row stands for ``weights`` terms.
    """
    for a in range(0, left[1], BLOCK_COLUMNS):
        x = _one_hot(left[0], a, min(left[1], a + BLOCK_COLUMNS)) * weights[:, None]
        for b in range(0, right[1], BLOCK_COLUMNS):
            table = x.T @ _one_hot(right[0], b, min(right[1], b + BLOCK_COLUMNS))
            i, j = np.nonzero(table)
            yield i + a, j + b, table[i, j].astype(np.int64)


def _price_block(block: pa.Table, width: int) -> pa.Table:
    """Summed prices of all pairs of sources, ``width`` of which are a side, over one block of terms."""
    head = block.filter(pc.is_null(block["term"]))
    body = block.filter(pc.is_valid(block["term"]))
    sources = np.asarray(head["sid"].to_numpy())
    order = np.argsort(sources, kind="stable")
    sources = sources[order]
    totals = head["total"].to_numpy()[order]
    v, n_terms = head["v"][0].as_py(), head["terms"][0].as_py()
    terms = body["term"].combine_chunks().dictionary_encode()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    seen = len(terms.dictionary)
    # one last row stands for the terms of the block that none of these sources has
    counts = np.zeros((seen + 1, len(sources)), np.int64)
    counts[terms.indices.to_numpy(), np.searchsorted(sources, body["sid"].to_numpy())] = body["n"].to_numpy()
    weights = np.ones(seen + 1, np.float32)
    weights[seen] = n_terms - seen
    lang, one, other = (block[c][0].as_py() for c in ("lang", "one", "other"))
    sides = []
    for side in {one, other}:
        mine = sources // width == side
        codes, starts, prices = _indicators(counts[:, mine], [int(t) for t in totals[mine]], v)
        sides.append((side, sources[mine], codes, starts, prices))
    sides.sort(key=lambda x: x[0])
    (_, ids, codes, starts, prices), (_, ids2, codes2, starts2, prices2) = sides[0], sides[-1]
    sums = np.zeros((len(ids), len(ids2)), np.int64)
    for i, j, n in joint_tables((codes, len(prices)), (codes2, len(prices2)), weights):
        p, q = prices[i], prices2[j]
        np.add.at(sums, (np.searchsorted(starts, i, "right") - 1, np.searchsorted(starts2, j, "right") - 1), (p - q) * (p - q) // (p + q) * n)
    a, b = (x.reshape(-1) for x in np.meshgrid(ids, ids2, indexing="ij"))
    pick = a < b
    a, b, value = a[pick], b[pick], sums.reshape(-1)[pick]
    return pa.table(
        {"lang": pa.array([lang] * 2 * len(a), pa.string()), "sid": np.concatenate([a, b]), "oid": np.concatenate([b, a]), "value": np.concatenate([value, value])}
    )


def _pair_values(full: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, sid, oid, value`` for every two sources of a language that has kept terms."""
    width = BLOCK_SOURCES

    def price(block: pa.Table) -> pa.Table:
        return _price_block(block, width)

    rank = F.floor(F.log2("lang_n")).cast("int")
    buckets = kept.groupBy("lang", rank.alias("bucket")).agg(F.ceil(F.count("*") / BLOCK_TERMS).alias("cuts"))
    buckets = share_if_small(cut(buckets), 200)
    cell = F.pmod(F.xxhash64("term"), F.col("cuts"))

    def placed(terms: DataFrame) -> DataFrame:
        return terms.withColumn("bucket", rank).join(buckets, ["lang", "bucket"]).withColumn("cell", cell)

    blocks = placed(kept).groupBy("lang", "bucket", "cell").agg(F.count("*").alias("terms"))
    side = F.floor(F.col("sid") / width).cast("int")
    sides = F.explode(F.sequence(F.lit(0), F.floor((F.col("s") - 1) / width).cast("int")))
    meets = [F.least("side", "t").alias("one"), F.greatest("side", "t").alias("other")]
    key = ["lang", "bucket", "cell", "one", "other"]
    heads = groups.where("v > 0").select("lang", "sid", "total", "v", side.alias("side"), sides.alias("t"))
    heads = heads.join(blocks, "lang").select(*key[:3], *meets, F.lit(None).cast("string").alias("term"), "sid", F.lit(0).cast("long").alias("n"), "total", "v", "terms")
    nil = F.lit(None).cast("long")
    ids = groups.select("lang", "source", "sid", "s")
    body = placed(full).join(share_if_small(ids, 200), ["lang", "source"]).select("*", side.alias("side"), sides.alias("t"))
    body = body.select(*key[:3], *meets, "term", "sid", "n", nil.alias("total"), nil.alias("v"), nil.alias("terms"))
    # within one side, the pair (side, side) is met once; across sides each row is sent once to every other side
    priced = heads.unionByName(body).groupBy(*key).applyInArrow(price, "lang string, sid long, oid long, value long")
    return priced.groupBy("lang", "sid", "oid").agg(F.sum("value").alias("value"))


# ------------------------------------------------------------------ the audit


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs, in whole numbers.

    Terms are runs of letters (ASCII letters and anything beyond ASCII), only
    A-Z lower-cased; null ``text``, ``lang`` and ``source`` count as empty. A
    language keeps the terms of at least ``MIN_DOCS`` of its documents. Part
    ``pair``: every other source of the language by summed price over all kept
    terms (0 if there are none). Part ``term``: the ten kept terms by which the
    source exceeds its language most. Ranks start at 1, ties go to the smaller
    item in UTF-8. A group without a term counts nothing of each kept term.
    Repeated rows are documents of their own; a table without rows gives none;
    other columns are ignored, whatever their names. A text is held whole by
    its task, its words in slices of 4 MB and the set of its distinct terms.

    Counting is done in the tasks that read the texts, and only sums are
    shuffled, by term. The pairs of sources of a language are all rows of the
    result, so their number is that of its sources squared.
    """
    counted = cut(term_counts(docs))
    kept = cut(
        counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d")).where(F.col("d") >= MIN_DOCS).drop("d")
    )
    full = cut(counted.join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    held = full.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    own = W.partitionBy("lang")
    groups = cut(
        counted.select("lang", "source").distinct()
        .join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
        .withColumn("sid", F.row_number().over(own.orderBy("source")).cast("long") - 1)
        .withColumn("s", F.count("*").over(own))
    )
    names = groups.select("lang", F.col("sid"), "source")
    values = _pair_values(full, kept, groups)
    none = groups.where("v = 0").select("lang", "sid")
    empty = none.join(none.select("lang", F.col("sid").alias("oid")), "lang").where("sid <> oid").withColumn("value", F.lit(0).cast("long"))
    pairs = values.unionByName(empty).join(names, ["lang", "sid"]).join(
        names.select("lang", F.col("sid").alias("oid"), F.col("source").alias("item")), ["lang", "oid"]
    )
    terms = full.join(share_if_small(groups.drop("sid", "s"), 200), ["lang", "source"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
    terms = terms.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    top = terms.select("*", rank).where(F.col("rank") <= TOP)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select("*", rank, F.lit("pair").alias("part")).select(*columns).unionByName(
        top.withColumn("part", F.lit("term")).select(*columns)
    )
