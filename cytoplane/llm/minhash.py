"""Near-duplicate documents by dart-throwing weighted MinHash.

Weighted set of a text: its five-word shingles, each weighing its number of
occurrences. Every unit of weight of a shingle is a region in which hashed
darts land as a Poisson process in rank: the arrival times are sums of
exponentials drawn from hashes of (shingle, unit, arrival), so two texts that
share a unit share its darts. Each dart belongs to one of ``COORDINATES``
coordinates; a coordinate keeps its earliest dart. Two signatures agree in a
coordinate with probability sum(min) / sum(max), the weighted Jaccard
similarity. Throwing stops at a rank at which each coordinate is expected to
have been hit; a text with a coordinate left empty throws on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.llm import bytework
from cytoplane.llm.common import bucket_links, components, share_if_small
from cytoplane.session import cut

WIDTH = 5
SIMILARITY = 0.8
COORDINATES = 64
BAND = 4
#: Of 64 four-bit agreements, a pair at 0.8 has 52 on average, deviation 3.1;
#: fewer than 38 has a probability below 1e-5.
AGREEMENTS = 38
_LONGS = COORDINATES // 16


# ---------------------------------------------------------------- signatures


def signatures(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int = COORDINATES) -> np.ndarray:
    """Dart kept by each coordinate, ``n_rows`` x ``k``; rows without shingles stay 0."""
    nth = bytework.occurrence(hashes, rows)
    regions = bytework.mix(hashes + bytework.mix(nth.astype(np.uint64)))
    out = np.zeros((n_rows, k), np.uint64)
    weight = np.bincount(rows, minlength=n_rows).astype(float)
    limit = np.divide(k * (math.log(k) + 4), weight, out=np.zeros(n_rows), where=weight > 0)
    todo = weight > 0
    while todo.any():
        mine = todo[rows]
        dart_row, dart_rank, dart = _throw(regions[mine], rows[mine], limit)
        cell = dart_row * k + (dart >> np.uint64(40)).astype(np.int64) % k
        order = np.lexsort((dart_rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        out.reshape(-1)[cell[first]] = dart[first]
        hit = np.bincount(cell[first] // k, minlength=n_rows)
        todo &= hit < k
        limit = limit * 2
    return out


def _throw(regions: np.ndarray, rows: np.ndarray, limit: np.ndarray):
    rank = np.zeros(len(regions))
    found = []
    arrival = 0
    while len(regions):
        dart = bytework.mix(regions + np.uint64((arrival + 1) * 0xA0761D6478BD642F & (2**64 - 1)))
        spread = bytework.mix(dart ^ np.uint64(0xE7037ED1A0B428DB))
        rank = rank - np.log(((spread >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
        keep = rank < limit[rows]
        regions, rows, rank, dart = regions[keep], rows[keep], rank[keep], dart[keep]
        found.append((rows, rank, dart))
        arrival += 1
    return tuple(np.concatenate(x) for x in zip(*found))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, raw, offsets in bytework.blocks(batch.column("text")):
            starts, ends, rows = bytework.word_bounds(raw, offsets)
            hashes, rows = bytework.shingles(bytework.word_hashes(raw, starts, ends), rows, WIDTH)
            kept = signatures(hashes, rows, high - low)
            bands = kept.reshape(high - low, COORDINATES // BAND, BAND)
            keys = np.zeros(bands.shape[:2], np.uint64)
            for c in range(BAND):
                keys = bytework.mix(keys + bands[:, :, c])
            keys += np.arange(keys.shape[1], dtype=np.uint64)
            nibbles = (kept & np.uint64(15)).reshape(high - low, _LONGS, 16)
            packed = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(low, high - low) for c in ("doc_id", "node", "copy")),
                    pa.array(np.bincount(rows, minlength=high - low).astype(np.int64)),
                    *(pa.array(packed[:, i].copy().view(np.int64)) for i in range(_LONGS)),
                    pa.FixedSizeListArray.from_arrays(
                        pa.array(bytework.mix(keys).view(np.int64).reshape(-1)), keys.shape[1]
                    ).cast(pa.list_(pa.int64())),
                ],
                names=["doc_id", "node", "copy", "n", *(f"s{i}" for i in range(_LONGS)), "bands"],
            )


_SIGNED = "doc_id long, node long, copy string, n long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


# ------------------------------------------------------------------- linking


def _near(a: str, b: str) -> Column:
    """May the two be alike: sizes within the ratio, and enough equal four-bit marks."""
    agreed = F.lit(0)
    for i in range(_LONGS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        agreed = agreed + F.lit(16) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small >= large * F.lit(SIMILARITY - 1e-9)) & (agreed >= AGREEMENTS)


def _weights(text: str) -> dict:
    words = bytework_words(text)
    counts: dict = {}
    for i in range(max(1, len(words) - WIDTH + 1)):
        s = tuple(words[i : i + WIDTH])
        counts[s] = counts.get(s, 0) + 1
    return counts


def bytework_words(text: str) -> list[str]:
    """Words between the six ASCII blanks (``str.split`` would also cut at other Unicode space)."""
    return [w for w in text.translate(_BLANKS).split(" ") if w]


_BLANKS = {c: " " for c in (9, 10, 11, 12, 13)}


def similarity(a: dict, b: dict) -> float:
    if len(b) < len(a):
        a, b = b, a
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
        keep = []
        for i in range(len(u)):
            if last[0] != v[i]:  # rows of one centre come together
                last = (v[i], _weights(batch.column("v_text")[i].as_py()))
            keep.append(similarity(_weights(batch.column("u_text")[i].as_py()), last[1]) >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _texts(nodes: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, text`` for each of ``nodes(node)``."""
    wanted = cut(nodes.join(reps.select("node", "copy"), "node"))
    return texts.join(share_if_small(wanted, 80), ["node", "copy"]).groupBy("node").agg(F.first("text").alias("text"))


def _linked(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose texts are alike by exact count."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    held = cut(_texts(nodes, reps, texts))
    left = pairs.join(held.select(F.col("node").alias("u"), F.col("text").alias("u_text")), "u")
    both = left.join(held.select(F.col("node").alias("v"), F.col("text").alias("v_text")), "v")
    return both.select("u", "v", "u_text", "v_text").mapInArrow(_verify, "u long, v long")


def _unit_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, raw, offsets in bytework.blocks(batch.column("text")):
            starts, ends, rows = bytework.word_bounds(raw, offsets)
            hashes, rows = bytework.shingles(bytework.word_hashes(raw, starts, ends), rows, WIDTH)
            units = bytework.mix(hashes + bytework.mix(bytework.occurrence(hashes, rows).astype(np.uint64)))
            edges = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=high - low))])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(units.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(low, high - low), lists], names=["node", "units"])


def _regions(held: DataFrame) -> DataFrame:
    """``node, units, shared``: a hash for each shingle and occurrence that another node has too, and their number.

    Weights are counts of units. Units that no other node has are in no
    intersection, so a node with too few others can be alike to none and is
    left out.
    """
    units = cut(held.select("node", "text").mapInArrow(_unit_hashes, "node long, units array<long>"))
    each = units.select("node", F.explode("units").alias("unit"))
    common = each.groupBy("unit").agg(F.count("*").alias("times")).where("times > 1").select("unit")
    kept = each.join(common, "unit").groupBy("node").agg(F.collect_list("unit").alias("units"), F.count("*").alias("shared"))
    sizes = units.select("node", F.size("units").alias("all"))
    return kept.join(sizes, "node").where(F.col("shared") >= F.col("all") * F.lit(SIMILARITY - 1e-9)).drop("all")


def _alike(a: str, b: str) -> Column:
    def reaches(both: Column) -> Column:
        return both >= (F.col(f"{a}.n") + F.col(f"{b}.n") - both) * F.lit(SIMILARITY - 1e-9)

    most = F.least(f"{a}.shared", f"{b}.shared")
    return reaches(most) & reaches(F.size(F.array_intersect(F.col(f"{a}.units"), F.col(f"{b}.units"))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, class_id``: one row per row of ``docs(doc_id, text)``.

    Texts are alike if the weighted Jaccard similarity of their five-word
    shingles is 0.8 or more (a text of one to four words has one shingle, of
    all its words); classes are the connected groups, and ``class_id`` is the
    least document id in the group. Equal texts are always one class. Candidates agree in all four
    coordinates of one of 16 bands (at 0.8, missed with probability 2e-4).

    Copies are merged before any join. In each bucket every text is compared
    with the bucket's first one; then, in buckets that still hold more than one
    group, texts of different groups are compared inside the join. So a group of
    copies costs rows in proportion to its size, and no link between groups is
    left out. Each candidate is verified on its whole text, or on the hashes of
    all its shingles.

    Null texts and texts without a word are alone in their class. Rows that
    share a ``doc_id`` are one document. A null ``doc_id`` gets a negative
    ``class_id`` member id made from the text. An empty table gives an empty
    result; other columns are ignored. ``copy`` is the MD5 of the text.
    """
    node = F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.shiftright(F.xxhash64("text"), 1)) - 1)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"), F.md5(F.coalesce("text", F.lit(""))).alias("copy"), "text"
    )
    signed = cut(texts.mapInArrow(_sign, _SIGNED))
    fields = ["node", "n", *(f"s{i}" for i in range(_LONGS))]
    inked = signed.where("n > 0")
    reps = cut(inked.groupBy("copy").agg(F.min(F.struct(*fields, "bands")).alias("r")).select("copy", "r.*"))

    spread = reps.select(*fields, F.explode("bands").alias("key"))
    links = bucket_links(
        spread, _near, lambda pairs: _linked(pairs, reps, texts), lambda nodes: _regions(_texts(nodes, reps, texts)), _alike
    )
    same_id = inked.join(reps.select("copy", F.col("node").alias("v")), "copy").where("node <> v").select(F.col("node").alias("u"), "v")
    groups = components(links.unionByName(same_id))
    return (
        signed.join(groups, "node", "left")
        .select("doc_id", "node", "copy", "n", F.coalesce("root", "node").alias("class_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates: that of the least id.

    Rows repeated with the same id and text count as one document and are
    reduced to one row; rows without text stay.
    """
    marked = cut(near_duplicates(docs).select("doc_id", "copy", "n", (F.col("node") != F.col("class_id")).alias("gone")))
    kept = docs.withColumn("__copy", F.md5(F.coalesce("text", F.lit(""))))

    def these(rows: DataFrame, how: str, wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.col("doc_id").alias("__id"), F.col("copy").alias("__c"))
        met = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__copy") == F.col("__c"))
        return rows.join(share_if_small(wanted, 100), met, how)

    kept = these(kept, "left_anti", cut(marked.where("gone").select("doc_id", "copy").distinct()))
    twice = cut(marked.where("n > 0 and not gone").groupBy("doc_id", "copy").count().where("count > 1"))
    if twice.isEmpty():
        return kept.drop("__copy")
    once = these(kept, "left_semi", twice).dropDuplicates(["doc_id", "__copy"])
    return these(kept, "left_anti", twice).unionByName(once).drop("__copy")
