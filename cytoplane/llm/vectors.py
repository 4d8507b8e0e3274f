"""Near-duplicate vectors by a pigeonhole join over subspaces.

Two unit vectors have a cosine of ``t`` or more exactly if their squared
distance is at most ``2 - 2 t``. All vectors are turned by one seeded rotation,
which spreads that distance over the coordinates, and cut into blocks of few
dimensions. Each block gets a part of the allowed squared distance in
proportion to its dimensions, so every pair within the whole allowance is
within the part of one block at least: the pigeonhole.

So each block is joined by itself. Its subspace is cut into boxes, at medians
of a bounded sample; a vector stands in its own box and visits the boxes
nearer to it than the block's radius, and boxes meet pairwise, each pair of
them a task of bounded size. Candidates of all blocks are tested on whole
vectors in double precision. A pair found in several blocks counts in the first
of them, so links are counted without ever being written out, and what a task
returns is a number of links and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import components, share_if_small
from cytoplane.session import cut

COSINE = 0.9
#: Dimensions of a block; fewer make boxes more telling, more make fewer candidates.
DIMS = 16
#: Vectors the boxes are cut from (places only, no result depends on them), and the least a box gets of them.
SAMPLE, LEAF = 16_384, 16
#: Bytes of the vectors of one box in a task, in double precision; a box with more is dealt to several tasks.
TILE_BYTES = 8 << 20
#: Boxes at least, so that small tables use all cores.
BOXES = 4
_STEP = 512
_DENSE = 0.02
_SLACK = 1e-9


# ------------------------------------------------------------------ geometry


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A seeded orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int) -> list[int]:
    """First coordinate of each block, and the end; sizes differ by one at most."""
    n = max(1, round(dims / DIMS))
    return [dims * b // n for b in range(n + 1)]


class Boxes:
    """A block's subspace cut at medians: ``plane`` cuts coordinate ``axis`` at ``at``."""

    def __init__(self, sample: np.ndarray, wanted: int):
        self.axis: list[int] = []
        self.at: list[float] = []
        self.down: list[tuple[int, int]] = []  # a child: a plane, or -1 - box
        self.n = 0
        self.top = self._cut(sample, wanted)

    def _cut(self, rows: np.ndarray, wanted: int) -> int:
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(1)
        axis = int(spread.argmax())
        if wanted < 2 or len(rows) < 2 * LEAF or spread[axis] <= 0:
            self.n += 1
            return -self.n
        at = float(np.median(rows[:, axis]))
        low = rows[:, axis] < at
        if not low.any():
            at = float(rows[rows[:, axis] > at, axis].min())
            low = rows[:, axis] < at
        plane = len(self.axis)
        self.axis.append(axis)
        self.at.append(at)
        self.down.append((0, 0))
        self.down[plane] = (self._cut(rows[low], wanted // 2), self._cut(rows[~low], wanted - wanted // 2))
        return plane

    def visits(self, x: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray]]:
        """``box, rows`` of ``x`` nearer to the box than ``reach``; reach 0 gives each row its own box only."""
        todo = [(self.top, np.arange(len(x)), np.zeros(len(x)), {})]
        while todo:
            node, rows, far, held = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            axis, at = self.axis[node], self.at[node]
            gap = x[rows, axis] - at
            for child, own in ((self.down[node][0], gap < 0), (self.down[node][1], gap >= 0)):
                before = held.get(axis, np.zeros(len(rows)))
                # distance to the half space along this axis replaces a smaller one noted before
                now = np.where(own, before, np.maximum(before, np.abs(gap)))
                total = far - before**2 + now**2
                keep = own if reach == 0 else total <= reach * reach
                later = {a: v[keep] for a, v in held.items()} | {axis: now[keep]}
                todo.append((child, rows[keep], total[keep], later))


# --------------------------------------------------------------------- links


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the parts of ``label`` that the pairs connect; a part is labelled by its least member."""
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _sums(x: np.ndarray, y: np.ndarray, f: Callable) -> np.ndarray:
    """Sum over columns in fixed order, so that a pair gives the same number wherever it is worked out."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total += f(x[:, c], y[:, c])
    return total


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a - b) ** 2


class _Tile:
    """Pairs of two sets of turned unit vectors that one block is to count."""

    def __init__(self, edges: list[int], block: int, cosine: float):
        self.edges, self.block, self.cosine = edges, block, cosine
        self.budget = [(2 - 2 * cosine) * (b - a) / edges[-1] + _SLACK for a, b in zip(edges, edges[1:])]

    def _part(self, x: np.ndarray, b: int) -> np.ndarray:
        return x[:, self.edges[b] : self.edges[b + 1]]

    def _exact(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of listed pairs: alike, within this block's part, and within that of no earlier block."""
        keep = np.ones(len(i), bool)
        for low in range(0, len(i), 1 << 16):
            a, b = x[i[low : low + (1 << 16)]], y[j[low : low + (1 << 16)]]
            part = _sums(a, b, np.multiply) >= self.cosine
            for block in range(self.block + 1):
                inside = _sums(self._part(a, block), self._part(b, block), _square) <= self.budget[block]
                part &= inside if block == self.block else ~inside
            keep[low : low + (1 << 16)] = part
        return keep

    def _dense(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Same as ``_exact`` for all pairs, by products; pairs too near a bound to tell are worked out one by one."""
        like = x @ y.T
        keep, doubt = like >= self.cosine, np.abs(like - self.cosine) < _SLACK / 10
        for block in range(self.block + 1):
            a, b = self._part(x, block), self._part(y, block)
            far = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
            doubt |= np.abs(far - self.budget[block]) < _SLACK / 10
            keep &= (far <= self.budget[block]) == (block == self.block)
        i, j = np.nonzero(doubt)
        keep[i, j] = self._exact(x, y, i, j)
        return np.nonzero(keep)

    def pairs(self, x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of ``x``, row of ``y``) in pieces; of one set with itself, each pair once."""
        a, b = (self._part(z, self.block) for z in (x, y))
        ones = np.ones((len(x), 1)), np.ones((len(y), 1))
        # squared distances as one product: (-2 a, |a|^2, 1) . (b, 1, |b|^2)
        a = np.hstack([-2 * a, (a * a).sum(1, keepdims=True), ones[0]]).astype(np.float32)
        b = np.hstack([b, ones[1], (b * b).sum(1, keepdims=True)]).astype(np.float32)
        bound = np.float32(self.budget[self.block] + 1e-5)  # above the rounding of single precision
        for low in range(0, len(x), _STEP):
            for other in range(low if same else 0, len(y), _STEP):
                rows, cols = slice(low, low + _STEP), slice(other, other + _STEP)
                near = a[rows] @ b[cols].T <= bound
                found = np.count_nonzero(near)
                if not found:
                    continue
                if found > _DENSE * near.size:
                    i, j = self._dense(x[rows], y[cols])
                else:
                    i, j = np.nonzero(near)
                    keep = self._exact(x[rows], y[cols], i, j)
                    i, j = i[keep], j[keep]
                if same and low == other:
                    once = i < j
                    i, j = i[once], j[once]
                if len(i):
                    yield i + low, j + other


def _meet(block: pa.Table, edges: list[int], turn: np.ndarray, cosine: float) -> pa.Table:
    """Numbers of links and a spanning forest within one pair of boxes: ``node, links, root``."""
    dims = edges[-1]
    node, times = block["node"].to_numpy(), block["times"].to_numpy()
    x = _unit(np.frombuffer(b"".join(block["raw"].to_pylist()), np.float64).reshape(-1, dims)) @ turn
    side = block["side"].to_numpy()
    order = np.lexsort((node, side))
    node, times, x, side = node[order], times[order], x[order], side[order]
    half = int(np.searchsorted(side, 1))
    same = block["p"][0].as_py() == block["q"][0].as_py()
    tile = _Tile(edges, block["block"][0].as_py(), cosine)
    second = 0 if same else half
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    for i, j in tile.pairs(x[:half], x[second:], same):
        j = j + second
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        _unite(label, i, j)
    hit = links > 0
    return pa.table({"node": node[hit], "links": links[hit], "root": node[label[hit]]})


_MET = "node long, links long, root long"


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest part first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("v")
        data = np.ascontiguousarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).tobytes()
        ends = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy()) * 8])
        held = [data[a:b] for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "times", "dims")), pa.array(held, pa.binary())], names=["node", "times", "dims", "raw"])


def _place(batches: Iterator[pa.RecordBatch], boxes: list[Boxes], edges: list[int], turn: np.ndarray, cosine: float, slots: dict | None):
    """Without ``slots``, the box of each vector in each block; with them, a row for each meeting of its tile."""
    reach = [float(np.sqrt((2 - 2 * cosine) * (b - a) / edges[-1] + _SLACK)) + 1e-9 for a, b in zip(edges, edges[1:])]
    for batch in batches:
        x = _unit(np.frombuffer(b"".join(batch.column("raw").to_pylist()), np.float64).reshape(-1, edges[-1])) @ turn
        node = batch.column("node").to_numpy()
        for b, cells in enumerate(boxes):
            part = x[:, edges[b] : edges[b + 1]]
            home = np.zeros(len(x), np.int64)
            for box, rows in cells.visits(part, 0):
                home[rows] = box
            if slots is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), b)), pa.array(home)], names=["block", "box"])
                continue
            first, n = slots[b]
            own = first[home] + (node * 0x9E3779B1 >> 7) % n[home]
            for box, rows in cells.visits(part, reach[b]):
                for tile in range(first[box], first[box] + n[box]):
                    mine = own[rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), b)),
                            pa.array(np.minimum(mine, tile)),
                            pa.array(np.maximum(mine, tile)),
                            pa.array((mine > tile).astype(np.int64)),
                            *(batch.column(c).take(pa.array(rows)) for c in ("node", "times", "raw")),
                        ],
                        names=["block", "p", "q", "side", "node", "times", "raw"],
                    )


def _links_of(nodes: DataFrame, dims: int, n: int, cosine: float) -> DataFrame:
    """``node, links, root`` pieces for all nodes of ``dims`` dimensions."""
    edges, turn = block_edges(dims), rotation(dims)
    nodes = nodes.where(F.col("dims") == dims).select("node", "times", "raw")
    most = max(1, TILE_BYTES // (8 * dims))
    wanted = max(BOXES, -(-n // most))
    share = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE) if n > SAMPLE else nodes
    held = share.select("raw").toArrow()["raw"].to_pylist()
    sample = _unit(np.frombuffer(b"".join(held), np.float64).reshape(-1, dims)) @ turn
    boxes = [Boxes(sample[:, a:b], wanted) for a, b in zip(edges, edges[1:])]
    place = partial(_place, boxes=boxes, edges=edges, turn=turn, cosine=cosine)
    sizes = nodes.mapInArrow(partial(place, slots=None), "block long, box long").groupBy("block", "box").count().collect()
    slots = {}
    for b, cells in enumerate(boxes):
        each = np.ones(cells.n, np.int64)
        for row in sizes:
            if row["block"] == b:
                each[row["box"]] = max(1, -(-row["count"] // most))
        slots[b] = (np.concatenate([[0], np.cumsum(each)[:-1]]), each)
    dealt = nodes.mapInArrow(partial(place, slots=slots), "block long, p long, q long, side long, node long, times long, raw binary")

    def meet(block: pa.Table) -> pa.Table:
        return _meet(block, edges, turn, cosine)

    return dealt.groupBy("block", "p", "q").applyInArrow(meet, _MET)


def near_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``rows``.

    Vectors are linked if their cosine, in double precision, is ``cosine`` (above
    0, below 1) or more. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable by links. A vector that is
    null, empty or zero or holds null, NaN or infinity links with nothing, nor
    do vectors of different lengths. Equal vectors are one node with a count, so
    exact copies cost nothing; rows that repeat an id are rows of their own, and
    a null id is never a ``component_id`` unless all its component's are null.
    ``kept`` is false for a null id. An empty table gives an empty result; other
    columns are ignored, whatever their names.

    Every row is compared with every other that comes within a block's part of
    the allowance of it, none is capped or sampled. Boxes are bounded by bytes:
    one that holds a third of all rows is dealt to as many tiles as it needs. The
    number of comparisons within such a crowd of different vectors is still its
    square, in products of matrices; vectors without any structure visit nearly
    all boxes (random directions are as far apart in each block as in all).
    """
    value = F.col(vector).cast("array<double>")
    ill = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = (F.size(value) > 0) & ~ill & F.exists(value, lambda x: x != 0)
    table = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.when(able, F.transform(value, lambda x: x + F.lit(0.0))).alias("v"))
    distinct = table.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("v")))
    raw = nodes.select("node", "times", "dims", "v").mapInArrow(_raw, "node long, times long, dims int, raw binary")
    widths = nodes.groupBy("dims").count().where("count > 1").collect()  # a row for each length of a vector
    met = None
    for width in widths:
        part = _links_of(raw, width["dims"], width["count"], cosine)
        met = part if met is None else met.unionByName(part)
    if met is None:
        met = nodes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root")).where("1 = 0")
    met = cut(met)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(met.select(F.col("node").alias("u"), F.col("root").alias("v")))
    marked = nodes.join(links, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marked = cut(marked.select("node", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    heads = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = marked.join(heads, "root").join(nodes.select("node", "v"), "node").select("v", "n_links", "component_id")
    return table.join(share_if_small(found, F.lit(64) + 8 * F.size("v")), "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(F.col("v").isNull(), F.col("vec_id").isNotNull()).otherwise(F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )
