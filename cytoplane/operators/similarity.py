"""Exact vector comparison, block against block.

Input tables hold ``id bigint, vec array<double>`` and optionally ``grp`` (only
rows of equal ``grp`` are compared) and ``label int`` (carried along).

Two physical forms give the same rows:

* *resident*: the reference side, once its measured size is below a bound, is
  broadcast as one matrix and query rows stream past it (no shuffle);
* *blocked*: both sides are cut into hash blocks of bounded size, every query
  block meets every reference block of its group in a task of its own, and
  only per-block results (k rows per query, or one row per query and label)
  leave the task. A group that holds a third of all rows just gets more blocks.

Similarities are rounded to ``DIGITS`` before they are ranked, so that the
result does not depend on block layout or on the order of a floating sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.session import cut

RESIDENT_BYTES = 64 << 20
BLOCK_BYTES = 32 << 20
TILE_CELLS = 4_000_000
DIGITS = 10

Kernel = Callable[[np.ndarray, np.ndarray, "Side"], pd.DataFrame]


class Side:
    """Reference rows of one block, ordered by id."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, labels: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vecs, self.labels = ids[order], vecs[order], labels[order]
        self.squares = np.einsum("ij,ij->i", self.vecs, self.vecs)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _tiles(n_rows: int, n_cols: int) -> Iterator[slice]:
    step = max(1, TILE_CELLS // max(1, n_cols))
    for start in range(0, n_rows, step):
        yield slice(start, start + step)


def _scores(q: np.ndarray, side: Side, metric: str) -> np.ndarray:
    dots = q @ side.vecs.T
    if metric == "euclidean":
        squares = np.einsum("ij,ij->i", q, q)[:, None] - 2 * dots + side.squares
        dots = -np.sqrt(np.maximum(squares, 0.0))
    return np.round(dots, DIGITS)


def topk_kernel(k: int, metric: str, drop_self: bool) -> Kernel:
    """The k best references of each query; equal scores go to the smaller id."""

    def run(ids: np.ndarray, vecs: np.ndarray, side: Side) -> pd.DataFrame:
        parts = []
        for tile in _tiles(len(ids), len(side.ids)):
            scores = _scores(vecs[tile], side, metric)
            if drop_self:
                scores[ids[tile][:, None] == side.ids[None, :]] = -np.inf
            kept = min(k, scores.shape[1])
            cutoff = np.partition(scores, -kept, axis=1)[:, -kept]
            row, col = np.nonzero((scores >= cutoff[:, None]) & (scores > -np.inf))
            score = scores[row, col]
            order = np.lexsort((col, -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.searchsorted(row, row, side="left")
            best = np.arange(len(row)) - first < k
            parts.append(
                pd.DataFrame(
                    {
                        "query_id": ids[tile][row[best]],
                        "ref_id": side.ids[col[best]],
                        "sim": score[best],
                        "label": side.labels[col[best]],
                    }
                )
            )
        return pd.concat(parts, ignore_index=True)

    return run


def label_sums_kernel(metric: str) -> Kernel:
    """Per query and reference label: number of references and summed score."""

    def run(ids: np.ndarray, vecs: np.ndarray, side: Side) -> pd.DataFrame:
        labels, place = np.unique(side.labels, return_inverse=True)
        pick = np.zeros((len(side.ids), len(labels)))
        pick[np.arange(len(side.ids)), place] = 1.0
        counts = pick.sum(axis=0).astype(np.int64)
        parts = []
        for tile in _tiles(len(ids), len(side.ids)):
            sums = _scores(vecs[tile], side, metric) @ pick
            n = sums.shape[0]
            parts.append(
                pd.DataFrame(
                    {
                        "query_id": np.repeat(ids[tile], len(labels)),
                        "label": np.tile(labels, n),
                        "n": np.tile(counts, n),
                        "total": sums.ravel(),
                    }
                )
            )
        return pd.concat(parts, ignore_index=True)

    return run


def summary_kernel() -> Kernel:
    """Per query: count, sum, smallest and largest inner product."""

    def run(ids: np.ndarray, vecs: np.ndarray, side: Side) -> pd.DataFrame:
        parts = []
        for tile in _tiles(len(ids), len(side.ids)):
            scores = _scores(vecs[tile], side, "inner")
            parts.append(
                pd.DataFrame(
                    {
                        "query_id": ids[tile],
                        "n": scores.shape[1],
                        "total": scores.sum(axis=1),
                        "low": scores.min(axis=1),
                        "high": scores.max(axis=1),
                    }
                )
            )
        return pd.concat(parts, ignore_index=True)

    return run


TOPK_SCHEMA = "query_id bigint, ref_id bigint, sim double, label int"
LABEL_SUMS_SCHEMA = "query_id bigint, label int, n bigint, total double"
SUMMARY_SCHEMA = "query_id bigint, n bigint, total double, low double, high double"


def _standard(df: DataFrame) -> DataFrame:
    group = F.col("grp").cast("string") if "grp" in df.columns else F.lit("")
    label = F.col("label").cast("int") if "label" in df.columns else F.lit(-1)
    return df.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("vec").cast("array<double>").alias("vec"),
        group.alias("grp"),
        label.alias("label"),
    )


def _resident(queries: DataFrame, refs: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    rows = refs.toPandas()  # measured below RESIDENT_BYTES by the caller
    sides = {
        g: Side(part["id"].to_numpy(), _matrix(part["vec"]), part["label"].to_numpy())
        for g, part in rows.groupby("grp")
    }
    shared = queries.sparkSession.sparkContext.broadcast(sides)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                if g in shared.value:
                    ids = part["id"].to_numpy()
                    yield kernel(ids, _matrix(part["vec"]), shared.value[g])

    return queries.select("id", "vec", "grp").mapInPandas(run, schema)


def _blocked(
    queries: DataFrame,
    refs: DataFrame,
    grouped: bool,
    kernel: Kernel,
    schema: str,
    block_rows: int,
) -> DataFrame:
    if grouped:

        def blocks(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("grp").agg(
                F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias(name)
            )

        layout = blocks(queries, "q_blocks").join(blocks(refs, "r_blocks"), "grp")
        queries, refs = queries.join(layout, "grp"), refs.join(layout, "grp")
    else:
        for name, df in (("q_blocks", queries), ("r_blocks", refs)):
            size = F.lit(-(-df.count() // block_rows))
            queries, refs = queries.withColumn(name, size), refs.withColumn(name, size)

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    left = queries.withColumn("qb", own("q_blocks")).withColumn("rb", every("r_blocks"))
    right = refs.withColumn("rb", own("r_blocks")).withColumn("qb", every("q_blocks"))
    empty = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({c: [] for c in empty})
        side = Side(r["id"].to_numpy(), _matrix(r["vec"]), r["label"].to_numpy())
        return kernel(q["id"].to_numpy(), _matrix(q["vec"]), side)

    key = ["grp", "qb", "rb"]
    return (
        left.select(*key, "id", "vec")
        .groupBy(*key)
        .cogroup(right.select(*key, "id", "vec", "label").groupBy(*key))
        .applyInPandas(run, schema)
    )


def _measured(refs: DataFrame) -> tuple[DataFrame, int, int]:
    """The references, written once as they are measured and then read again, their number and width."""
    refs = cut(_standard(refs))
    size = refs.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    return refs, size["n"] or 0, size["dim"] or 1


def compare(
    queries: DataFrame,
    refs: DataFrame,
    kernel: Kernel,
    schema: str,
    resident_bytes: int = RESIDENT_BYTES,
    block_rows: int | None = None,
    measured: tuple[DataFrame, int, int] | None = None,
) -> tuple[DataFrame, bool]:
    """Run a kernel over all query/reference pairs; True if each query met one side only.

    Blocks hold ``BLOCK_BYTES`` of vectors unless ``block_rows`` is given. A
    row is copied once per block of the other side, so larger blocks mean less
    to shuffle and more memory per task.
    """
    grouped = "grp" in refs.columns
    queries = _standard(queries)
    refs, n, dim = measured or _measured(refs)
    if n * (dim + 4) * 8 <= resident_bytes:
        return _resident(queries, refs, kernel, schema), True
    rows = block_rows or max(1, BLOCK_BYTES // (dim * 8))
    return _blocked(queries, refs, grouped, kernel, schema, rows), False


def _best_k(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "ref_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    metric: str = "inner",
    drop_self: bool = False,
    index: bool = True,
    **layout: int,
) -> DataFrame:
    """Exact neighbours: ``query_id, ref_id, sim, label, rank`` (rank from 1).

    For ``metric='euclidean'`` the score is the negated distance. References
    beyond the resident bound are searched through a metric index
    (``knn_indexed``) unless ``index`` is false or only rows of a group meet.
    """
    measured = _measured(refs)
    rows, n, dim = measured
    if index and "grp" not in refs.columns and n * (dim + 4) * 8 > layout.get("resident_bytes", RESIDENT_BYTES):
        return knn_indexed(queries, rows, k, metric, drop_self, layout.get("block_rows"))[0]
    found, _ = compare(queries, refs, topk_kernel(k, metric, drop_self), TOPK_SCHEMA, measured=measured, **layout)
    return _best_k(found, k)


# -------------------------------------------------------------- metric index

#: Most pivots; each is one vector on the driver and in every task.
PIVOTS = 1024
#: Bytes of vectors that a cell should hold: smaller cells are told apart better, but a query is sent to more of them.
CELL_BYTES = 4 << 20
_SENT = 4096


class _Cells:
    """Pivots with the number of references nearest to each and how far these reach."""

    def __init__(self, pivots: np.ndarray, rows: list, block_rows: int, metric: str):
        self.pivots, self.metric = pivots, metric
        self.size, self.far = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for r in rows:
            self.size[r["cell"]], self.far[r["cell"]] = r["n"], r["far"]
        self.blocks = -(-self.size // block_rows)

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each pivot, and the highest that any reference of its cell can have."""
        dots = q @ self.pivots.T
        if self.metric == "euclidean":
            squares = (q * q).sum(1)[:, None] - 2 * dots + (self.pivots * self.pivots).sum(1)
            centre = -np.sqrt(np.maximum(squares, 0.0))
            best = centre + self.far  # triangle inequality
        else:
            centre = dots
            best = dots + np.sqrt((q * q).sum(1))[:, None] * self.far  # Cauchy-Schwarz on the offset from the pivot
        return np.where(self.size > 0, centre, -np.inf), np.where(self.size > 0, best, -np.inf)

    def first(self, ids: np.ndarray, q: np.ndarray, enough: int) -> np.ndarray:
        """For each query, one block of each of the cells with the best pivots until these hold ``enough`` rows; else -1."""
        centre, _ = self.scores(q)
        order = np.argsort(-centre, axis=1, kind="stable")
        held = self.size[order] // np.maximum(self.blocks[order], 1)
        wanted = (np.cumsum(held, axis=1) - held < enough) & (self.size[order] > 0)
        out = np.full(centre.shape, -1)
        row, place = np.nonzero(wanted)
        cell = order[row, place]
        out[row, cell] = ids[row] % self.blocks[cell]
        return out


def _visits(cells: _Cells, enough: int, rest: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Blocks each query goes to: the first ones, or all others that can hold a row as good as its ``k``-th so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ids, q = batch["id"].to_numpy(), _matrix(batch["vec"])
            first = cells.first(ids, q, enough)
            if not rest:
                row, cell = np.nonzero(first >= 0)
                block = first[row, cell]
            else:
                _, best = cells.scores(q)
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(best), best, 0)).max(1))
                bar = batch["bar"].fillna(-np.inf).to_numpy(dtype=float) - slack
                row, cell = np.nonzero((best >= bar[:, None]) & (cells.size > 0))
                n = cells.blocks[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                new = first[row, cell] != block
                row, cell, block = row[new], cell[new], block[new]
            vecs = batch["vec"].to_numpy()
            for low in range(0, len(row), _SENT):  # a query may go to many blocks
                part = slice(low, low + _SENT)
                yield pd.DataFrame({"id": ids[row[part]], "vec": vecs[row[part]], "cell": cell[part], "block": block[part]})

    return run


_VISIT = "id bigint, vec array<double>, cell bigint, block bigint"


def _visit(visits: DataFrame, placed: DataFrame, kernel: Kernel, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Kernel rows of all visits, and the number of visits of each block.

    A block that many queries visit is met by them in slots of bounded size.
    """
    counts = cut(visits.groupBy("cell", "block").agg(F.count("*").alias("n")))
    slots = counts.withColumn("slots", F.ceil(F.col("n") / F.lit(block_rows)).cast("int")).drop("n")
    left = visits.join(slots, ["cell", "block"]).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"))
    right = placed.join(slots, ["cell", "block"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "ref_id", "sim", "label")})
        side = Side(r["id"].to_numpy(), _matrix(r["vec"]), r["label"].to_numpy())
        return kernel(q["id"].to_numpy(), _matrix(q["vec"]), side)

    key = ["cell", "block", "slot"]
    found = (
        left.select(*key, "id", "vec").groupBy(*key)
        .cogroup(right.select(*key, "id", "vec", "label").groupBy(*key))
        .applyInPandas(run, TOPK_SCHEMA)
    )
    return found, counts


def knn_indexed(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    metric: str = "inner",
    drop_self: bool = False,
    block_rows: int | None = None,
    pivots: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Exact neighbours as ``knn``, and ``visited, possible``: how many query-block meetings there were of all.

    Pivots are drawn once from the references, by hash: ``pivots`` of them, or
    one for every ``CELL_BYTES`` of vectors (4 at least, ``PIVOTS`` at most). Every
    reference belongs to its nearest pivot, and a pivot knows how far its
    cell reaches. A query first meets one block of each of the best cells until
    they hold ``k`` rows; its ``k``-th score there bars every cell whose best
    possible score, by the triangle inequality (or Cauchy-Schwarz for inner
    products), is lower, and it meets the blocks of the others. So clustered
    references are searched near the query only; on rows without structure all
    blocks may be visited, and the result is the same.
    """
    queries, refs = _standard(queries).select("id", "vec"), _standard(refs)
    n = refs.count()
    if n == 0:
        none = refs.select(F.col("id").alias("query_id"), F.col("id").alias("ref_id"), F.lit(0.0).alias("sim"), "label", F.lit(1).alias("rank"))
        return none, queries.agg(F.lit(0).cast("bigint").alias("visited"), F.lit(0).cast("bigint").alias("possible"))
    dim = refs.agg(F.max(F.size("vec"))).first()[0]
    wanted = pivots or min(PIVOTS, max(4, -(-n * dim * 8 // CELL_BYTES)))
    share = refs.orderBy(F.xxhash64("id"), "id").limit(min(wanted, n))
    centres = _matrix(share.select("vec").toPandas()["vec"])
    rows = block_rows or max(1, BLOCK_BYTES // (centres.shape[1] * 8))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["vec"])
            squares = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
            cell = squares.argmin(1)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield batch.assign(cell=cell, far=far)

    placed = cut(refs.select("id", "vec", "label").mapInPandas(place, "id bigint, vec array<double>, label int, cell bigint, far double"))
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each pivot
    cells = _Cells(centres, stats, rows, metric)
    blocks = F.element_at(F.array(*[F.lit(int(b)) for b in cells.blocks]), (F.col("cell") + 1).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).drop("far")
    kernel, enough = topk_kernel(k, metric, drop_self), k + int(drop_self)
    near, one = _visit(queries.mapInPandas(_visits(cells, enough, False), _VISIT), placed, kernel, rows)
    near = cut(_best_k(near, k).drop("rank"))
    bar = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("sim")).alias("bar"))
    others = queries.join(bar, "id", "left").mapInPandas(_visits(cells, enough, True), _VISIT)
    more, two = _visit(others, placed, kernel, rows)
    visited = one.unionByName(two).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("visited"))
    total = queries.agg((F.count("*") * F.lit(int(cells.blocks.sum()))).alias("possible"))
    return _best_k(near.unionByName(more), k), visited.crossJoin(total)


def label_sums(points: DataFrame, metric: str = "euclidean", **layout: int) -> DataFrame:
    """Per point and label: references and summed score (negated distances)."""
    found, single = compare(points, points, label_sums_kernel(metric), LABEL_SUMS_SCHEMA, **layout)
    if single:
        return found
    return found.groupBy("query_id", "label").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )


def similarity_summary(queries: DataFrame, refs: DataFrame, **layout: int) -> DataFrame:
    """All inner products of each query, summed up without writing out the pairs."""
    found, _ = compare(queries, refs, summary_kernel(), SUMMARY_SCHEMA, **layout)
    return found.groupBy("query_id").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
