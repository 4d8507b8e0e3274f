"""Applying a given attention encoder to cells, and fitting a linear stand-in.

Weights are data: gene vectors are a table ``gene_ix, vec``; the small arrays
(width x width at most) travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.functions.vectors import NORM_FLOOR, l2_normalize

# Fixed value: keeps the attention sum away from zero.
ATTENTION_EPSILON = 1e-7
RESIDENT_BYTES = 128 << 20


@dataclass(frozen=True)
class AttentionWeights:
    """One modality: value scale/shift, attention W, b, u, output scale/shift."""

    value_scale: float
    value_shift: float
    w: np.ndarray
    b: np.ndarray
    u: np.ndarray
    out_scale: np.ndarray
    out_shift: np.ndarray

    def hidden(self, vecs: np.ndarray, values: np.ndarray) -> np.ndarray:
        return vecs * (values * self.value_scale + self.value_shift)[:, None]

    def attention(self, hidden: np.ndarray) -> np.ndarray:
        return np.exp(np.tanh(hidden @ self.w + self.b) @ self.u)

    def finish(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled) * self.out_scale + self.out_shift


@dataclass(frozen=True)
class HeadWeights:
    """Dense layer after the pooled vectors: ``relu(z @ d + c)``."""

    d: np.ndarray
    c: np.ndarray


def _resident_genes(genes: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Gene vectors as sorted arrays if their measured size is below ``limit``."""
    size = genes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if (size["n"] or 0) * ((size["d"] or 0) + 2) * 8 > limit:
        return None
    rows = genes.select("gene_ix", "vec").toPandas().sort_values("gene_ix")
    return rows["gene_ix"].to_numpy(), np.stack(rows["vec"]).astype(float)


@dataclass(frozen=True)
class _Entries:
    """All entries of a batch of records that have a gene vector, in record order."""

    cells: pa.Array
    row: np.ndarray
    gene: np.ndarray
    vecs: np.ndarray
    value: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum ``x`` over the entries of each record; records without any give zero."""
        out = np.zeros((len(self.cells), *x.shape[1:]))
        if len(x):
            starts = np.flatnonzero(np.r_[True, np.diff(self.row) > 0])
            out[self.row[starts]] = np.add.reduceat(x, starts)
        return out


def _entries(batch: pa.RecordBatch, shared: tuple[np.ndarray, np.ndarray]) -> _Entries:
    index, vecs = shared
    feature, value = batch.column("feature"), batch.column("value")
    row = np.repeat(np.arange(batch.num_rows), feature.value_lengths().to_numpy(zero_copy_only=False))
    gene = feature.flatten().to_numpy(zero_copy_only=False)
    x = value.flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(index, gene), len(index) - 1)
    known = index[at] == gene
    return _Entries(batch.column("cell_id"), row[known], gene[known], vecs[at[known]], x[known])


def _lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def pool_cells(
    records: DataFrame, genes: DataFrame, weights: AttentionWeights, limit: int = RESIDENT_BYTES
) -> DataFrame:
    """Attention-pooled vector per cell: ``cell_id, z``.

    With gene vectors below ``limit`` records stream past the broadcast matrix,
    no shuffle. Beyond it, entries are joined to the vectors by gene and the
    two sums of the pooling are taken per cell with map-side combination.
    """
    resident = _resident_genes(genes, limit)
    if resident is None:
        return _pool_by_join(records, genes, weights)
    shared = records.sparkSession.sparkContext.broadcast(resident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _entries(batch, shared.value)
            h = weights.hidden(e.vecs, e.value)
            a = weights.attention(h)
            norm = e.sums(a) + ATTENTION_EPSILON
            z = weights.finish(e.sums(h * a[:, None]) / norm[:, None])
            yield pa.RecordBatch.from_arrays([e.cells, _lists(z)], ["cell_id", "z"])

    return records.select("cell_id", "feature", "value").mapInArrow(
        run, "cell_id bigint, z array<double>"
    )


def _pool_by_join(records: DataFrame, genes: DataFrame, weights: AttentionWeights) -> DataFrame:
    entries = records.select(
        "cell_id", F.explode(F.arrays_zip("feature", "value")).alias("e")
    ).select("cell_id", F.col("e.feature").alias("gene_ix"), F.col("e.value").alias("value"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                h = weights.hidden(np.stack(batch["vec"]), batch["value"].to_numpy())
                a = weights.attention(h)
                yield pd.DataFrame(
                    {"cell_id": batch["cell_id"], "a": a, "ah": list(h * a[:, None])}
                )

    scored = entries.join(genes, "gene_ix").mapInPandas(
        score, "cell_id bigint, a double, ah array<double>"
    )
    sums = scored.groupBy("cell_id").agg(
        F.sum("a").alias("norm"),
        vector_to_array(Summarizer.sum(array_to_vector("ah"))).alias("top"),
    )

    @F.pandas_udf("array<double>")
    def finish(top: pd.Series, norm: pd.Series) -> pd.Series:
        blank = np.zeros(len(weights.u))
        m = np.stack([blank if t is None else np.asarray(t, dtype=float) for t in top])
        n = norm.fillna(0.0).to_numpy() + ATTENTION_EPSILON
        return pd.Series(list(weights.finish(m / n[:, None])))

    # Cells without entries pool to zero.
    return records.select("cell_id").join(sums, "cell_id", "left").select(
        "cell_id", finish("top", "norm").alias("z")
    )


def apply_head(pooled: DataFrame, head: HeadWeights, normalize: bool = True) -> DataFrame:
    """Dense layer with relu on ``z``; rows scaled to unit length unless told not to."""

    @F.pandas_udf("array<double>")
    def dense(z: pd.Series) -> pd.Series:
        y = np.maximum(np.stack(z) @ head.d + head.c, 0.0)
        if normalize:
            y = y / np.sqrt(np.maximum((y * y).sum(axis=1, keepdims=True), NORM_FLOOR))
        return pd.Series(list(y))

    return pooled.select("cell_id", dense("z").alias("vec"))


def encode_cells(
    records: DataFrame, genes: DataFrame, weights: AttentionWeights, head: HeadWeights, **kw
) -> DataFrame:
    return apply_head(pool_cells(records, genes, weights, **kw), head)


def encode_two_modalities(
    left: tuple[DataFrame, DataFrame, AttentionWeights],
    right: tuple[DataFrame, DataFrame, AttentionWeights],
    head: HeadWeights,
) -> DataFrame:
    """Pooled vectors of both modalities are added before the dense layer."""
    a = pool_cells(*left)
    b = pool_cells(*right).withColumnRenamed("z", "z2")
    both = a.join(b, "cell_id").select(
        "cell_id", F.zip_with("z", "z2", lambda x, y: x + y).alias("z")
    )
    return apply_head(both, head)


def project_single_modality(
    left: tuple[DataFrame, DataFrame, AttentionWeights],
    right: tuple[DataFrame, DataFrame, AttentionWeights],
    head: HeadWeights,
    normalize: bool = False,
) -> DataFrame:
    """Joint embedding next to the one from the first modality alone."""
    joint = encode_two_modalities(left, right, head).withColumnRenamed("vec", "joint_vec")
    alone = apply_head(pool_cells(*left), head, normalize).withColumnRenamed("vec", "single_vec")
    return joint.join(alone, "cell_id")


def export_attention(
    records: DataFrame,
    genes: DataFrame,
    weights: AttentionWeights,
    modality: str,
    limit: int = RESIDENT_BYTES,
) -> DataFrame:
    """``cell_id, modality, gene_ix, weight``; weights of a cell sum to about one."""
    schema = "cell_id bigint, gene_ix bigint, weight double"
    resident = _resident_genes(genes, limit)
    if resident is not None:
        shared = records.sparkSession.sparkContext.broadcast(resident)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                e = _entries(batch, shared.value)
                a = weights.attention(weights.hidden(e.vecs, e.value))
                share = a / (e.sums(a) + ATTENTION_EPSILON)[e.row]
                yield pa.RecordBatch.from_arrays(
                    [e.cells.take(pa.array(e.row)), pa.array(e.gene), pa.array(share)],
                    ["cell_id", "gene_ix", "weight"],
                )

        out = records.select("cell_id", "feature", "value").mapInArrow(run, schema)
    else:
        entries = records.select(
            "cell_id", F.explode(F.arrays_zip("feature", "value")).alias("e")
        ).select("cell_id", F.col("e.feature").alias("gene_ix"), F.col("e.value").alias("value"))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    h = weights.hidden(np.stack(batch["vec"]), batch["value"].to_numpy())
                    yield pd.DataFrame(
                        {
                            "cell_id": batch["cell_id"],
                            "gene_ix": batch["gene_ix"],
                            "weight": weights.attention(h),
                        }
                    )

        raw = entries.join(genes, "gene_ix").mapInPandas(score, schema)
        norms = raw.groupBy("cell_id").agg(F.sum("weight").alias("norm"))
        out = raw.join(norms, "cell_id").select(
            "cell_id", "gene_ix", (F.col("weight") / (F.col("norm") + ATTENTION_EPSILON)).alias("weight")
        )
    return out.withColumn("modality", F.lit(modality))


def weighted_pool(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """Sum of gene vectors weighted by the cell's values: ``cell_id, pos, total``."""
    return (
        expr.join(genes, "gene_ix")
        .select("cell_id", "value", F.posexplode("vec").alias("pos", "x"))
        .groupBy("cell_id", "pos")
        .agg(F.sum(F.col("value") * F.col("x")).alias("total"))
    )


def fit_linear_embedding(cells: DataFrame, width: int) -> DataFrame:
    """Scaled principal components as unit vectors: ``cell_id, vec``.

    ``cells`` holds ``cell_id, features array<double>`` over the selected genes.
    """
    ready = cells.select("cell_id", array_to_vector("features").alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    scaled = scaler.fit(ready).transform(ready)
    model = PCA(k=width, inputCol="scaled", outputCol="pc").fit(scaled)
    return model.transform(scaled).select(
        "cell_id", l2_normalize(vector_to_array("pc")).alias("vec")
    )


# --------------------------------------------------- components of sparse rows


class _Scaled:
    """Rows of a sparse table, centred and scaled without being made dense: ``(x - mean) / deviation``."""

    def __init__(self, mean: np.ndarray, factor: np.ndarray):
        self.mean, self.factor = mean, factor

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, gene and value of each entry."""
        genes = batch.column("feature")
        row = np.repeat(np.arange(batch.num_rows), genes.value_lengths().to_numpy())
        return row, genes.flatten().to_numpy(), batch.column("value").flatten().to_numpy()

    def times(self, batch: pa.RecordBatch, basis: np.ndarray) -> np.ndarray:
        """The batch's rows times ``basis`` (genes x columns): the entries' part less that of the means."""
        row, gene, value = self.rows(batch)
        turned = basis * self.factor[:, None]
        out = np.empty((batch.num_rows, basis.shape[1]))
        for c in range(basis.shape[1]):
            out[:, c] = np.bincount(row, value * turned[gene, c], batch.num_rows)
        return out - self.mean @ turned

    def back(self, batch: pa.RecordBatch, scores: np.ndarray, n_genes: int) -> np.ndarray:
        """``scores`` of the rows times the rows, per gene, without the means' part (scores add up to zero over all rows)."""
        row, gene, value = self.rows(batch)
        parts = [np.bincount(gene, value * scores[row, c], n_genes) for c in range(scores.shape[1])]
        return np.stack(parts, 1) * self.factor[:, None]


def _summed(records: DataFrame, part, width: int) -> np.ndarray:
    """Genes x ``width``: what ``part`` gives for each batch, added up in the task, then by gene."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = part(batch)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), _lists(total)], names=["gene_ix", "s"])

    sums = records.select("feature", "value").mapInArrow(run, "gene_ix long, s array<double>")
    rows = sums.groupBy("gene_ix").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    out = rows.orderBy("gene_ix").collect()  # genes x width numbers
    return np.array([r["s"] for r in out]).reshape(-1, width)


def fit_sparse_embedding(
    records: DataFrame, n_genes: int, width: int, spare: int = 10, tolerance: float = 1e-4, rounds: int = 40, seed: int = 0
) -> tuple[DataFrame, np.ndarray]:
    """Scaled principal components of sparse records as unit vectors, ``cell_id, vec``, and the components' variances.

    ``records`` is ``cell_id, feature, value`` (gene indexes below ``n_genes``
    and their values; absent means zero). For any number of genes: a block of
    ``width + spare`` directions is multiplied by the covariance without ever
    forming it, each round one pass over the records in which a task adds up
    genes x columns numbers, until the variances settle within ``tolerance``. The
    driver holds genes x columns, never genes x genes. Centring is a correction
    of the products, so records stay sparse. A gene without spread counts zero.
    """
    n = records.count()
    if n < 2:
        raise ValueError("components need two cells at least")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        gene, value = batch.column("feature").flatten().to_numpy(), batch.column("value").flatten().to_numpy()
        return np.stack([np.bincount(gene, value, n_genes), np.bincount(gene, value * value, n_genes)], 1)

    sums = _summed(records, moments, 2)
    mean = sums[:, 0] / n
    variance = np.maximum(sums[:, 1] - n * mean * mean, 0.0) / (n - 1)
    live = variance > 1e-12 * np.maximum(sums[:, 1] / n, 1e-300)
    table = _Scaled(mean, np.where(live, 1 / np.sqrt(np.where(live, variance, 1.0)), 0.0))
    columns = min(width + spare, n_genes)
    width = min(width, columns)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_genes, columns)))
    before = np.zeros(columns)
    for _ in range(rounds):
        now = basis

        def turn(batch: pa.RecordBatch) -> np.ndarray:
            return table.back(batch, table.times(batch, now), n_genes)

        image = _summed(records, turn, columns) / (n - 1)
        inner = now.T @ image
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        best = now @ mix  # the best directions within the block, before it is turned further
        if (np.abs(values - before)[:width] <= tolerance * max(values[0], 1e-300)).all():
            basis = best
            break
        before = values
        basis, _ = np.linalg.qr(image @ mix)
    kept = basis[:, :width]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), _lists(table.times(batch, kept))], names=["cell_id", "vec"])

    scored = records.select("cell_id", "feature", "value").mapInArrow(score, "cell_id long, vec array<double>")
    return scored.select("cell_id", l2_normalize(F.col("vec")).alias("vec")), values[:width]
