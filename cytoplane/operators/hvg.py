"""Highly variable genes by binned, normalised dispersion.

Definition used here, on log1p values with absent rows counted as zero:

1. undo the log; mean and sample variance of each gene over all cells;
2. a zero mean becomes 1e-12; dispersion = variance / mean, zero -> missing,
   then its natural log; the mean becomes log1p(mean);
3. 20 equal-width bins of the mean, right-closed, lowest edge included;
4. normalised dispersion = (d - bin mean) / bin sample deviation; a bin with a
   single gene scores 1;
5. with a number of genes: keep scores >= the N-th largest (ties keep more),
   otherwise cut-offs on mean and score;
6. with batches: run per batch over the genes seen in it, then take exactly N
   by (number of batches that keep the gene, mean score over all batches, a
   batch without the gene giving it zero), gene index last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.session import cut

# Fixed values.
MEAN_FLOOR = 1e-12
BINS = 20
MIN_MEAN, MAX_MEAN, MIN_DISPERSION = 0.0125, 3.0, 0.5


def gene_moments(expr: DataFrame, cells: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Mean and sample variance of un-logged values per gene (and batch).

    ``cells`` is ``cell_id`` or ``cell_id, batch``; ``expr`` may carry the batch
    itself. Without batches, ``genes`` adds the genes no cell shows.
    """
    by = ["batch"] if "batch" in cells.columns else []
    if by:
        if "batch" not in expr.columns:
            expr = expr.join(cells.select("cell_id", *by), "cell_id")
        size = cells.groupBy(*by).agg(F.count("*").alias("n"))
    else:
        size = cells.agg(F.count("*").alias("n"))
    raw = F.expm1("value")
    sums = expr.groupBy(*by, "gene_id").agg(
        F.sum(raw).alias("s"), F.sum(raw * raw).alias("q")
    )
    if by:
        joined = sums.join(size, by)
    else:
        if genes is not None:
            sums = genes.select("gene_id").join(sums, "gene_id", "left").na.fill(0.0, ["s", "q"])
        joined = sums.withColumn("n", size.scalar())
    mean = F.col("s") / F.col("n")
    variance = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    return joined.select(*by, "gene_id", mean.alias("mean"), variance.alias("variance"))


def normalized_dispersion(moments: DataFrame) -> DataFrame:
    """Adds ``log_mean, bin, dispersion, score`` to the moments."""
    if "batch" not in moments.columns:
        whole = normalized_dispersion(moments.withColumn("batch", F.lit(0)))
        return whole.drop("batch")
    by = ["batch"]
    # One row per gene and batch: written once, so that the steps below do not
    # each go back to the expression table.
    moments = cut(moments)
    mean = F.when(F.col("mean") == 0, F.lit(MEAN_FLOOR)).otherwise(F.col("mean"))
    spread = moments.withColumn("log_mean", F.log1p(mean)).withColumn(
        "dispersion", F.when(F.col("variance") > 0, F.log(F.col("variance") / mean))
    )
    edges = spread.groupBy(*by).agg(
        F.min("log_mean").alias("lo"), F.max("log_mean").alias("hi")
    )
    ranged = spread.join(edges, by)
    share = (F.col("log_mean") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    place = F.greatest(F.lit(1), F.ceil(F.lit(BINS) * F.coalesce(share, F.lit(0.0))))
    binned = ranged.withColumn("bin", place.cast("int")).drop("lo", "hi")
    bins = binned.groupBy(*by, "bin").agg(
        F.avg("dispersion").alias("m"),
        F.stddev_samp("dispersion").alias("sd"),
        F.count("dispersion").alias("genes"),
    )
    score = F.when(F.col("dispersion").isNull(), None).when(F.col("genes") == 1, F.lit(1.0)).otherwise(
        (F.col("dispersion") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))
    )
    return binned.join(bins, [*by, "bin"]).withColumn("score", score).drop("m", "sd", "genes")


def _at_least_nth(scored: DataFrame, n: int) -> DataFrame:
    """Rows whose score reaches the n-th largest (of their batch)."""
    by = ["batch"] if "batch" in scored.columns else []
    known = scored.where(F.col("score").isNotNull())
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc("score"))
        top = known.select(*by, "score", F.row_number().over(order).alias("r")).where(F.col("r") <= n)
        floor = top.groupBy(*by).agg(F.min("score").alias("floor"))
        return known.join(floor, by).where(F.col("score") >= F.col("floor")).drop("floor")
    floor = known.select("score").orderBy(F.desc("score")).limit(n).agg(F.min("score").alias("floor"))
    least = floor.first()["floor"]
    return known.where(F.col("score") >= F.lit(least)) if least is not None else known


def select_hvg(
    moments: DataFrame,
    n_top: int | None = None,
    min_mean: float = MIN_MEAN,
    max_mean: float = MAX_MEAN,
    min_score: float = MIN_DISPERSION,
) -> DataFrame:
    """Selected genes (per batch if there are batches) with mean and score."""
    scored = cut(normalized_dispersion(moments))
    if n_top is not None:
        return _at_least_nth(scored, n_top)
    return scored.where(
        (F.col("log_mean") > min_mean) & (F.col("log_mean") < max_mean) & (F.col("score") > min_score)
    )


def select_hvg_batched(moments: DataFrame, n_top: int) -> DataFrame:
    """Exactly ``n_top`` genes over all batches: ``gene_id, n_batches, score``."""
    scored = cut(normalized_dispersion(moments))
    kept = _at_least_nth(scored, n_top).select("batch", "gene_id", F.lit(1).alias("hit"))
    merged = scored.join(kept, ["batch", "gene_id"], "left")
    # Batches that do not show the gene count as zero; those in which it has no score do not count.
    n_batches = scored.agg(F.countDistinct("batch")).scalar()
    counted = n_batches - F.count("*") + F.count("score")
    mean = F.coalesce(F.sum("score"), F.lit(0.0)) / F.nullif(counted, F.lit(0))
    genes = merged.groupBy("gene_id").agg(F.count("hit").alias("n_batches"), F.round(mean, 10).alias("score"))
    return genes.orderBy(
        F.desc("n_batches"), F.col("score").desc_nulls_last(), "gene_id"
    ).limit(n_top)


def shared_hvg(left: DataFrame, right: DataFrame) -> DataFrame:
    """Genes selected on both sides."""
    return left.select("gene_id").join(right.select("gene_id"), "gene_id", "left_semi")
