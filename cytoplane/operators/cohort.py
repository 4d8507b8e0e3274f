"""Cohort statistics: composition, means, markers, box figures, rank-sum tests."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoplane.functions.vectors import two_sided_normal_p
from cytoplane.operators.ordering import exact_quantiles, with_running_sums
from cytoplane.session import cut

#: A dimension measured to be smaller than this may stand beside every row.
SHARED_BYTES = 16 << 20

# Fixed values.
WHISKER = 1.5
STARS = [(1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (5e-2, "*")]


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def with_each(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Every row beside every row of ``others``, a dimension (labels, sets, samples).

    A dimension measured to be below ``SHARED_BYTES`` becomes one array beside
    each row and is unfolded in place, without a shuffle. A larger one is dealt
    into blocks of about that size; each row is sent to every block, by a join on
    the block's number, and unfolded there.
    """
    entry = F.struct(*others.columns)
    others = cut(others)
    size = others.agg(F.sum(F.octet_length(F.to_json(entry)) + F.lit(16 * len(others.columns)))).first()[0] or 0
    blocks = -(-size // SHARED_BYTES)
    if blocks <= 1:
        entries = others.agg(F.collect_list(entry).alias("e"))
        return rows.withColumn("__e", F.explode(entries.scalar())).select(*rows.columns, "__e.*")
    dealt = others.groupBy(F.pmod(F.xxhash64(*others.columns), F.lit(blocks)).alias("__b")).agg(F.collect_list(entry).alias("__e"))
    sent = rows.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return sent.join(dealt, "__b").withColumn("__e", F.explode("__e")).select(*rows.columns, "__e.*")


def composition(rows: DataFrame, cluster: str, sample: str) -> DataFrame:
    """Share of each cluster within each sample, zeros kept: ``sample, cluster, share``.

    A missing cluster or sample is one of its own and counts in the totals.
    """
    counts = rows.groupBy(sample, cluster).agg(F.count("*").alias("__n"))
    totals = rows.groupBy(sample).agg(F.count("*").alias("__all"))
    grid = with_each(totals, rows.select(cluster).distinct())
    seen = counts.select(F.col(sample).alias("__s"), F.col(cluster).alias("__c"), "__n")
    met = F.col(sample).eqNullSafe(F.col("__s")) & F.col(cluster).eqNullSafe(F.col("__c"))
    share = F.coalesce("__n", F.lit(0)) / F.col("__all")
    return grid.join(seen, met, "left").select(sample, cluster, share.alias("share"))


def attach_group(rows: DataFrame, obs: DataFrame, sample: str, group: str) -> DataFrame:
    """Left join of sample-level rows to the distinct (sample, group) pairs."""
    return rows.join(obs.select(sample, group).distinct(), sample, "left")


def mean_by_sample(expr: DataFrame, obs: DataFrame, genes: DataFrame, sample: str = "sample") -> DataFrame:
    """Mean of the genes in ``genes(gene_id)`` per sample over all its cells, absent rows as zero."""
    genes = genes.select("gene_id").distinct()
    sizes = obs.groupBy(sample).agg(F.count("*").alias("n_cells"))
    sums = (
        expr.join(genes, "gene_id", "left_semi")
        .join(obs.select("cell_id", sample), "cell_id")
        .groupBy(sample, "gene_id")
        .agg(F.sum("value").alias("__s"))
    )
    mean = F.coalesce("__s", F.lit(0.0)) / F.col("n_cells")
    return (
        with_each(genes, sizes)
        .join(sums, [sample, "gene_id"], "left")
        .select(sample, "n_cells", "gene_id", mean.alias("mean_value"))
    )


def box_stats(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends at 1.5 IQR and outliers per group."""
    group = list(group)
    quartiles = exact_quantiles(rows, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.lit(WHISKER) * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - spread) & (F.col(value) <= F.col("q3") + spread)
    return (
        rows.join(quartiles, group)
        .groupBy(*group, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("low_whisker"),
            F.max(F.when(inside, F.col(value))).alias("high_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def marker_table(expr: DataFrame, obs: DataFrame, markers: DataFrame, label: str) -> DataFrame:
    """Per label and marker gene: mean value and share of cells above zero."""
    genes = markers.select("gene_id").distinct()
    sizes = obs.groupBy(label).agg(F.count("*").alias("n_cells"))
    seen = (
        expr.join(genes, "gene_id", "left_semi")
        .join(obs.select("cell_id", label), "cell_id")
        .groupBy(label, "gene_id")
        .agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("c"))
    )
    wanted = with_each(markers.select("set_name", "gene_id"), sizes.where(F.col(label).isNotNull()))
    return (
        wanted.join(seen, [label, "gene_id"], "left")
        .select(
            "set_name",
            "gene_id",
            label,
            (F.coalesce("s", F.lit(0.0)) / F.col("n_cells")).alias("mean_value"),
            (F.coalesce("c", F.lit(0)) / F.col("n_cells")).alias("share_above_zero"),
        )
    )


def marker_heatmap(expr: DataFrame, obs: DataFrame, genes: DataFrame, label: str) -> DataFrame:
    """Min-max scaling per cell over the marker genes; a constant cell scales to zero.

    Markers without a row count as zero in the cell's range.
    """
    n_genes = genes.select("gene_id").distinct().count()
    chosen = expr.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    seen = chosen.groupBy("cell_id").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")
    )
    gap = F.col("n") < F.lit(n_genes)
    ranges = seen.select(
        "cell_id",
        F.when(gap, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
        F.when(gap, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"),
    )
    scaled = F.coalesce(
        (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0)
    )
    return (
        chosen.join(ranges, "cell_id")
        .join(obs.select("cell_id", label), "cell_id")
        .select(label, "cell_id", "gene_id", scaled.alias("scaled"))
    )


def signature_score(expr: DataFrame, cells: DataFrame, markers: DataFrame, n_genes: int) -> DataFrame:
    """Per cell and set: mean of the set's values minus the mean over all genes.

    Absent rows count as zero, so the sums are divided by the set's size and
    by ``n_genes``; every cell is scored for every set.
    """
    sizes = markers.groupBy("set_name").agg(F.countDistinct("gene_id").alias("set_size"))
    whole = expr.groupBy("cell_id").agg(F.sum("value").alias("all_sum"))
    inside = (
        expr.join(markers.select("set_name", "gene_id").distinct(), "gene_id")
        .groupBy("cell_id", "set_name")
        .agg(F.sum("value").alias("set_sum"))
        .groupBy("cell_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("set_name", "set_sum"))).alias("sums"))
    )  # a cell's own sets
    zero = F.lit(0.0)
    own = F.coalesce(F.try_element_at("sums", F.col("set_name")), zero)
    score = own / F.col("set_size") - F.coalesce("all_sum", zero) / F.lit(n_genes)
    cells = cells.select("cell_id").join(whole, "cell_id", "left").join(inside, "cell_id", "left")
    return with_each(cells, sizes).select("cell_id", "set_name", score.alias("score"))


def ranks_with_ties(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average rank of each distinct value: ``*by, value, n, rank``.

    Equal values are counted before the sort, so a value shared by a third of
    all rows is one row in it.
    """
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    run = with_running_sums(counted, list(by), [value], {"upto": "n"})
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    return run.select(*by, value, "n", rank.alias("rank"))


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(two_sided_normal_p, na_action="ignore")


def stars(p: Column) -> Column:
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for limit, mark in STARS:
        out = out.when(p <= limit, F.lit(mark))
    return out.otherwise(F.lit("ns"))


def ranksum(
    rows: DataFrame,
    by: Sequence[str],
    group: str,
    value: str,
    pairs: list[tuple[str, str]],
    with_p: bool = True,
) -> DataFrame:
    """Two-sided rank-sum test of each named pair of groups within each ``by``.

    Normal approximation with tie correction and continuity correction, no
    adjustment for the number of tests.
    """
    by = list(by)
    counts = rows.groupBy(*by, group, value).agg(F.count("*").alias("m"))
    pair_rows = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    )
    spread = (
        counts.withColumn("pair", pair_rows)
        .where((F.col(group) == F.col("pair.a")) | (F.col(group) == F.col("pair.b")))
        .select(*by, F.col("pair.a").alias("group_a"), F.col("pair.b").alias("group_b"), group, value, "m")
    )
    key = [*by, "group_a", "group_b"]
    in_a, in_b = F.col(group) == F.col("group_a"), F.col(group) == F.col("group_b")
    tied = spread.groupBy(*key, value).agg(
        F.sum("m").alias("t"),
        F.sum(F.when(in_a, F.col("m")).otherwise(0)).alias("ta"),
        F.sum(F.when(in_b, F.col("m")).otherwise(0)).alias("tb"),
    )
    run = with_running_sums(tied, key, [value], {"upto": "t"})
    rank = F.col("upto") - F.col("t") + (F.col("t") + 1) / F.lit(2.0)
    t = F.col("t").cast("double")
    sums = run.groupBy(*key).agg(
        F.sum("ta").alias("n_a"),
        F.sum("tb").alias("n_b"),
        F.sum(rank * F.col("ta")).alias("rank_sum"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("rank_sum") - a * (a + 1) / 2
    n = a + b
    variance = a * b / 12 * (n + 1 - F.col("tie_term") / F.nullif(n * (n - 1), F.lit(0.0)))
    shift = F.abs(u - a * b / 2) - 0.5
    z = F.when(variance > 0, F.greatest(shift, F.lit(0.0)) / F.sqrt(variance))
    out = sums.where((F.col("n_a") > 0) & (F.col("n_b") > 0)).select(
        *key, "n_a", "n_b", u.alias("u"), z.alias("z")
    )
    if not with_p:
        return out
    return out.withColumn("p", _normal_p("z")).withColumn("mark", stars(F.col("p")))


def attention_summary(weights: DataFrame, obs: DataFrame, label: str, n_top: int | None = None) -> DataFrame:
    """Mean attention per label and gene over the cells that carry the gene.

    With ``n_top`` only the genes of the highest means of each label, with
    their ``rank`` from 1; the smaller gene index first among equals.
    """
    means = (
        weights.join(obs.select("cell_id", label), "cell_id")
        .groupBy(label, "gene_ix")
        .agg(F.avg("weight").alias("mean_weight"), F.count("*").alias("n_cells"))
    )
    if n_top is None:
        return means
    means = means.withColumn("mean_weight", F.round("mean_weight", 10))
    # Spark cuts each task's rows to n_top a label before the shuffle
    order = Window.partitionBy(label).orderBy(F.desc("mean_weight"), "gene_ix")
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_top)


def epoch_metrics(log: DataFrame, epoch: str, part: str, loss: str, hit: Column) -> DataFrame:
    """Mean loss and accuracy per epoch and file."""
    return log.groupBy(epoch, part).agg(
        F.count("*").alias("steps"),
        F.avg(loss).alias("loss"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )
