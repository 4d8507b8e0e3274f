"""From raw counts to normalised, informative genes, on long expression tables.

``expr`` is ``cell_id, gene_id, value``; an absent row means zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.functions.strings import starts_with_any

# Fixed values.
MIN_GENES = 600
TARGET_SUM = 10000.0
GENE_PREFIXES = ["ERCC", "MT-", "mt-"]
ALL_GENES = 40000
DEFAULT_BATCH = "0"


def filter_cells(expr: DataFrame, min_genes: int | None = MIN_GENES) -> DataFrame:
    """Keep cells with at least ``min_genes`` genes above zero."""
    least = MIN_GENES if min_genes is None else min_genes
    kept = expr.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("n"))
    kept = kept.where(F.col("n") >= least).select("cell_id")
    return expr.join(kept, "cell_id", "left_semi").select(expr.columns)


def filter_genes(expr: DataFrame, min_cells: int = 3) -> DataFrame:
    """Keep genes seen in at least ``min_cells`` cells."""
    kept = expr.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n"))
    kept = kept.where(F.col("n") >= min_cells).select("gene_id")
    return expr.join(kept, "gene_id", "left_semi").select(expr.columns)


def drop_gene_prefixes(
    var: DataFrame, prefixes: list[str] | None = None, name: str = "gene_name"
) -> DataFrame:
    return var.where(~starts_with_any(F.col(name), prefixes or GENE_PREFIXES))


def select_genes(expr: DataFrame, genes: DataFrame) -> DataFrame:
    return expr.join(genes.select("gene_id"), "gene_id", "left_semi").select(expr.columns)


def normalize_total(expr: DataFrame, target: float = TARGET_SUM) -> DataFrame:
    """Scale each cell to ``target``; a cell whose total is zero stays as it is.

    Totals are summed before the shuffle and joined back, so a cell is never
    gathered in one place.
    """
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("__total"))
    scaled = F.when(F.col("__total") == 0, F.col("value")).otherwise(
        F.col("value") * F.lit(float(target)) / F.col("__total")
    )
    return expr.join(totals, "cell_id").select("cell_id", "gene_id", scaled.alias("value"))


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def preprocess(
    expr: DataFrame,
    min_genes: int | None = MIN_GENES,
    target: float = TARGET_SUM,
    min_cells: int | None = None,
) -> DataFrame:
    """Cell filter, optional gene filter, normalisation and log, in that order.

    Without the gene filter the gene count and the total of a cell come from
    one aggregation and are joined back once.
    """
    if min_cells is not None:
        kept = filter_genes(filter_cells(expr, min_genes), min_cells)
        return log1p(normalize_total(kept, target))
    return scale_and_log(expr, cell_totals(expr, min_genes), target)


def cell_totals(expr: DataFrame, min_genes: int | None = MIN_GENES) -> DataFrame:
    """``cell_id, __total`` of the cells that pass the gene filter: one row per cell, from one aggregation."""
    least = MIN_GENES if min_genes is None else min_genes
    sums = expr.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("__n"), F.sum("value").alias("__total"))
    return sums.where(F.col("__n") >= least).drop("__n")


def scale_and_log(expr: DataFrame, totals: DataFrame, target: float = TARGET_SUM) -> DataFrame:
    """Rows of the cells of ``totals``, scaled to ``target`` and logged; other columns of ``totals`` come along."""
    share = F.col("value") * F.lit(float(target)) / F.col("__total")
    scaled = F.when(F.col("__total") == 0, F.col("value")).otherwise(share)
    extra = [c for c in totals.columns if c not in ("cell_id", "__total")]
    return expr.join(totals, "cell_id").select("cell_id", "gene_id", F.log1p(scaled).alias("value"), *extra)


def default_batch(obs: DataFrame, batch: str | None = None) -> DataFrame:
    """The named batch column as ``batch``, or one constant batch."""
    return obs.withColumn("batch", F.lit(DEFAULT_BATCH) if batch is None else F.col(batch))


def filter_obs(
    obs: DataFrame,
    equal: dict | None = None,
    differs: dict | None = None,
    among: dict[str, list] | None = None,
    outside: dict[str, list] | None = None,
) -> DataFrame:
    """Row filter on annotation. ``None`` in a list also matches missing values."""

    def member(column: str, values: list) -> Column:
        known = [v for v in values if v is not None]
        hit = F.coalesce(F.col(column).isin(known), F.lit(False))
        return (hit | F.col(column).isNull()) if None in values else hit

    for column, value in (equal or {}).items():
        obs = obs.where(F.col(column).eqNullSafe(F.lit(value)))
    for column, value in (differs or {}).items():
        obs = obs.where(~F.col(column).eqNullSafe(F.lit(value)))
    for column, values in (among or {}).items():
        obs = obs.where(member(column, values))
    for column, values in (outside or {}).items():
        obs = obs.where(~member(column, values))
    return obs


def gene_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """All genes of either side with a membership flag for each."""
    a = left.select("gene_id").distinct().withColumn("in_left", F.lit(True))
    b = right.select("gene_id").distinct().withColumn("in_right", F.lit(True))
    return a.join(b, "gene_id", "full").na.fill(False, ["in_left", "in_right"])


def overlap_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    both = gene_overlap(left, right)
    return both.agg(
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("only_left"),
        F.count_if(F.col("in_left") & F.col("in_right")).alias("shared"),
        F.count_if(~F.col("in_left") & F.col("in_right")).alias("only_right"),
    )


def concat_cells(left: DataFrame, right: DataFrame, tags: tuple[str, str]) -> DataFrame:
    """Stack two expression tables over their shared genes, with a source tag."""
    shared = left.select("gene_id").distinct().join(
        right.select("gene_id").distinct(), "gene_id", "left_semi"
    )
    stacked = left.withColumn("source", F.lit(tags[0])).unionByName(
        right.withColumn("source", F.lit(tags[1])), allowMissingColumns=True
    )
    return stacked.join(shared, "gene_id", "left_semi").select(stacked.columns)


def align_to_vocabulary(expr: DataFrame, vocabulary: DataFrame, declared: int | None = None) -> DataFrame:
    """Query rows over the reference vocabulary: ``cell_id, gene_ix, value``.

    Genes the vocabulary lacks are dropped; genes the query lacks stay absent
    (zero) until records are made dense. A vocabulary of another size than
    declared fails.
    """
    if declared is not None:
        size = vocabulary.count()
        if size != declared:
            raise ValueError(f"vocabulary has {size} genes, encoder expects {declared}")
    return expr.join(vocabulary.select("gene_id", "gene_ix"), "gene_id").select(
        "cell_id", "gene_ix", "value"
    )
