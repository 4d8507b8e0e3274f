"""Positions, running totals and exact quantiles over a distributed sort.

A window without partition columns (or with one hot partition) would pass all
its rows through a single task. Here the rows are range-partitioned on the
full sort key, so equal leading keys are split too, and the only thing that
crosses partitions is one row per partition (or per partition and group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoplane.session import cut

_PART, _PLACE, _BASE = "__part", "__place", "__base"
_PLACE_BITS = (1 << 33) - 1
SHARED_BYTES = 32 << 20


def _width(kind: T.DataType) -> int:
    """Bytes allowed for a group value; text is taken at a generous length."""
    return 16 if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.BooleanType)) else 512


def _sorted_slices(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Sort, tag slice number and place in it, and write the rows with their tags.

    The tags are stored with the rows, so they stay what they are however
    often, and in whatever splits, the table is read.
    """
    tagged = (
        df.orderBy(*order)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)))
    )
    return cut(tagged)


def with_position(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Zero-based global position of each row. ``order`` must be a total order."""
    slices = _sorted_slices(df, order)
    sizes = slices.groupBy(_PART).agg(F.count("*").alias("__n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice: bounded by the number of partitions.
    bases = sizes.select(_PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_BASE))
    return (
        slices.join(F.broadcast(bases), _PART)
        .withColumn(name, F.col(_BASE) + F.col(_PLACE))
        .drop(_PART, _PLACE, _BASE)
    )


def with_position_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    size: str | None = None,
) -> DataFrame:
    """Zero-based position inside each group, without one task per group.

    ``size`` names a second column with the number of rows of the group.
    """
    if not group:
        placed = with_position(df, order, name)
        return placed if size is None else placed.withColumn(size, F.lit(placed.count()))
    placed = with_position(df, [*group, *order], "__pos")
    starts = placed.groupBy(*group).agg(
        F.min("__pos").alias("__start"), F.count("*").alias(size or "__size")
    )
    if size is None:
        starts = starts.drop("__size")
    # One row per group: shared if it measures small, so that a hot group moves no rows.
    starts = cut(starts)
    size_bytes = starts.count() * (64 + sum(_width(starts.schema[g].dataType) for g in group))
    if size_bytes <= SHARED_BYTES:
        starts = F.broadcast(starts)
    keys = [F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    extra = [] if size is None else [F.col(size)]
    return (
        placed.alias("p")
        .join(starts.alias("s"), keys)
        .select("p.*", (F.col("__pos") - F.col("__start")).alias(name), *extra)
        .drop("__pos")
    )


#: How a running figure is made over rows, and how what came before a slice joins it.
_KINDS = {
    "sum": (F.sum, lambda base, own: F.coalesce(base + own, base, own)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda base, own: F.coalesce(own, base)),
}


def with_running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    figures: dict[str, tuple[str, str]],
    before: bool = False,
) -> DataFrame:
    """Running figures ``{new column: (kind, column)}`` in ``order``, kinds sum, min, max and last (non-null value).

    A prefix scan over sorted slices: each slice is reduced to one row (per
    group it touches), the rows before a slice are reduced to what it starts
    from, and only then are its own rows gone through. Each row counts itself
    unless ``before`` is set; the first row then has null.
    """
    slices = _sorted_slices(df, [*group, *order])
    parts = slices.groupBy(*group, _PART).agg(
        *[
            # the last row of a slice, not the last that happens to be read
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(_PLACE))).alias(f"__t_{n}") if kind == "last" else _KINDS[kind][0](c).alias(f"__t_{n}")
            for n, (kind, c) in figures.items()
        ]
    )
    # Rows here: at most (#partitions + #groups), one per slice a group touches.
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(*group, _PART, *[_KINDS[kind][0](f"__t_{n}").over(earlier).alias(f"__b_{n}") for n, (kind, _) in figures.items()])
    inside = Window.partitionBy(*group, _PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    run = slices.select("*", *[_KINDS[kind][0](c).over(inside).alias(f"__r_{n}") for n, (kind, c) in figures.items()])
    met = [run[c].eqNullSafe(bases[c]) for c in [*group, _PART]]
    out = run.join(bases, met).drop(*[bases[c] for c in [*group, _PART]])
    for n, (kind, _) in figures.items():
        out = out.withColumn(n, _KINDS[kind][1](F.col(f"__b_{n}"), F.col(f"__r_{n}")))
    return out.drop(_PART, _PLACE, *[f"__{side}_{n}" for n in figures for side in "rb"])


def with_running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, str],
) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` in ``order``."""
    return with_running(df, group, order, {n: ("sum", c) for n, c in sums.items()})


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles per group, exact, with ties counted before the sort."""
    if not group:
        whole = exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs)
        return whole.drop("__all")
    counted = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    run = with_running_sums(counted, group, [value], {"__upto": "__n"})
    sizes = counted.groupBy(*group).agg(F.sum("__n").alias("n"))
    placed = run.join(sizes, list(group))
    picks = []
    for name, p in probs.items():
        place = (F.col("n") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            holds = (F.col("__upto") - F.col("__n") <= at) & (at < F.col("__upto"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"__{side}_{name}"))
    wide = placed.groupBy(*group, "n").agg(*picks)
    outs = []
    for name, p in probs.items():
        place = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        outs.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return wide.select(*group, "n", *outs)
