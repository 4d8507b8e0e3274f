"""Mini-batches, sampling, shuffling and running figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.operators.ordering import (
    with_position,
    with_position_in_group,
    with_running,
    with_running_sums,
)


def seeded_key(seed: int, *columns: str) -> Column:
    """A reproducible pseudo-random sort key."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def seeded_fraction(key: Column) -> Column:
    """First 32 bits of a hex digest as a fraction in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def assign_minibatches(
    rows: DataFrame,
    size: int,
    by: Sequence[str] = ("batch",),
    order: Sequence[str] = ("cell_id",),
    seed: int | None = None,
) -> DataFrame:
    """Blocks of ``size`` rows per batch; the last partial block is dropped.

    Adds ``minibatch_id`` and ``place`` (position in the block).
    """
    by = list(by)
    keys = list(order) if seed is None else [seeded_key(seed, *order), *order]
    counted = with_position_in_group(rows, by, keys, "__at", size="__n")
    full = F.floor(F.col("__n") / F.lit(size)) * F.lit(size)
    return (
        counted.where(F.col("__at") < full)
        .withColumn("minibatch_id", F.floor(F.col("__at") / F.lit(size)))
        .withColumn("place", F.col("__at") % F.lit(size))
        .drop("__at", "__n")
    )


def limit_full_batches(
    rows: DataFrame, size: int, by: Sequence[str] = (), order: Sequence[str] = ("cell_id",)
) -> DataFrame:
    """Only the rows that fill whole blocks, in order."""
    return assign_minibatches(rows, size, by, order).drop("minibatch_id", "place")


def zip_minibatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row *j* of block *i* on the left with row *j* of block *i* on the right."""
    return left.join(right, ["minibatch_id", "place"])


#: Hex digits of a digest counted at a time, and rows of the last bucket that are looked at one by one.
_DIGITS, _LAST = 4, 1024


def _nth_digest(digests: DataFrame, n: int) -> tuple[str, int]:
    """The ``n``-th smallest digest, and how many of the rows that hold it belong to the first ``n``.

    Beginnings of digests are counted (65,536 of them at most); the bucket in
    which the ``n``-th lies is counted again by the digits that follow, until
    its rows are few.
    """
    start = ""
    while True:
        inside = digests.where(F.col("d").startswith(start))
        width = len(start) + _DIGITS
        counts = inside.groupBy(F.substring("d", 1, width).alias("p")).count().collect()
        for row in sorted(counts, key=lambda r: r["p"]):
            if n <= row["count"]:
                break
            n -= row["count"]
        start = row["p"]
        if row["count"] <= _LAST or len(start) == 32:
            break
    if len(start) < 32:
        held = sorted(r["d"] for r in digests.where(F.col("d").startswith(start)).collect())
        start, n = held[n - 1], n - held.index(held[n - 1])
    return start, n


def sample_n(rows: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """Exactly ``n`` rows without replacement (all, if there are fewer).

    The digest of the ``n``-th row is found by counting, then every row up to
    it passes a filter: no sort, and no task that holds all ``n`` rows. Rows
    that repeat a key share its digest; if they stand at the end, some of them
    are taken, in the order of the key.
    """
    digest = seeded_key(seed, *key)
    if n <= 0:
        return rows.limit(0)
    if rows.count() <= n:
        return rows
    last, of_last = _nth_digest(rows.select(digest.alias("d")), n)
    ties = rows.where(digest == last)
    before = rows.where(digest < last)
    if ties.count() == of_last:
        return rows.where(digest <= last)
    return before.unionByName(ties.orderBy(*key).limit(of_last))


def shuffle_rows(rows: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Rows in a seeded random order, with their new position."""
    return with_position(rows, [seeded_key(seed, *key), *key], "position")


def flag_last(rows: DataFrame, sequence: Sequence[str], order: str) -> DataFrame:
    """Mark the closing row of each sequence."""
    ends = rows.groupBy(*sequence).agg(F.max(order).alias("__end"))
    return rows.join(ends, list(sequence)).withColumn(
        "is_last", F.col(order) == F.col("__end")
    ).drop("__end")


def running_mean(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Mean over all rows of the group so far."""
    counted = rows.withColumn("__one", F.lit(1).cast("bigint"))
    run = with_running_sums(counted, list(by), list(order), {"__s": value, "__c": "__one"})
    return run.withColumn(name, F.col("__s") / F.col("__c")).drop("__s", "__c", "__one")


def label_change_rate(predictions: DataFrame, tolerance: float) -> DataFrame:
    """Share of rows whose label differs from the iteration before.

    ``predictions`` is ``id, iteration, label``; the stop flag is never set at
    the first iteration. Groups of the window hold one row per iteration.
    """
    before = Window.partitionBy("id").orderBy("iteration")
    seen = predictions.withColumn("__was", F.lag("label").over(before))
    changed = F.when(F.col("__was").isNull(), None).otherwise(
        (F.col("label") != F.col("__was")).cast("double")
    )
    rates = seen.groupBy("iteration").agg(F.avg(changed).alias("change_rate"))
    stop = F.coalesce(F.col("change_rate") < F.lit(tolerance), F.lit(False))
    return rates.withColumn("stop", stop)


def best_so_far(log: DataFrame, order: str, loss: str, score: str) -> DataFrame:
    """Flag epochs that improve on every earlier one.

    The log is first reduced to one row per epoch. The best values before each
    epoch are running extremes over a distributed sort.
    """
    epochs = log.groupBy(order).agg(F.avg(loss).alias("loss"), F.avg(score).alias("score"))
    rounded = epochs.select(
        order, F.round("loss", 9).alias("loss"), F.round("score", 9).alias("score")
    )
    ran = with_running(rounded, [], [order], {"__low": ("min", "loss"), "__high": ("max", "score")}, before=True)
    low, high = F.col("__low"), F.col("__high")
    return ran.select(
        order,
        "loss",
        "score",
        (low.isNull() | (F.col("loss") < low)).alias("best_loss"),
        (high.isNull() | (F.col("score") > high)).alias("best_score"),
    )
