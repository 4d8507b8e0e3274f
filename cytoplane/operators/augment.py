"""Random damage to expression records, reproducible by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.operators.batching import seeded_fraction

# Fixed values.
RATE = 0.005
FEWEST, MOST = 1, 100
DROP_BELOW, SHRINK_BELOW, GROW_BELOW = 0.5, 0.8, 0.9


def augment(records: DataFrame, seed: int, rate: float = RATE) -> DataFrame:
    """Adds ``aug_feature, aug_value``.

    Per cell ``clip(int(length * rate), 1, 100)`` positions are picked; each is
    zeroed with its gene index (50 %), shrunk (30 %) or grown (10 %) by a
    random fraction, or left alone (10 %). Record by record, no shuffle.
    """

    def digest(i: Column, use: str) -> Column:
        at = F.concat_ws(":", F.col("cell_id").cast("string"), i.cast("string"), F.lit(f"{seed}{use}"))
        return F.md5(at)

    length = F.size("feature")
    count = F.least(F.greatest(F.floor(length * F.lit(rate)), F.lit(FEWEST)), F.lit(MOST))
    drawn = F.array_sort(
        F.transform("feature", lambda _, i: F.struct(digest(i, "pick").alias("h"), i.alias("i")))
    )
    picked = records.withColumn("__picked", F.slice(drawn, F.lit(1), count.cast("int"))["i"])
    dice = lambda i: seeded_fraction(digest(i, "dice"))
    share = lambda i: seeded_fraction(digest(i, "size"))
    hit = lambda i: F.array_contains("__picked", i)
    feature = F.transform(
        "feature",
        lambda g, i: F.when(hit(i) & (dice(i) < DROP_BELOW), F.lit(0).cast("bigint")).otherwise(g),
    )
    value = F.transform(
        "value",
        lambda x, i: F.when(~hit(i), x)
        .when(dice(i) < DROP_BELOW, F.lit(0.0))
        .when(dice(i) < SHRINK_BELOW, x - x * share(i))
        .when(dice(i) < GROW_BELOW, x + x * share(i))
        .otherwise(x),
    )
    return picked.withColumn("aug_feature", feature).withColumn("aug_value", value).drop("__picked")
