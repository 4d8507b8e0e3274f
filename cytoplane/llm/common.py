"""What the text operators share: tables, one-time evaluation, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.session import cut, cut_alone, ship

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: A table measured to be no larger than this may be sent to every executor.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often it is used."""
    return F.transform(F.array(value), body)[0]


def share_if_small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size fits ``limit``; else unmarked.

    ``row_bytes`` is an upper bound of a row, or a column that gives it. Either
    way a join returns the same rows.
    """
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``; root is the component's least node.

    Alternates large-star and small-star steps until no edge changes. A node's
    neighbours are reduced to their minimum, never gathered, so a node with
    very many links is only many rows of a join. Each step is written to the
    shared folder.
    """
    edges = cut(edges.where("u <> v").select("u", "v").distinct())  # made once, however dear they are
    stars = cut(_small_star(edges))
    seen = _mark(stars)
    while True:
        stars = cut(_small_star(_large_star(stars)))
        now = _mark(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _mark(stars: DataFrame) -> tuple:
    """Count and two sums over the hashes of distinct rows: the same for the same rows."""
    return tuple(
        stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


Pairs = Callable[[DataFrame], DataFrame]


def bucket_links(
    spread: DataFrame, near: Callable[[str, str], Column], verify: Pairs, detail: Pairs | None, alike: Callable[[str, str], Column]
) -> DataFrame:
    """Links ``u, v`` that join the same groups as all true pairs within buckets would.

    ``spread(key, node, ...)`` lists the buckets of each node; ``near(a, b)`` is
    a cheap test on two of its rows, made inside the join. First every node
    meets the least node of its buckets, and ``verify`` keeps the true links of
    that table ``u, v``. Then, in buckets that still hold several groups, nodes
    of different groups meet; ``detail(nodes)`` gives what the full test
    ``alike(a, b)`` needs of each (or leaves out those that can be alike to no
    other; None: nothing more is needed), and it is made inside the join too. So
    a bucket of one group is never expanded, and only true links become rows.
    """
    spark = spread.sparkSession
    fields = ["node", *[c for c in spread.columns if c not in ("key", "node")]]
    centre = spread.groupBy("key").agg(F.min(F.struct(*fields)).alias("c"), F.count("*").alias("m"))
    centre = cut(centre.where("m > 1").select("key", "c.*"))
    full = cut(spread.join(centre.select("key"), "key", "left_semi"))
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") > F.col("b.node")) & near("a", "b")
    stars = full.alias("a").join(centre.alias("b"), met).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    links = cut_alone(spark, lambda: verify(cut(stars.distinct())))

    def mixed() -> DataFrame:
        labelled = cut(full.join(cut_alone(spark, lambda: components(links)), "node", "left").withColumn("root", F.coalesce("root", "node")))
        several = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        return labelled.join(several, "key", "left_semi")

    open_ = cut_alone(spark, mixed)
    if detail is not None:
        open_ = cut(open_.join(detail(open_.select("node").distinct()), "node"))
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & near("a", "b") & alike("a", "b")
    rest = open_.alias("a").join(open_.alias("b"), met).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    return links.unionByName(rest.distinct())
