"""Mixing overlapping sources to target weights by minimum-cost flow."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoplane.llm.common import WORD
from cytoplane.session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: The flow network has a node for each source and each membership pattern.
MAX_PATTERNS = 100_000
_BUCKET = 4  # hex digits of the seeded order that are summed ahead


# --------------------------------------------------------------- the network


def targets(sizes: Sequence[int], weights: Sequence[int], total: float, most: float = REPEATS) -> list[float]:
    """Split ``total`` by weight; no share above ``most`` times its size, the excess going to the rest."""
    out = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    rest = total
    while open_:
        unit = sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * rest / unit > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * rest / unit
            return out
        for i in above:
            out[i] = float(most * sizes[i])
        rest -= sum(most * sizes[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return out


def route(patterns: Sequence[tuple[int, ...]], sizes: Sequence[int], quotas: Sequence[int], repeats: int = REPEATS) -> dict:
    """Words sent from each pattern to each of its sources: ``{(pattern, source): words}``.

    Least-cost maximum flow by successive shortest paths with potentials. A
    pattern offers its size ``repeats`` times; its k-th repetition costs k a
    word, so costs are convex and single use comes first. Each path fills an
    arc for good or empties one, so the number of paths is bounded by the
    number of arcs and steps of cost, not by the number of words.
    """
    n_p, n_s = len(patterns), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(u: int, v: int, capacity: int, price: int) -> int:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            graph[a].append(len(to))
            to.append(b)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    for i, size in enumerate(sizes):
        for k in range(repeats):
            arc(start, i, size, k)
    sent = {(i, s): arc(i, n_p + s, repeats * sizes[i], 0) for i, own in enumerate(patterns) for s in own}
    for s, quota in enumerate(quotas):
        arc(n_p + s, end, quota, 0)

    height = [0] * (end + 1)
    while True:
        far = [float("inf")] * (end + 1)
        came = [-1] * (end + 1)
        far[start] = 0
        queue = [(0, start)]
        while queue:
            at, u = heapq.heappop(queue)
            if at > far[u]:
                continue
            for a in graph[u]:
                step = at + cost[a] + height[u] - height[to[a]]
                if room[a] > 0 and step < far[to[a]]:
                    far[to[a]] = step
                    came[to[a]] = a
                    heapq.heappush(queue, (step, to[a]))
        if came[end] < 0:
            break
        for v in range(end + 1):
            if far[v] < float("inf"):
                height[v] += far[v]
        amount, v = 1 << 62, end
        while v != start:
            amount = min(amount, room[came[v]])
            v = to[came[v] ^ 1]
        v = end
        while v != start:
            room[came[v]] -= amount
            room[came[v] ^ 1] += amount
            v = to[came[v] ^ 1]
    return {k: room[a ^ 1] for k, a in sent.items() if room[a ^ 1]}


# ----------------------------------------------------------------- documents


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def take(docs: DataFrame, shares: DataFrame, pattern: str, seed: int = 0) -> DataFrame:
    """``docs(doc_id, size, <pattern>)`` with ``taken``, given ``shares(<pattern>, whole, part)``.

    Every document of a pattern is taken ``whole`` times; ``part`` further words
    come from its documents in seeded order, the last one in part. The order is
    that of the MD5 of seed and id. Sizes are summed by pattern and the first
    four hex digits of the order, so only documents of the one bucket in which
    ``part`` runs out are ranked among themselves.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = docs.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, _BUCKET))
    shares = shares.withColumnsRenamed({"whole": "__whole", "part": "__part"})
    sums = docs.groupBy(pattern, "__bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy(pattern).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    last = (
        sums.join(F.broadcast(shares), F.col(pattern).eqNullSafe(F.col("__p")))
        .where((F.col("before") < F.col("__part")) & (F.col("before") + F.col("s") >= F.col("__part")))
        .select(F.col("__p").alias("__q"), F.col("__bucket").alias("__last"), (F.col("__part") - F.col("before")).alias("__left"))
    )
    shares = shares.join(last, F.col("__p").eqNullSafe(F.col("__q")), "left").drop("__q")
    placed = docs.join(F.broadcast(shares), F.col(pattern).eqNullSafe(F.col("__p")))
    edge = placed.where("__bucket = __last")
    order = Window.partitionBy(pattern).orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.greatest(F.least(F.col("__left") - F.coalesce(F.sum("size").over(order), F.lit(0)), F.col("size")), F.lit(0))
    edge = edge.withColumn("__extra", inside)
    rest = placed.where("__last is null or __bucket <> __last")
    rest = rest.withColumn("__extra", F.when(F.col("__bucket") < F.col("__last"), F.col("size")).otherwise(F.lit(0)))
    out = rest.unionByName(edge).withColumn("taken", (F.col("__whole") * F.col("size") + F.col("__extra")).cast("long"))
    return out.drop("__p", "__key", "__bucket", "__last", "__left", "__extra", "__whole", "__part")


def mix(
    docs: DataFrame, members: str, weights: dict | None = None, total: float | None = None, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, size, <members>)`` with ``taken``, for documents of several sources each; and the sources.

    ``members`` is an array column of source names (a null element is a source
    too). Documents are summed by membership pattern; the flow network over
    patterns and sources is solved once; each pattern then gives its words by
    ``take``. Without ``weights``, sources in order of name (null last) weigh
    3, 1, 2 and so on; ``total`` is 150 % of all sizes by default. The driver
    holds the patterns and sources, never documents; more than
    ``MAX_PATTERNS`` patterns are refused.
    """
    docs = docs.withColumn("__pattern", F.sort_array(F.array_distinct(members), asc=False))
    found = docs.groupBy("__pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({s for r in found for s in r["__pattern"] or ()}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r["__pattern"] or ():
            sizes[place[s]] += r["size"]
    share = total if total is not None else SHARE * sum(r["size"] for r in found)
    weigh = [(weights or {}).get(s, WEIGHTS[i % len(WEIGHTS)]) for i, s in enumerate(names)]
    wanted = targets(sizes, weigh, min(share, REPEATS * sum(sizes)))
    patterns = [tuple(place[s] for s in r["__pattern"] or ()) for r in found]
    sent = route(patterns, [r["size"] for r in found], [int(t + 0.5) for t in wanted])
    given = [0] * len(found)
    for (i, _), words in sent.items():
        given[i] += words
    spark = docs.sparkSession
    rows = [(r["__pattern"], *(divmod(g, r["size"]) if r["size"] else (0, 0))) for r, g in zip(found, given)]
    kind = docs.schema["__pattern"].dataType.simpleString()
    shares = spark.createDataFrame(rows, f"__p {kind}, whole long, part long")
    told = spark.createDataFrame(
        [(s, sizes[i], wanted[i]) for s, i in place.items()], "__source string, source_size long, target double"
    )
    mixed = take(docs, shares, "__pattern", seed)
    return mixed.drop("__pattern"), told


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``; columns of these names are replaced."""
    docs = docs.drop("size", "source_size", "target", "taken")
    own = docs.columns
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("__members", F.array("source"))
    mixed, told = mix(sized, "__members", seed=seed)
    mixed = mixed.join(F.broadcast(told), F.col("source").eqNullSafe(F.col("__source")))
    return mixed.select(*own, "size", "source_size", "target", "taken")


def mix_sources(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: every document, mixed by its own source.

    Size is the number of words. Sources by name, null last, weigh 3, 1, 2,
    repeating, and share 150 % of all words; no target is above twice its
    source's words, the excess being shared again by weight. A source's taken
    words are its target, rounded; one document of a source at most is taken in
    part; none more than twice.

    A null or empty text has size 0 and gives 0. Documents with equal id are
    ordered by size. Repeated rows are separate documents. An empty table gives
    an empty result. Two runs, on whatever partitions, agree.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))  # texts are read once
    mixed, told = mix(sized.withColumn("__members", F.array("source")), "__members", seed=seed)
    mixed = mixed.join(F.broadcast(told), F.col("source").eqNullSafe(F.col("__source")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")
