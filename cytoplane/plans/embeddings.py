"""Queries: vector functions, neighbours, label transfer, encoder, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.functions import arrays as AR
from cytoplane.functions import vectors as V
from cytoplane.operators import classify as CL
from cytoplane.operators import cluster as K
from cytoplane.operators import cohort as C
from cytoplane.operators import encode as E
from cytoplane.operators import graph as G
from cytoplane.operators import hvg as H
from cytoplane.operators import metrics as M
from cytoplane.operators import similarity as S
from cytoplane.operators import transfer as T
from cytoplane.operators.augment import augment as augment_records
from cytoplane.plans import fixtures as fx
from cytoplane.plans.fixtures import r6
from cytoplane.plans.registry import block, query
from cytoplane.sources import records as R


def _long(df, key, vec, value="value"):
    return df.select(key, F.posexplode_outer(vec).alias("pos", value)).select(
        key, F.col("pos").cast("bigint").alias("pos"), r6(value).alias(value)
    )


def _long_sql(key: str, vec: str, source: str) -> str:
    return f"""SELECT {key}, CAST(generate_subscripts({vec}, 1) - 1 AS BIGINT) AS pos, round(unnest({vec}), 6) AS value FROM {source}"""


# ---------------------------------------------------------- vector functions


@query("l2_normalize", "emb", _long_sql("vec_id", "vec3", "(SELECT vec_id, list_transform(v, lambda x: x / sqrt(greatest(list_dot_product(v, v), 1e-12))) AS vec3 FROM (SELECT vec_id, list_transform(vec, lambda x: x * 3 + 0.1) AS v FROM emb))"))
def l2_normalize(spark, d):
    v = F.transform("vec", lambda x: x * 3 + 0.1)
    return _long(fx.emb(spark, d).withColumn("v", v), "vec_id", V.l2_normalize(F.col("v")))


@query("inner_product", "pairs", "SELECT vec_id, round(list_dot_product(a, b), 6) AS product FROM pairs")
def inner_product(spark, d):
    return fx.pairs(spark, d).select("vec_id", r6(V.inner_product(F.col("a"), F.col("b"))).alias("product"))


@query("softmax_array", "probs", _long_sql("vec_id", "p", "probs"))
def softmax_array(spark, d):
    return _long(fx.logits(spark, d), "vec_id", V.softmax(F.col("logits")))


@query("sharpen", "probs", _long_sql("vec_id", "sharp", "probs"))
def sharpen(spark, d):
    return _long(fx.logits(spark, d), "vec_id", V.sharpen(F.col("logits")))


@query(
    "entropy",
    "probs",
    """SELECT 'rows' AS scope, round(avg(list_sum(list_transform(p, lambda x: -greatest(x, 1e-8) * ln(greatest(x, 1e-8))))), 6) AS entropy FROM probs
UNION ALL SELECT 'whole', round(sum(-greatest(m, 1e-8) * ln(greatest(m, 1e-8))), 6) FROM (
  SELECT i, avg(p[i]) AS m FROM probs, range(1, 11) r(i) GROUP BY i)""",
)
def entropy(spark, d):
    from cytoplane.operators.losses import mean_vector

    p = fx.logits(spark, d).select(V.softmax(F.col("logits")).alias("p"))
    rows = p.agg(r6(F.avg(V.entropy(F.col("p")))).alias("entropy")).select(F.lit("rows").alias("scope"), "entropy")
    m = F.greatest(F.col("mean"), F.lit(V.ENTROPY_FLOOR))
    whole = mean_vector(p, F.col("p")).agg(r6(F.sum(-m * F.log(m))).alias("entropy"))
    return rows.unionByName(whole.select(F.lit("whole").alias("scope"), "entropy"))


@query(
    "one_hot",
    "emb",
    "SELECT vec_id, CAST(i AS BIGINT) AS pos, CASE WHEN i = label THEN 1 ELSE 0 END AS value FROM emb, range(10) r(i)",
)
def one_hot(spark, d):
    rows = fx.emb(spark, d).select("vec_id", F.posexplode(V.one_hot(F.col("label"), 10)).alias("pos", "value"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("argmax_label", "preds", "SELECT vec_id, CAST(pred AS INTEGER) AS pred FROM preds")
def argmax_label(spark, d):
    return fx.preds(spark, d).select("vec_id", "pred")


SCHEDULE = {1000.0: 1.0, 4000.0: 0.1, 8000.0: 0.4}


@query(
    "piecewise_linear",
    "",
    """SELECT event_id, round(CASE WHEN event_id < 1000 THEN event_id * 0.001 WHEN event_id < 4000 THEN 1 + (event_id - 1000) * (0.1 - 1.0) / 3000
  WHEN event_id < 8000 THEN 0.1 + (event_id - 4000) * (0.4 - 0.1) / 4000 ELSE 0.4 END + 1e-10, 6) AS rate FROM events""",
)
def piecewise_linear(spark, d):
    rate = V.piecewise_linear(F.col("event_id"), SCHEDULE)
    return fx.table(spark, d, "events").select("event_id", r6(rate + 1e-10).alias("rate"))


@query(
    "pad_sequences",
    "expr",
    """SELECT cell_id, CAST(i AS BIGINT) AS pos, coalesce(g, 0) AS gene_ix FROM (
  SELECT cell_id, i, genes[i + 1] AS g FROM (SELECT cell_id, list(gene_id ORDER BY gene_id) AS genes FROM expr GROUP BY cell_id), range(40) r(i))
UNION ALL SELECT -1, max(n), 0 FROM (SELECT count(*) AS n FROM expr GROUP BY cell_id)""",
)
def pad_sequences(spark, d):
    """Gene lists cut or padded to 40, and (as cell -1) the longest length."""
    rows = fx.expr(spark, d).select("cell_id", F.col("gene_id").alias("gene_ix"), "value")
    records = R.build_records(rows)
    padded = AR.pad_or_cut(F.col("feature"), F.lit(40), F.lit(0).cast("bigint"))
    long = records.select("cell_id", F.posexplode(padded).alias("pos", "gene_ix"))
    most = records.agg(F.max(F.size("feature")).cast("bigint").alias("pos")).select(
        F.lit(-1).cast("bigint").alias("cell_id"), "pos", F.lit(0).cast("bigint").alias("gene_ix")
    )
    return long.withColumn("pos", F.col("pos").cast("bigint")).unionByName(most)


def _hash(use: str) -> str:
    return f"('0x' || substr(md5(cell_id || ':' || i || ':5{use}'), 1, 8))::BIGINT / 4294967296.0"


@query(
    "augment_expression",
    "expr",
    f"""SELECT cell_id, CAST(i AS BIGINT) AS pos, gene_ix, round(value, 6) AS value,
  CASE WHEN hit AND dice < 0.5 THEN 0 ELSE gene_ix END AS aug_gene_ix,
  round(CASE WHEN NOT hit THEN value WHEN dice < 0.5 THEN 0 WHEN dice < 0.8 THEN value - value * size WHEN dice < 0.9 THEN value + value * size ELSE value END, 6) AS aug_value
FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY md5(cell_id || ':' || i || ':5pick')) <=
    least(greatest(floor(count(*) OVER (PARTITION BY cell_id) * 0.05), 1), 100) AS hit, {_hash('dice')} AS dice, {_hash('size')} AS size
  FROM (SELECT cell_id, gene_id AS gene_ix, value, row_number() OVER (PARTITION BY cell_id ORDER BY gene_id) - 1 AS i FROM expr))""",
)
def augment_expression(spark, d):
    rows = fx.expr(spark, d).select("cell_id", F.col("gene_id").alias("gene_ix"), "value")
    records = R.build_records(rows)
    out = augment_records(records, seed=5, rate=0.05)
    zipped = F.arrays_zip("feature", "value", "aug_feature", "aug_value")
    return out.select("cell_id", F.posexplode(zipped).alias("pos", "e")).select(
        "cell_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("e.feature").alias("gene_ix"),
        r6("e.value").alias("value"),
        F.col("e.aug_feature").alias("aug_gene_ix"),
        r6("e.aug_value").alias("aug_value"),
    )


# ----------------------------------------------------------------- neighbours


@query(
    "ip_cross_join",
    "sims",
    "SELECT query_id, count(*) AS n, round(sum(sim), 6) AS total, round(min(sim), 6) AS low, round(max(sim), 6) AS high FROM sims GROUP BY query_id",
)
def ip_cross_join(spark, d):
    """All inner products of every query with every reference, summed up in place."""
    q, r = fx.ref_and_query(spark, d)
    return S.similarity_summary(q, r).withColumns({c: r6(c) for c in ("total", "low", "high")})


KNN_SQL = "SELECT query_id, ref_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM near"


@query("knn_topk", "near", KNN_SQL)
def knn_topk(spark, d):
    q, r = fx.ref_and_query(spark, d)
    return S.knn(q, r, 5).select("query_id", "ref_id", r6("sim").alias("sim"), "rank")


@query("knn_topk_blocked", "near", KNN_SQL)
def knn_topk_blocked(spark, d):
    """The same with both sides cut into blocks, as for a reference too large to share."""
    q, r = fx.ref_and_query(spark, d)
    found = S.knn(q, r, 5, index=False, resident_bytes=0, block_rows=128)
    return found.select("query_id", "ref_id", r6("sim").alias("sim"), "rank")


@query("knn_topk_indexed", "near", KNN_SQL)
def knn_topk_indexed(spark, d):
    """The same through the metric index: only blocks that can hold a better row are visited."""
    q, r = fx.ref_and_query(spark, d)
    found, _ = S.knn_indexed(q, r, 5)
    return found.select("query_id", "ref_id", r6("sim").alias("sim"), "rank")


@query(
    "topk_per_key",
    "",
    """SELECT l_suppkey AS key, l_orderkey AS ref_id, l_linenumber AS line, l_extendedprice AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5""",
)
def topk_per_key(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy(
        F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    rows = fx.table(spark, d, "lineitem").withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    return rows.select(
        F.col("l_suppkey").alias("key"),
        F.col("l_orderkey").alias("ref_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("score"),
        "rank",
    )


@query("attach_label_to_neighbours", "near emb", "SELECT n.query_id, n.ref_id, e.label, CAST(n.rank AS INTEGER) AS rank FROM near n JOIN emb e ON e.vec_id = n.ref_id")
def attach_label_to_neighbours(spark, d):
    q, r = fx.ref_and_query(spark, d)
    found = S.knn(q, r.drop("label"), 5).drop("label")
    labels = r.select(F.col("id").alias("ref_id"), "label")
    return found.join(labels, "ref_id").select("query_id", "ref_id", "label", "rank")


@query("knn_label_transfer", "voted", "SELECT query_id, label, round(confidence, 6) AS confidence FROM voted")
def knn_label_transfer(spark, d):
    q, r = fx.ref_and_query(spark, d)
    return T.transfer_labels(q, r, 5).withColumn("confidence", r6("confidence"))


@query("knn_label_only", "voted emb", "SELECT v.query_id, e.label AS truth, v.label AS pred FROM voted v JOIN emb e ON e.vec_id = v.query_id")
def knn_label_only(spark, d):
    q, r = fx.ref_and_query(spark, d)
    found = T.transfer_labels(q, r, 5).select("query_id", F.col("label").alias("pred"))
    truth = fx.emb(spark, d).select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"))
    return found.join(truth, "query_id").select("query_id", "truth", "pred")


@query(
    "knn_softvote",
    "sims",
    """SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, first_rank) AS place FROM (
  SELECT query_id, label, round(sum(exp(sim / 0.1)), 10) AS w, min(rank) AS first_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank FROM sims) WHERE rank <= 100 GROUP BY query_id, label)) WHERE place = 1""",
)
def knn_softvote(spark, d):
    q, r = fx.ref_and_query(spark, d)
    return T.soft_vote(q, r, 100, 0.1)


@query("nn_label", "near", "SELECT query_id, ref_id, label FROM near WHERE rank = 1")
def nn_label(spark, d):
    q, r = fx.ref_and_query(spark, d)
    return T.nearest_label(q, r)


block(
    "mined",
    "emb",
    """SELECT query_id, ref_id, anchor, label, rank - 1 AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS ref_id, a.label AS anchor, b.label AS label,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.vec, b.vec), 10) DESC, b.vec_id) AS rank FROM emb a, emb b)
  WHERE rank BETWEEN 2 AND 6""",
)


@query("mine_neighbours", "mined", "SELECT query_id, ref_id, CAST(rank AS INTEGER) AS rank FROM mined")
def mine_neighbours(spark, d):
    return T.mine_neighbours(fx.points(spark, d), 5).select("query_id", "ref_id", "rank")


@query("neighbour_agreement", "mined", "SELECT count(*) AS n_pairs, round(avg(CASE WHEN label = anchor THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM mined")
def neighbour_agreement(spark, d):
    pts = fx.points(spark, d)
    return T.neighbour_agreement(T.mine_neighbours(pts, 5), pts).withColumn("agreement", r6("agreement"))


block(
    "level1",
    "sims",
    """SELECT query_id, l1, w / n AS conf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, first_rank) AS place FROM (
    SELECT query_id, l1, round(sum(sim), 10) AS w, count(*) AS n, min(rank) AS first_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank FROM sims) WHERE rank <= 5 GROUP BY query_id, l1)) WHERE place = 1""",
)
block(
    "level2",
    "sims level1",
    """SELECT query_id, label, w / n AS conf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, first_rank) AS place FROM (
    SELECT query_id, label, round(sum(sim), 10) AS w, count(*) AS n, min(rank) AS first_rank FROM (
      SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY sim DESC, ref_id) AS rank FROM sims s JOIN level1 f ON f.query_id = s.query_id AND f.l1 = s.l1)
    WHERE rank <= 5 GROUP BY query_id, label)) WHERE place = 1""",
)


@query(
    "hierarchical_label_transfer",
    "level1 level2",
    "SELECT query_id, a.l1, round(a.conf, 6) AS l1_confidence, b.label AS l2, round(b.conf, 6) AS l2_confidence FROM level1 a JOIN level2 b USING (query_id)",
)
def hierarchical_label_transfer(spark, d):
    q, r = fx.ref_and_query(spark, d)
    out = T.transfer_labels_by_level(q, r.withColumnRenamed("label", "l2"), 5)
    return out.withColumns({c: r6(c) for c in ("l1_confidence", "l2_confidence")})


block(
    "edges",
    "emb",
    """SELECT src, dst FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.vec, b.vec), 10), b.vec_id) AS r
    FROM emb a JOIN emb b ON a.vec_id <> b.vec_id) WHERE r <= 15""",
)
block("graph", "edges", "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")


@query("knn_graph", "graph", "SELECT src, dst, 1.0::DOUBLE AS w FROM graph")
def knn_graph(spark, d):
    return G.knn_graph(fx.points(spark, d))


RESOLUTIONS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3]


@query(
    "modularity",
    "graph emb",
    """SELECT res, round(sum(inside) / sum(degree) - max(res) * sum(degree * degree) / (sum(degree) * sum(degree)), 6) AS modularity, count(*) AS communities
FROM (SELECT a.label, count(*) AS degree, count(*) FILTER (a.label = b.label) AS inside FROM graph JOIN emb a ON a.vec_id = src JOIN emb b ON b.vec_id = dst GROUP BY a.label),
  (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS res) GROUP BY res""",
)
def modularity(spark, d):
    """Quality of the label partition at every resolution."""
    pts = fx.points(spark, d)
    rows = pts.select(
        F.col("id").alias("node"), "label", F.explode(F.array(*[F.lit(r) for r in RESOLUTIONS])).alias("res")
    )
    return G.modularity(G.knn_graph(pts), rows).withColumn("modularity", r6("modularity"))


@query("community_detection")
def community_detection(spark, d):
    """Resolution, node and community label, every node at every resolution."""
    return G.communities(G.knn_graph(fx.points(spark, d)), RESOLUTIONS)


@query("resolution_sweep_table")
def resolution_sweep_table(spark, d):
    """Resolution -> ARI, NMI and number of communities."""
    from cytoplane.session import cut

    pts = fx.points(spark, d)
    found = G.communities(G.knn_graph(pts), RESOLUTIONS)
    rows = cut(
        found.withColumnRenamed("label", "pred").join(
            pts.select(F.col("id").alias("node"), F.col("label").alias("truth")), "node"
        )
    )
    out = None
    for r in RESOLUTIONS:
        one = rows.where(F.col("res") == r)
        k = one.agg(F.countDistinct("pred").alias("communities")).withColumn("k", F.lit(0))
        line = (
            k.join(M.adjusted_rand(one).withColumn("k", F.lit(0)), "k")
            .join(M.normalized_mutual_info(one).withColumn("k", F.lit(0)), "k")
            .select(
                F.lit(r).alias("res"), F.round("ari", 5).alias("ari"), F.round("nmi", 5).alias("nmi"), "communities"
            )
        )
        out = line if out is None else out.unionByName(line)
    return out


@query(
    "community_checks",
    "emb",
    """SELECT res, (SELECT count(*) FROM emb) AS nodes, CAST(0 AS BIGINT) AS disconnected, true AS better_than_alone
FROM (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS res)""",
)
def community_checks(spark, d):
    """What must hold of ``community_detection``: all nodes, connected communities, a better partition than single nodes."""
    from cytoplane.session import cut

    edges = cut(G.knn_graph(fx.points(spark, d)))
    found = cut(G.communities(edges, RESOLUTIONS).select("res", "node", "label"))
    parts = G.connected_parts(edges, found).groupBy("res").agg(F.countDistinct("label").alias("parts"))
    sizes = found.groupBy("res").agg(F.countDistinct("node").alias("nodes"), F.countDistinct("label").alias("groups"))
    own = G.modularity(edges, found).select("res", F.col("modularity").alias("own"))
    alone = G.modularity(edges, found.withColumn("label", F.col("node"))).select("res", F.col("modularity").alias("alone"))
    return sizes.join(parts, "res").join(own, "res").join(alone, "res").select(
        "res", "nodes", (F.col("parts") - F.col("groups")).alias("disconnected"), (F.col("own") > F.col("alone")).alias("better_than_alone")
    )


# ------------------------------------------------------------------ clustering


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return K.kmeans(fx.points(spark, d), 10, restarts=20)


def _squares(points, groups):
    """Summed squared distance of the points to the mean of their group, from sums."""
    rows = points.select("id", F.posexplode("vec").alias("i", "x")).join(groups.select("id", "g"), "id")
    per = rows.groupBy("g", "i").agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.sum("x").alias("s"), F.count("*").alias("n"))
    return per.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("cost"))


@query("cluster_checks", "emb", "SELECT unnest(['kmeans', 'refine']) AS method, count(*) AS points, true AS within_number, true AS tighter_than_whole FROM emb")
def cluster_checks(spark, d):
    """What must hold of ``kmeans_clusters`` and ``deep_cluster_refine``: each point once, no more clusters than asked for, less spread than in one cluster."""
    from cytoplane.session import cut

    pts = fx.points(spark, d)
    whole = _squares(pts, pts.select("id", F.lit(0).alias("g"))).withColumnRenamed("cost", "whole")
    out = None
    for method, made in (("kmeans", kmeans_clusters), ("refine", deep_cluster_refine)):
        found = cut(made(spark, d).select("id", F.col("cluster").alias("g")))
        counted = found.agg(F.countDistinct("id").alias("points"), F.countDistinct("g").alias("clusters"))
        one = counted.withColumn("cost", _squares(pts, found).scalar()).withColumn("whole", whole.scalar())
        line = one.select(F.lit(method).alias("method"), "points", (F.col("clusters") <= 10).alias("within_number"), (F.col("cost") < F.col("whole")).alias("tighter_than_whole"))
        out = line if out is None else out.unionByName(line)
    return out


@query("gmm_clusters")
def gmm_clusters(spark, d):
    return K.gaussian_mixture(fx.points(spark, d), 10, width=8)


@query("spectral_clusters")
def spectral_clusters(spark, d):
    return K.spectral(fx.points(spark, d), 10)


block("centres", "emb", "SELECT label AS c, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(vec[i]) AS m FROM emb, range(1, 65) r(i) GROUP BY label, i) GROUP BY label")
block(
    "soft",
    "emb centres",
    """SELECT id, c, w / sum(w) OVER (PARTITION BY id) AS q FROM (
    SELECT vec_id AS id, c, 1 / (1 + list_distance(vec, centre) * list_distance(vec, centre)) AS w FROM emb, centres)""",
)
block(
    "target",
    "soft",
    "SELECT id, c, w / sum(w) OVER (PARTITION BY id) AS p FROM (SELECT id, c, q * q / sum(q) OVER (PARTITION BY c) AS w FROM soft)",
)


def _soft(spark, d):
    pts = fx.points(spark, d)
    return K.soft_assign(pts, K.label_centres(pts))


@query("soft_assign", "soft", "SELECT id, CAST(c AS BIGINT) AS pos, round(q, 6) AS value FROM soft")
def soft_assign(spark, d):
    return _long(_soft(spark, d), "id", F.col("q"))


@query("target_distribution", "target", "SELECT id, CAST(c AS BIGINT) AS pos, round(p, 6) AS value FROM target")
def target_distribution(spark, d):
    return _long(K.target_distribution(_soft(spark, d)), "id", F.col("p"))


@query("deep_cluster_refine")
def deep_cluster_refine(spark, d):
    pts = fx.points(spark, d)
    labels, _ = K.refine(pts, K.label_centres(pts))
    return labels


@query("manifold_cluster_eval")
def manifold_cluster_eval(spark, d):
    from cytoplane.session import cut

    pts = fx.points(spark, d)
    out = None
    for method in ("kmeans", "mixture", "spectral"):
        one = cut(K.cluster_and_score(pts, 10, method))
        out = one if out is None else out.unionByName(one)
    return out


# --------------------------------------------------------------------- encoder


@query(
    "embed_pool",
    "rna_in",
    """SELECT cell_id, CAST(j AS BIGINT) AS pos, round(sum(value * sin(gene_ix * 0.1 + j)), 6) AS total
FROM rna_in, range(8) r(j) GROUP BY cell_id, j""",
)
def embed_pool(spark, d):
    rows = fx.norm(spark, d).select("cell_id", F.col("gene_id").alias("gene_ix"), "value")
    genes = fx.gene_vectors(fx.var_genes(spark, d).select("gene_ix"))
    out = E.weighted_pool(rows, genes)
    return out.select("cell_id", F.col("pos").cast("bigint").alias("pos"), r6("total").alias("total"))


block("encoded", "rna_pooled", fx.head_sql("rna_pooled"))
block("joint_encoded", "joint_pooled", fx.head_sql("joint_pooled"))
block("single_encoded", "rna_pooled", fx.head_sql("rna_pooled", normalize=False))


@query("encode_cells", "encoded", _long_sql("cell_id", "vec", "encoded"))
def encode_cells(spark, d):
    return _long(E.encode_cells(*fx.rna_side(spark, d), fx.head_weights()), "cell_id", F.col("vec"))


@query("encode_cells_by_join", "encoded", _long_sql("cell_id", "vec", "encoded"))
def encode_cells_by_join(spark, d):
    """The same through a join on genes, as for gene vectors too large to share."""
    out = E.encode_cells(*fx.rna_side(spark, d), fx.head_weights(), limit=0)
    return _long(out, "cell_id", F.col("vec"))


@query("encode_two_modalities", "joint_encoded", _long_sql("cell_id", "vec", "joint_encoded"))
def encode_two_modalities(spark, d):
    out = E.encode_two_modalities(fx.rna_side(spark, d), fx.protein_side(spark, d), fx.head_weights())
    return _long(out, "cell_id", F.col("vec"))


@query(
    "project_single_modality",
    "joint_encoded single_encoded",
    """SELECT cell_id, CAST(i - 1 AS BIGINT) AS pos, round(j.vec[i], 6) AS joint_value, round(s.vec[i], 6) AS single_value
FROM joint_encoded j JOIN single_encoded s USING (cell_id), range(1, 9) r(i)""",
)
def project_single_modality(spark, d):
    out = E.project_single_modality(fx.rna_side(spark, d), fx.protein_side(spark, d), fx.head_weights())
    zipped = F.arrays_zip("joint_vec", "single_vec")
    return out.select("cell_id", F.posexplode(zipped).alias("pos", "e")).select(
        "cell_id",
        F.col("pos").cast("bigint").alias("pos"),
        r6("e.joint_vec").alias("joint_value"),
        r6("e.single_vec").alias("single_value"),
    )


@query(
    "export_attention",
    "rna_attn protein_attn",
    """SELECT 'RNA' AS modality, cell_id, gene_ix, round(weight, 6) AS weight FROM rna_attn
UNION ALL SELECT 'Protein', cell_id, gene_ix, round(weight, 6) FROM protein_attn""",
)
def export_attention(spark, d):
    rna = E.export_attention(*fx.rna_side(spark, d), "RNA")
    protein = E.export_attention(*fx.protein_side(spark, d), "Protein")
    return rna.unionByName(protein).withColumn("weight", r6("weight"))


@query(
    "attention_summary",
    "rna_attn obs",
    "SELECT grp, gene_ix, round(avg(weight), 6) AS mean_weight, count(*) AS n_cells FROM rna_attn JOIN obs USING (cell_id) GROUP BY ALL",
)
def attention_summary(spark, d):
    weights = E.export_attention(*fx.rna_side(spark, d), "RNA")
    out = C.attention_summary(weights, fx.obs(spark, d), "grp")
    return out.withColumn("mean_weight", r6("mean_weight"))


@query(
    "attention_top_genes",
    "rna_attn obs",
    """SELECT grp, gene_ix, round(mean_weight, 6) AS mean_weight, n_cells, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(mean_weight, 10) DESC, gene_ix) AS rank FROM (
    SELECT grp, gene_ix, avg(weight) AS mean_weight, count(*) AS n_cells FROM rna_attn JOIN obs USING (cell_id) GROUP BY ALL)) WHERE rank <= 20""",
)
def attention_top_genes(spark, d):
    """The twenty genes of the highest mean attention of each label."""
    weights = E.export_attention(*fx.rna_side(spark, d), "RNA")
    out = C.attention_summary(weights, fx.obs(spark, d), "grp", n_top=20)
    return out.withColumn("mean_weight", r6("mean_weight"))


@query("fit_linear_embedding")
def fit_linear_embedding(spark, d):
    """Principal components over the most variable genes."""
    from cytoplane.operators.ordering import with_position

    rows = fx.norm(spark, d)
    moments = H.gene_moments(rows, rows.select("cell_id").distinct(), fx.var_genes(spark, d))
    top = H.select_hvg(moments, n_top=64)
    genes = with_position(top.select("gene_id"), ["gene_id"], "gene_ix")
    size = genes.count()
    entries = rows.join(genes, "gene_id").select("cell_id", "gene_ix", "value")
    records = R.build_records(entries)
    dense = R.densify(records, size).select("cell_id", F.col("value").alias("features"))
    return _long(E.fit_linear_embedding(dense, 16), "cell_id", F.col("vec"))


@query("fit_sparse_embedding")
def fit_sparse_embedding(spark, d):
    """Principal components over all genes, from sparse records."""
    from cytoplane.operators.ordering import with_position
    from cytoplane.session import cut

    genes = with_position(fx.var_genes(spark, d).select("gene_id"), ["gene_id"], "gene_ix")
    rows = fx.norm(spark, d).join(genes, "gene_id").select("cell_id", "gene_ix", "value")
    found, _ = E.fit_sparse_embedding(cut(R.build_records(rows)), genes.count(), 16, rounds=12)
    return _long(found, "cell_id", F.col("vec"))


# -------------------------------------------------------------------- classifier


def _classified(spark, d):
    """Fit on the dictionary codes of the label names, on all minibatch groups but one; predict the held-out one."""
    rows = fx.emb(spark, d).select(
        F.col("vec_id").alias("id"), "vec", F.col("label").alias("truth"), F.concat(F.lit("type "), F.col("label")).alias("name"),
        F.when(F.col("part_role") == "query", 1).otherwise(0).alias("batch"),
    )
    names = R.encode_dictionary(rows, {"label": "name"}, "id")
    coded = R.apply_dictionary(rows, names, "label", "name", "code")
    return CL.fit_classifier(coded, held_out=1), coded, names


@query("fit_label_classifier")
def fit_label_classifier(spark, d):
    """Training fit: share of training rows the classifier gets right, by class."""
    model, rows, _ = _classified(spark, d)
    out = CL.predict(model, rows.where("batch <> 1"))
    return out.groupBy("code").agg(
        F.count("*").alias("n"), r6(F.avg((F.col("code") == F.col("pred_code")).cast("double"))).alias("recall")
    )


@query("predict_labels")
def predict_labels(spark, d):
    """Label names of the held-out rows: predicted codes read back through the dictionary."""
    model, rows, names = _classified(spark, d)
    out = R.decode(CL.predict(model, rows.where("batch = 1")), names, "label", "pred_code", "pred_label")
    return out.select("id", "truth", F.col("pred_code").alias("pred"), "pred_label", r6(F.array_max("probability")).alias("confidence"))


@query("predict_label_scores")
def predict_label_scores(spark, d):
    """Accuracy and F1 of the classifier on the batch held out."""
    model, rows, _ = _classified(spark, d)
    out = CL.predict(model, rows.where("batch = 1")).select("id", F.col("code").alias("truth"), F.col("pred_code").alias("pred"))
    scores = M.accuracy(out).withColumn("k", F.lit(0)).join(M.f1_summary(out).withColumn("k", F.lit(0)), "k")
    return scores.select("n", *[r6(c).alias(c) for c in ("accuracy", "f1_median", "f1_macro", "f1_micro")])


# ------------------------------------------------- query-to-reference mapping

block(
    "cell_labels",
    "",
    """SELECT c_custkey AS cell_id, c_mktsegment AS batch, n_regionkey AS truth FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
block(
    "cell_sims",
    "encoded cell_labels",
    f"""SELECT q.cell_id AS query_id, r.cell_id AS ref_id, lr.truth AS label, round(list_dot_product(q.vec, r.vec), 10) AS sim
  FROM encoded q JOIN cell_labels lq ON lq.cell_id = q.cell_id AND lq.batch = '{fx.HELD_OUT}',
    encoded r JOIN cell_labels lr ON lr.cell_id = r.cell_id AND lr.batch <> '{fx.HELD_OUT}'""",
)


@query(
    "map_query_to_reference",
    "cell_sims cell_labels",
    """SELECT query_id, truth, label, round(w / n, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, first_rank) AS place FROM (
    SELECT query_id, label, round(sum(sim), 10) AS w, count(*) AS n, min(rank) AS first_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank FROM cell_sims) WHERE rank <= 5 GROUP BY query_id, label))
JOIN cell_labels ON cell_id = query_id WHERE place = 1""",
)
def map_query_to_reference(spark, d):
    """Counts to labels: preprocess, encode, find neighbours among other batches, vote."""
    from cytoplane.session import cut

    nation, cells = fx.table(spark, d, "nation"), fx.table(spark, d, "customer")
    labels = cells.join(nation, cells.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("batch"), F.col("n_regionkey").alias("label")
    )
    vecs = cut(E.encode_cells(*fx.rna_side(spark, d), fx.head_weights()))
    coded = vecs.withColumnRenamed("cell_id", "id").join(labels, "id")
    held = F.col("batch") == fx.HELD_OUT
    found = T.transfer_labels(coded.where(held).select("id", "vec"), coded.where(~held).select("id", "vec", "label"), 5)
    truth = labels.select(F.col("id").alias("query_id"), F.col("label").alias("truth"))
    return found.join(truth, "query_id").select("query_id", "truth", "label", r6("confidence").alias("confidence"))
