"""Queries: cohort statistics, markers, tests and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.operators import batching as B
from cytoplane.operators import cohort as C
from cytoplane.operators import metrics as M
from cytoplane.operators import udf as U
from cytoplane.plans import fixtures as fx
from cytoplane.plans.fixtures import r6
from cytoplane.plans.registry import block, query


@query("value_counts", "obs", "SELECT sample, count(*) AS n FROM obs GROUP BY sample")
def value_counts(spark, d):
    return C.value_counts(fx.obs(spark, d), "sample")


@query(
    "distinct_values",
    "obs",
    """SELECT 'batch' AS kind, batch AS value FROM obs GROUP BY batch UNION ALL SELECT 'sample', sample FROM obs GROUP BY sample""",
)
def distinct_values(spark, d):
    obs = fx.obs(spark, d)
    parts = [
        C.distinct_values(obs, c).select(F.lit(c).alias("kind"), F.col(c).alias("value"))
        for c in ("batch", "sample")
    ]
    return parts[0].unionByName(parts[1])


@query("crosstab", "obs", "SELECT batch, sample, count(*) AS n FROM obs GROUP BY ALL")
def crosstab(spark, d):
    return C.crosstab(fx.obs(spark, d), "batch", "sample")


block(
    "shares",
    "obs",
    """SELECT b.batch, s.sample, count(o.cell_id) / max(s.n) AS share
  FROM (SELECT DISTINCT batch FROM obs) b, (SELECT sample, count(*) AS n FROM obs GROUP BY sample) s
  LEFT JOIN obs o ON o.batch = b.batch AND o.sample = s.sample GROUP BY b.batch, s.sample""",
)


def _shares(spark, d):
    return C.composition(fx.obs(spark, d).select("batch", "sample"), "batch", "sample")


@query("composition_by_sample", "shares", "SELECT batch, sample, round(share, 6) AS share FROM shares")
def composition_by_sample(spark, d):
    return _shares(spark, d).select("batch", "sample", r6("share").alias("share"))


@query(
    "sample_to_group_left_join",
    "shares obs",
    "SELECT s.batch, s.sample, round(s.share, 6) AS share, g.grp FROM shares s LEFT JOIN (SELECT DISTINCT sample, grp FROM obs) g USING (sample)",
)
def sample_to_group_left_join(spark, d):
    rows = _shares(spark, d).withColumn("share", r6("share"))
    return C.attach_group(rows, fx.obs(spark, d), "sample", "grp").select("batch", "sample", "share", "grp")


block(
    "gene_means",
    "norm obs markers",
    """SELECT c.sample, m.gene_id, c.n AS n_cells, coalesce(s, 0) / c.n AS mean_value
  FROM (SELECT sample, count(*) AS n FROM obs GROUP BY sample) c, (SELECT DISTINCT gene_id FROM markers) m
  LEFT JOIN (SELECT o.sample, gene_id, sum(value) AS s FROM norm JOIN obs o USING (cell_id) GROUP BY ALL) x
    ON x.sample = c.sample AND x.gene_id = m.gene_id""",
)


def _gene_means(spark, d):
    return C.mean_by_sample(fx.norm(spark, d), fx.obs(spark, d), fx.markers(spark, d))


@query(
    "mean_expr_by_sample",
    "gene_means",
    "SELECT sample, gene_id, n_cells, round(mean_value, 6) AS mean_value FROM gene_means",
)
def mean_expr_by_sample(spark, d):
    return _gene_means(spark, d).select("sample", "gene_id", "n_cells", r6("mean_value").alias("mean_value"))


@query(
    "lookup_group",
    "gene_means obs",
    """SELECT m.sample, g.grp, count(*) AS n_genes, round(sum(m.mean_value), 6) AS total
FROM gene_means m LEFT JOIN (SELECT DISTINCT sample, grp FROM obs) g USING (sample) GROUP BY ALL""",
)
def lookup_group(spark, d):
    rows = C.attach_group(_gene_means(spark, d), fx.obs(spark, d), "sample", "grp")
    return rows.groupBy("sample", "grp").agg(
        F.count("*").alias("n_genes"), r6(F.sum("mean_value")).alias("total")
    )


@query(
    "box_stats_by_group",
    "obs",
    """SELECT grp, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(score) FILTER (score >= q1 - 1.5 * (q3 - q1) AND score <= q3 + 1.5 * (q3 - q1)) AS low_whisker,
  max(score) FILTER (score >= q1 - 1.5 * (q3 - q1) AND score <= q3 + 1.5 * (q3 - q1)) AS high_whisker,
  count(*) FILTER (score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS outliers
FROM obs JOIN (SELECT grp, count(*) AS n, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3
  FROM obs GROUP BY grp) USING (grp) GROUP BY grp, n, q1, median, q3""",
)
def box_stats_by_group(spark, d):
    stats = C.box_stats(fx.obs(spark, d).select("grp", "score"), ["grp"], "score")
    return stats.withColumns({c: r6(c) for c in ("q1", "median", "q3")})


@query(
    "marker_dotplot_table",
    "norm obs markers",
    """SELECT m.set_name, m.gene_id, c.grp, round(coalesce(s, 0) / c.n, 6) AS mean_value, round(coalesce(k, 0) / c.n, 6) AS share_above_zero
FROM markers m, (SELECT grp, count(*) AS n FROM obs GROUP BY grp) c
LEFT JOIN (SELECT o.grp, gene_id, sum(value) AS s, count(*) FILTER (value > 0) AS k FROM norm JOIN obs o USING (cell_id) GROUP BY ALL) x
  ON x.grp = c.grp AND x.gene_id = m.gene_id""",
)
def marker_dotplot_table(spark, d):
    t = C.marker_table(fx.norm(spark, d), fx.obs(spark, d), fx.markers(spark, d), "grp")
    return t.withColumns({c: r6(c) for c in ("mean_value", "share_above_zero")})


@query(
    "marker_heatmap_table",
    "norm obs markers",
    """SELECT o.grp, e.cell_id, e.gene_id, round(coalesce((e.value - lo) / nullif(hi - lo, 0), 0), 6) AS scaled
FROM norm e JOIN obs o USING (cell_id) JOIN (
  SELECT cell_id, CASE WHEN count(*) < g THEN least(min(value), 0) ELSE min(value) END AS lo,
    CASE WHEN count(*) < g THEN greatest(max(value), 0) ELSE max(value) END AS hi
  FROM norm, (SELECT count(DISTINCT gene_id) AS g FROM markers) WHERE gene_id IN (SELECT gene_id FROM markers) GROUP BY cell_id, g) USING (cell_id)
WHERE e.gene_id IN (SELECT gene_id FROM markers)""",
)
def marker_heatmap_table(spark, d):
    t = C.marker_heatmap(fx.norm(spark, d), fx.obs(spark, d), fx.markers(spark, d), "grp")
    return t.withColumn("scaled", r6("scaled"))


@query(
    "signature_score",
    "norm obs markers",
    """SELECT o.cell_id, z.set_name, round(coalesce(s, 0) / z.n - coalesce(w, 0) / (SELECT count(*) FROM part), 6) AS score
FROM obs o CROSS JOIN (SELECT set_name, count(DISTINCT gene_id) AS n FROM markers GROUP BY set_name) z
LEFT JOIN (SELECT cell_id, sum(value) AS w FROM norm GROUP BY cell_id) x ON x.cell_id = o.cell_id
LEFT JOIN (SELECT cell_id, set_name, sum(value) AS s FROM norm JOIN markers USING (gene_id) GROUP BY ALL) y
  ON y.cell_id = o.cell_id AND y.set_name = z.set_name""",
)
def signature_score(spark, d):
    n_genes = fx.var_genes(spark, d).count()
    t = C.signature_score(fx.norm(spark, d), fx.obs(spark, d), fx.markers(spark, d), n_genes)
    return t.withColumn("score", r6("score"))


@query(
    "epoch_metrics",
    "",
    """SELECT CAST(ts AS DATE) AS epoch, event_type AS file, count(*) AS steps, round(avg(value), 6) AS loss,
  round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY 1, 2""",
)
def epoch_metrics(spark, d):
    log = fx.table(spark, d, "events").select(
        F.to_date("ts").alias("epoch"), F.col("event_type").alias("file"), "value"
    )
    t = C.epoch_metrics(log, "epoch", "file", "value", F.col("value") > 10)
    return t.withColumns({c: r6(c) for c in ("loss", "accuracy")})


@query(
    "rank_with_ties",
    "obs expr",
    """SELECT grp, value, count(*) AS n, avg(r) AS rank FROM (
  SELECT o.grp, e.value, row_number() OVER (PARTITION BY o.grp ORDER BY e.value) AS r FROM expr e JOIN obs o USING (cell_id))
GROUP BY grp, value""",
)
def rank_with_ties(spark, d):
    rows = fx.expr(spark, d).join(fx.obs(spark, d).select("cell_id", "grp"), "cell_id")
    return C.ranks_with_ties(rows.select("grp", "value"), ["grp"], "value")


PAIRS = [("AFRICA", "ASIA"), ("AFRICA", "EUROPE"), ("ASIA", "EUROPE")]
PAIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)


def _ranksum_sql(rows: str, by: str, value: str) -> str:
    return f"""SELECT {by}, group_a, group_b, n_a, n_b, u,
  round(CASE WHEN var > 0 THEN greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(var) END, 6) AS z FROM (
  SELECT {by}, group_a, group_b, n_a, n_b, rank_sum - n_a * (n_a + 1) / 2 AS u,
    n_a * n_b / 12 * (n_a + n_b + 1 - tie / nullif((n_a + n_b) * (n_a + n_b - 1), 0)) AS var FROM (
    SELECT {by}, group_a, group_b, CAST(sum(ta) AS BIGINT) AS n_a, CAST(sum(tb) AS BIGINT) AS n_b,
      sum(ta * (upto - t + (t + 1) / 2)) AS rank_sum, sum(CAST(t AS DOUBLE) * t * t - t) AS tie FROM (
      SELECT *, sum(t) OVER (PARTITION BY {by}, group_a, group_b ORDER BY {value}) AS upto FROM (
        SELECT {by}, group_a, group_b, {value}, count(*) AS t, count(*) FILTER (grp = group_a) AS ta, count(*) FILTER (grp = group_b) AS tb
        FROM {rows} JOIN (VALUES {PAIR_ROWS}) p(group_a, group_b) ON grp = group_a OR grp = group_b GROUP BY ALL))
    GROUP BY ALL)) WHERE n_a > 0 AND n_b > 0"""


block("grouped_shares", "shares obs", "SELECT s.batch, round(s.share, 9) AS share, g.grp FROM shares s JOIN (SELECT DISTINCT sample, grp FROM obs) g USING (sample)")
block("grouped_scores", "obs", "SELECT batch, score, grp FROM obs")


@query("ranksum_test", "grouped_shares", _ranksum_sql("grouped_shares", "batch", "share"))
def ranksum_test(spark, d):
    """Shares of each cluster by sample, compared between groups."""
    rows = C.attach_group(_shares(spark, d), fx.obs(spark, d), "sample", "grp")
    rows = rows.withColumn("share", F.round("share", 9))
    return C.ranksum(rows, ["batch"], "grp", "share", PAIRS, with_p=False).withColumn("z", r6("z"))


@query("ranksum_test_cells", "grouped_scores", _ranksum_sql("grouped_scores", "batch", "score"))
def ranksum_test_cells(spark, d):
    rows = fx.obs(spark, d).select("batch", "score", "grp")
    return C.ranksum(rows, ["batch"], "grp", "score", PAIRS, with_p=False).withColumn("z", r6("z"))


@query("ranksum_p_values")
def ranksum_p_values(spark, d):
    """As ``ranksum_test_cells`` with p and its star label."""
    rows = fx.obs(spark, d).select("batch", "score", "grp")
    return C.ranksum(rows, ["batch"], "grp", "score", PAIRS)


# ------------------------------------------------------------------- metrics


@query("accuracy", "preds", "SELECT count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds")
def accuracy(spark, d):
    return M.accuracy(fx.preds(spark, d)).withColumn("accuracy", r6("accuracy"))


block(
    "f1",
    "preds",
    """SELECT label, coalesce(2 * tp / nullif(2 * tp + miss, 0), 0) AS f1, tp, miss FROM (
    SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(miss) AS BIGINT) AS miss FROM (
      SELECT truth AS label, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp, CASE WHEN truth = pred THEN 0 ELSE 1 END AS miss FROM preds
      UNION ALL SELECT pred, 0, CASE WHEN truth = pred THEN 0 ELSE 1 END FROM preds) GROUP BY label)""",
)


@query("f1_by_class", "f1", "SELECT CAST(label AS INTEGER) AS label, round(f1, 6) AS f1, tp, miss FROM f1")
def f1_by_class(spark, d):
    return M.f1_by_class(fx.preds(spark, d)).withColumn("f1", r6("f1"))


@query(
    "f1_scores",
    "f1",
    "SELECT round(quantile_cont(f1, 0.5), 6) AS f1_median, round(avg(f1), 6) AS f1_macro, round(2 * sum(tp) / (2 * sum(tp) + sum(miss)), 6) AS f1_micro FROM f1",
)
def f1_scores(spark, d):
    t = M.f1_summary(fx.preds(spark, d))
    return t.withColumns({c: r6(c) for c in ("f1_median", "f1_macro", "f1_micro")})


block("cells_n", "preds", "SELECT truth, pred, count(*) AS n FROM preds GROUP BY ALL")


@query(
    "adjusted_rand",
    "cells_n",
    """SELECT round(coalesce((b - r * c / p) / nullif((r + c) / 2 - r * c / p, 0), 1), 6) AS ari FROM
(SELECT sum(n * (n - 1) / 2) AS b FROM cells_n),
(SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM cells_n GROUP BY truth)),
(SELECT sum(n * (n - 1) / 2) AS c FROM (SELECT sum(n) AS n FROM cells_n GROUP BY pred)),
(SELECT sum(n) * (sum(n) - 1) / 2 AS p FROM cells_n)""",
)
def adjusted_rand(spark, d):
    return M.adjusted_rand(fx.preds(spark, d)).withColumn("ari", r6("ari"))


@query(
    "normalized_mutual_info",
    "cells_n",
    """SELECT round(greatest(mi, 0) / ((ht + hp) / 2), 6) AS nmi FROM
(SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM cells_n JOIN (SELECT truth, sum(n) AS a FROM cells_n GROUP BY truth) USING (truth)
  JOIN (SELECT pred, sum(n) AS b FROM cells_n GROUP BY pred) USING (pred), (SELECT sum(n) AS t FROM cells_n)),
(SELECT -sum(a / t * ln(a / t)) AS ht FROM (SELECT sum(n) AS a FROM cells_n GROUP BY truth), (SELECT sum(n) AS t FROM cells_n)),
(SELECT -sum(b / t * ln(b / t)) AS hp FROM (SELECT sum(n) AS b FROM cells_n GROUP BY pred), (SELECT sum(n) AS t FROM cells_n))""",
)
def normalized_mutual_info(spark, d):
    return M.normalized_mutual_info(fx.preds(spark, d)).withColumn("nmi", r6("nmi"))


@query(
    "silhouette",
    "emb",
    """SELECT round(avg(s), 6) AS silhouette, count(*) AS n FROM (
  SELECT id, CASE WHEN max(size) <= 1 THEN 0 ELSE (min(b) - max(a)) / greatest(max(a), min(b)) END AS s FROM (
    SELECT id, CASE WHEN own = label THEN n END AS size, CASE WHEN own = label THEN total / (n - 1) END AS a, CASE WHEN own <> label THEN total / n END AS b
    FROM (SELECT x.vec_id AS id, x.label AS own, y.label, count(*) AS n, sum(round(list_distance(x.vec, y.vec), 10)) AS total
          FROM emb x, emb y GROUP BY ALL)) GROUP BY id)""",
)
def silhouette(spark, d):
    return M.silhouette(fx.points(spark, d)).withColumn("silhouette", r6("silhouette"))


@query(
    "silhouette_squared",
    "emb",
    """SELECT round(avg(s), 6) AS silhouette, count(*) AS n FROM (
  SELECT id, CASE WHEN max(size) <= 1 THEN 0 ELSE (min(b) - max(a)) / greatest(max(a), min(b)) END AS s FROM (
    SELECT id, CASE WHEN own = label THEN n END AS size, CASE WHEN own = label THEN total / (n - 1) END AS a, CASE WHEN own <> label THEN total / n END AS b
    FROM (SELECT x.vec_id AS id, x.label AS own, y.label, count(*) AS n, sum(list_distance(x.vec, y.vec) * list_distance(x.vec, y.vec)) AS total
          FROM emb x, emb y GROUP BY ALL)) GROUP BY id)""",
)
def silhouette_squared(spark, d):
    """Silhouette from the sums of each cluster, without pairs of points."""
    return M.silhouette_squared(fx.points(spark, d)).withColumn("silhouette", r6("silhouette"))


# The best one-to-one match by dynamic programming over sets of labels: after each
# cluster, the most rows matched with the labels of each set taken.
block("label_bits", "cells_n", "SELECT truth, CAST(1 AS BIGINT) << CAST(row_number() OVER (ORDER BY truth) - 1 AS BIGINT) AS bit FROM cells_n GROUP BY truth")
block("cluster_steps", "cells_n", "SELECT pred, row_number() OVER (ORDER BY pred) - 1 AS step FROM cells_n GROUP BY pred")
block(
    "matchings",
    "cells_n label_bits cluster_steps",
    """SELECT CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS matched
  UNION ALL
  SELECT step + 1, taken, CAST(max(matched) AS BIGINT) FROM (
    SELECT m.step, m.taken | coalesce(l.bit, 0) AS taken, m.matched + coalesce(c.n, 0) AS matched
    FROM matchings m JOIN cluster_steps s ON s.step = m.step
    JOIN (SELECT truth, bit FROM label_bits UNION SELECT NULL, 0) l ON (m.taken & l.bit) = 0
    LEFT JOIN cells_n c ON c.truth = l.truth AND c.pred = s.pred) GROUP BY step, taken""",
)
block(
    "best_match",
    "matchings cells_n cluster_steps",
    """SELECT max(matched) AS matched, (SELECT CAST(sum(n) AS BIGINT) FROM cells_n) AS n FROM matchings
  WHERE step = (SELECT count(*) FROM cluster_steps)""",
)


@query("cluster_accuracy", "best_match", "SELECT matched, n, matched / n AS accuracy FROM best_match")
def cluster_accuracy(spark, d):
    return M.cluster_accuracy(fx.preds(spark, d))


@query("cluster_error", "best_match", "SELECT 1 - matched / n AS error FROM best_match")
def cluster_error(spark, d):
    return M.cluster_error(fx.preds(spark, d))


# ------------------------------------------------------------ user functions


def _text_facts(pdf):
    return pdf.assign(
        words=pdf["text"].str.split().str.len(), lines=pdf["text"].str.count("\n") + 1
    )[["doc_id", "words", "lines"]]


@query(
    "parallel_map",
    "",
    """SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[\\s\\x{A0}]+'), lambda w: w <> '')) AS BIGINT) AS words,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines FROM documents""",
)
def parallel_map(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    return U.parallel_map(docs, _text_facts, "doc_id bigint, words bigint, lines bigint")


def _partial_mean(pdf):
    return pdf.groupby("sample", as_index=False).agg(s=("value", "sum"), c=("value", "size"))


@query(
    "grouped_apply",
    "expr obs",
    "SELECT o.sample, count(*) AS n, round(avg(e.value), 6) AS mean_value FROM expr e JOIN obs o USING (cell_id) GROUP BY o.sample",
)
def grouped_apply(spark, d):
    rows = fx.expr(spark, d).join(fx.obs(spark, d).select("cell_id", "sample"), "cell_id")
    merge = [F.sum("c").alias("n"), r6(F.sum("s") / F.sum("c")).alias("mean_value")]
    return U.grouped_apply(
        rows.select("sample", "value"), ["sample"], _partial_mean, "sample string, s double, c bigint", merge
    )
