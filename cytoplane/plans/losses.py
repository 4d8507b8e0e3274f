"""Queries: loss and pseudo-label reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.functions import vectors as V
from cytoplane.operators import losses as L
from cytoplane.plans import fixtures as fx
from cytoplane.plans.fixtures import r6
from cytoplane.plans.registry import block, query


def _rounded(df, *names):
    return df.withColumns({c: r6(c) for c in names})


block(
    "views",
    "pairs",
    """SELECT minibatch_id, vec_id, 'a' AS side, list_transform(a, lambda x: x / sqrt(greatest(list_dot_product(a, a), 1e-12))) AS v FROM pairs
  UNION SELECT minibatch_id, vec_id, 'b', list_transform(b, lambda x: x / sqrt(greatest(list_dot_product(b, b), 1e-12))) FROM pairs""",
)


@query(
    "contrastive_loss_report",
    "views",
    """SELECT minibatch_id, count(*) // 2 AS n, round(2 * avg(l), 6) AS loss FROM (
  SELECT x.minibatch_id, x.vec_id, x.side, ln(sum(exp(list_dot_product(x.v, y.v) / 0.1)))
    - max(CASE WHEN x.vec_id = y.vec_id THEN list_dot_product(x.v, y.v) / 0.1 END) AS l
  FROM views x JOIN views y ON x.minibatch_id = y.minibatch_id AND (x.vec_id <> y.vec_id OR x.side <> y.side) GROUP BY ALL)
GROUP BY minibatch_id""",
)
def contrastive_loss_report(spark, d):
    rows = fx.pairs(spark, d).withColumnRenamed("vec_id", "id")
    return _rounded(L.contrastive_loss(rows), "loss")


@query(
    "supervised_contrastive_report",
    "logits emb",
    """SELECT minibatch_id, count(l) AS anchors, round(avg(l), 6) AS loss FROM (
  SELECT x.minibatch_id, x.vec_id, -avg(CASE WHEN x.label = y.label THEN s - z END) AS l FROM (
    SELECT a.minibatch_id, a.vec_id, a.label, b.vec_id AS other, list_dot_product(ea.vec, eb.vec) / 0.1 AS s,
      ln(sum(exp(list_dot_product(ea.vec, eb.vec) / 0.1)) OVER (PARTITION BY a.vec_id)) AS z
    FROM logits a JOIN logits b ON a.minibatch_id = b.minibatch_id AND a.vec_id <> b.vec_id
    JOIN emb ea ON ea.vec_id = a.vec_id JOIN emb eb ON eb.vec_id = b.vec_id) x JOIN emb y ON y.vec_id = x.other GROUP BY ALL)
GROUP BY minibatch_id""",
)
def supervised_contrastive_report(spark, d):
    rows = fx.emb(spark, d).select(F.expr("vec_id div 20").alias("minibatch_id"), F.col("vec_id").alias("id"), "vec", "label")
    return _rounded(L.supervised_contrastive(rows), "loss")


@query(
    "paired_cosine_loss",
    "pairs",
    "SELECT round(2 - 2 * avg(list_cosine_similarity(a, b)), 6) AS loss, count(*) AS n FROM pairs",
)
def paired_cosine_loss(spark, d):
    return _rounded(L.paired_cosine_loss(fx.pairs(spark, d)), "loss")


@query(
    "neighbour_consistency_report",
    "probs",
    """SELECT round(c, 6) AS consistency, round(h, 6) AS entropy, round(c - h, 6) AS total FROM
(SELECT avg(ln(1 + exp(-list_dot_product(p, q)))) AS c FROM probs),
(SELECT sum(-m * ln(m)) AS h FROM (SELECT i, greatest(avg(p[i]), 1e-8) AS m FROM probs, range(1, 11) r(i) GROUP BY i))""",
)
def neighbour_consistency_report(spark, d):
    rows = fx.logits(spark, d).select(F.col("logits").alias("anchor"), F.col("aug").alias("neighbour"))
    return _rounded(L.neighbour_consistency(rows), "consistency", "entropy", "total")


block(
    "joint",
    "probs",
    "SELECT i, j, sum(p[i] * q[j]) AS w FROM probs, range(1, 11) a(i), range(1, 11) b(j) GROUP BY i, j",
)
block("even", "joint", "SELECT a.i, a.j, greatest((a.w + b.w) / 2, 1e-9) AS w FROM joint a JOIN joint b ON a.i = b.j AND a.j = b.i")


@query(
    "mutual_information_report",
    "even",
    """SELECT round(-sum(w / t * (ln(w / t) - ln(wi / t) - ln(wj / t))), 6) AS loss FROM even
JOIN (SELECT i, sum(w) AS wi FROM even GROUP BY i) USING (i) JOIN (SELECT j, sum(w) AS wj FROM even GROUP BY j) USING (j), (SELECT sum(w) AS t FROM even)""",
)
def mutual_information_report(spark, d):
    rows = fx.logits(spark, d).select(V.softmax(F.col("logits")).alias("p"), V.softmax(F.col("aug")).alias("q"))
    return _rounded(L.mutual_information_loss(rows), "loss")


block(
    "terms",
    "probs",
    """SELECT vec_id, label, -logp[label + 1] AS ce, list_max(p) AS best,
    list_transform(logits, lambda x, i: greatest(x, 0) - x * (CASE WHEN i = label + 1 THEN 1 ELSE 0 END) + ln(1 + exp(-abs(x)))) AS bce FROM probs""",
)


@query(
    "cross_entropy_report",
    "terms",
    """SELECT 'categorical' AS form, count(*) AS n, round(avg(ce), 6) AS loss FROM terms
UNION ALL SELECT 'binary', count(*), round(avg(list_sum(bce) / 10), 6) FROM terms
UNION ALL SELECT 'masked', count(*), round(sum(list_sum(bce)) / sum(len(list_filter(bce, lambda x: x <> 0))), 6) FROM terms WHERE best > 0.4""",
)
def cross_entropy_report(spark, d):
    rows = fx.logits(spark, d)
    keep = F.array_max(V.softmax(F.col("logits"))) > 0.4
    parts = {
        "categorical": L.cross_entropy(rows),
        "binary": L.binary_cross_entropy(rows),
        "masked": L.masked_cross_entropy(rows, keep),
    }
    out = None
    for form, df in parts.items():
        line = df.select(F.lit(form).alias("form"), "n", r6("loss").alias("loss"))
        out = line if out is None else out.unionByName(line)
    return out


@query(
    "pseudo_labels",
    "probs",
    """SELECT vec_id, CAST(list_position(sharp, list_max(sharp)) - 1 AS INTEGER) AS pseudo_label, round(list_max(sharp), 6) AS confidence, list_max(sharp) >= 0.6 AS kept FROM probs""",
)
def pseudo_labels(spark, d):
    out = L.pseudo_labels(fx.logits(spark, d)).select("vec_id", "pseudo_label", "confidence", "kept")
    return _rounded(out, "confidence")


@query(
    "mask_rates",
    "probs",
    """SELECT round(avg(CASE WHEN list_max(sharp) >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS unlabelled_rate,
  round(avg(CASE WHEN p[label + 1] <= 300.0 / 1000 * (1 - 1.0 / 10) + 1.0 / 10 THEN 1.0 ELSE 0.0 END), 6) AS labelled_rate FROM probs""",
)
def mask_rates(spark, d):
    return _rounded(L.mask_rates(fx.logits(spark, d), 300, 1000, 10), "unlabelled_rate", "labelled_rate")


@query(
    "confidence_based_loss",
    "probs",
    """SELECT count(*) AS n, round(sum(list_sum(t)) / sum(len(list_filter(t, lambda x: x <> 0))), 6) AS loss FROM (
  SELECT list_transform(aug, lambda x, i: greatest(x, 0) - x * (CASE WHEN i = list_position(p, list_max(p)) THEN 1 ELSE 0 END) + ln(1 + exp(-abs(x)))) AS t
  FROM probs WHERE list_max(p) > 0.4)""",
)
def confidence_based_loss(spark, d):
    rows = fx.logits(spark, d).select(F.col("logits").alias("weak"), F.col("aug").alias("strong"))
    return _rounded(L.confidence_based_loss(rows, 0.4), "loss")


CONSISTENCY = """SELECT minibatch_id, count(*) AS n, round(avg(l), 6) AS labelled, round(avg(u), 6) AS unlabelled,
  round(avg(u / 10), 6) AS unlabelled_mean, round(avg(k), 6) AS kept_rate FROM ({rows}) GROUP BY minibatch_id"""


@query(
    "consistency_loss_report",
    "probs",
    CONSISTENCY.format(
        rows="""SELECT minibatch_id, -logp[label + 1] AS l, CASE WHEN list_max(sharp) >= 0.6 THEN 1.0 ELSE 0.0 END AS k,
  CASE WHEN list_max(sharp) >= 0.6 THEN -list_dot_product(sharp, logq) ELSE 0 END AS u FROM probs"""
    ),
)
def consistency_loss_report(spark, d):
    return _consistency(spark, d, "softmax")


@query(
    "consistency_loss_report_sigmoid",
    "probs",
    CONSISTENCY.format(
        rows="""SELECT minibatch_id, list_sum(list_transform(logits, lambda x, i: greatest(x, 0) - x * (CASE WHEN i = label + 1 THEN 1 ELSE 0 END) + ln(1 + exp(-abs(x))))) AS l,
  CASE WHEN list_max(s) >= 0.6 THEN 1.0 ELSE 0.0 END AS k, CASE WHEN list_max(s) >= 0.6 THEN -list_dot_product(s, g) ELSE 0 END AS u
  FROM (SELECT *, list_transform(logits, lambda x: 1 / (1 + exp(-x / 0.5))) AS s, list_transform(aug, lambda x: 1 / (1 + exp(-x))) AS g FROM probs)"""
    ),
)
def consistency_loss_report_sigmoid(spark, d):
    return _consistency(spark, d, "sigmoid")


def _consistency(spark, d, activation):
    rows = fx.logits(spark, d).select(
        "minibatch_id", "label", "logits", F.col("logits").alias("u_ori"), F.col("aug").alias("u_aug")
    )
    out = L.consistency_losses(rows, ["minibatch_id"], activation=activation)
    return _rounded(out, "labelled", "unlabelled", "unlabelled_mean", "kept_rate")
