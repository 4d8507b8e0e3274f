"""Loss and pseudo-label reports over tables of logits, probabilities or vectors.

These are read-outs: the tables come from a model, the reports say how well it
does. Per-row parts are column expressions; contrastive reports gather one
mini-batch at a time, whose size is fixed when mini-batches are assigned, and
score it tile by tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.functions import vectors as V

# Fixed values.
CONTRASTIVE_TEMPERATURE = 0.1
CONFIDENCE = 0.9
UDA_THRESHOLD = 0.6
JOINT_FLOOR = 1e-9

TILE = 1024  # rows of a mini-batch that are scored at once against all of it


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), V.NORM_FLOOR))


def _log_sum(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=1)
    return top + np.log(np.exp(scores - top[:, None]).sum(axis=1))


def contrastive_loss(
    pairs: DataFrame, batch: str = "minibatch_id", temperature: float = CONTRASTIVE_TEMPERATURE
) -> DataFrame:
    """NT-Xent loss per mini-batch; ``pairs`` holds ``minibatch_id, id, a, b``.

    Each vector is scored against its twin and all others of both views, its
    own copy left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _unit(np.stack(pdf["a"])), _unit(np.stack(pdf["b"]))
        rows = np.zeros(len(a))
        for one, two in ((a, b), (b, a)):
            for low in range(0, len(a), TILE):
                part = one[low : low + TILE]
                at = np.arange(len(part))
                other = part @ two.T / temperature
                own = part @ one.T / temperature
                own[at, low + at] = -np.inf
                rows[low : low + TILE] += _log_sum(np.hstack([other, own])) - other[at, low + at]
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "n": [len(a)], "loss": [rows.mean()]})

    return pairs.groupBy(batch).applyInPandas(run, f"{batch} bigint, n bigint, loss double")


def supervised_contrastive(
    rows: DataFrame, batch: str = "minibatch_id", temperature: float = CONTRASTIVE_TEMPERATURE
) -> DataFrame:
    """Mean log-probability of same-label partners per mini-batch, negated.

    ``rows`` holds ``minibatch_id, id, vec, label``; rows without a partner are
    left out of the mean and counted.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, label = np.stack(pdf["vec"]), pdf["label"].to_numpy()
        logp, partners = np.zeros(len(v)), np.zeros(len(v), dtype=np.int64)
        for low in range(0, len(v), TILE):
            part = v[low : low + TILE]
            at = np.arange(len(part))
            scores = part @ v.T / temperature
            scores[at, low + at] = -np.inf
            same = label[low : low + TILE, None] == label[None, :]
            same[at, low + at] = False
            partners[low : low + TILE] = same.sum(axis=1)
            if len(v) > 1:
                logp[low : low + TILE] = np.where(same, scores - _log_sum(scores)[:, None], 0.0).sum(axis=1)
        has = partners > 0
        loss = -(logp[has] / partners[has]).mean() if has.any() else None
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "anchors": [int(has.sum())], "loss": [loss]})

    return rows.groupBy(batch).applyInPandas(run, f"{batch} bigint, anchors bigint, loss double")


def paired_cosine_loss(pairs: DataFrame) -> DataFrame:
    """2 - 2 * mean cosine of the paired vectors ``a`` and ``b``."""
    cosine = V.inner_product(V.l2_normalize(F.col("a")), V.l2_normalize(F.col("b")))
    return pairs.agg((2 - 2 * F.avg(cosine)).alias("loss"), F.count("*").alias("n"))


def mean_vector(rows: DataFrame, vec: Column, by: list[str] | None = None) -> DataFrame:
    """Element-wise mean, one row per element: ``*by, pos, mean``."""
    by = by or []
    return (
        rows.select(*by, F.posexplode(vec).alias("pos", "x"))
        .groupBy(*by, "pos")
        .agg(F.avg("x").alias("mean"))
    )


def neighbour_consistency(pairs: DataFrame, entropy_weight: float = 1.0) -> DataFrame:
    """Agreement of anchor and neighbour logits minus entropy of the mean prediction."""
    probs = pairs.select(
        V.softmax(F.col("anchor")).alias("p"), V.softmax(F.col("neighbour")).alias("q")
    )
    agree = V.inner_product(F.col("p"), F.col("q"))
    consistency = probs.agg(
        F.avg(V.sigmoid_cross_entropy(agree, F.lit(1.0))).alias("consistency")
    )
    floored = F.greatest(F.col("mean"), F.lit(V.ENTROPY_FLOOR))
    spread = mean_vector(probs, F.col("p")).agg(F.sum(-floored * F.log(floored)).alias("entropy"))
    both = consistency.unionByName(spread, allowMissingColumns=True).agg(
        F.max("consistency").alias("consistency"), F.max("entropy").alias("entropy")
    )
    total = F.col("consistency") - F.lit(entropy_weight) * F.col("entropy")
    return both.withColumn("total", total)


def mutual_information_loss(pairs: DataFrame) -> DataFrame:
    """Negated mutual information of paired soft predictions ``p`` and ``q``.

    The joint class matrix is summed on Spark; it has classes x classes rows.
    """
    joint = (
        pairs.select("q", F.posexplode("p").alias("i", "pi"))
        .select("i", "pi", F.posexplode("q").alias("j", "qj"))
        .groupBy("i", "j")
        .agg(F.sum(F.col("pi") * F.col("qj")).alias("w"))
    )
    turned = joint.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    even = joint.join(turned, ["i", "j"]).select(
        "i", "j", F.greatest((F.col("w") + F.col("v")) / 2, F.lit(JOINT_FLOOR)).alias("w")
    )
    rows = even.groupBy("i").agg(F.sum("w").alias("wi"))
    cols = even.groupBy("j").agg(F.sum("w").alias("wj"))
    w = F.col("w")
    # With total T: sum(w/T * (ln w/T - ln wi/T - ln wj/T)).
    return even.join(rows, "i").join(cols, "j").agg(
        (
            -(F.sum(w * (F.log(w) - F.log("wi") - F.log("wj"))) / F.sum(w) + F.log(F.sum(w)))
        ).alias("loss")
    )


def cross_entropy(rows: DataFrame) -> DataFrame:
    """Mean categorical cross-entropy of ``logits`` against class ``label``."""
    picked = F.element_at(V.log_softmax(F.col("logits")), F.col("label") + 1)
    return rows.agg(F.count("*").alias("n"), F.avg(-picked).alias("loss"))


def binary_cross_entropy(rows: DataFrame) -> DataFrame:
    """Mean over classes, then rows, of the sigmoid cross-entropy to the one-hot label."""
    return rows.agg(F.count("*").alias("n"), F.avg(_sigmoid_terms() / F.size("logits")).alias("loss"))


def _sigmoid_terms() -> Column:
    hits = F.transform(
        F.col("logits"),
        lambda x, i: V.sigmoid_cross_entropy(x, (i == F.col("label")).cast("double")),
    )
    return V.total(hits)


def masked_cross_entropy(rows: DataFrame, keep: Column) -> DataFrame:
    """Sigmoid cross-entropy over kept rows, divided by the number of non-zero terms."""
    terms = F.transform(
        F.col("logits"),
        lambda x, i: V.sigmoid_cross_entropy(x, (i == F.col("label")).cast("double")),
    )
    nonzero = F.size(F.filter(terms, lambda t: t != 0))
    return rows.where(keep).agg(
        F.count("*").alias("n"), (F.sum(V.total(terms)) / F.sum(nonzero)).alias("loss")
    )


def pseudo_labels(
    rows: DataFrame, temperature: float = V.SHARPEN_TEMPERATURE, threshold: float = UDA_THRESHOLD
) -> DataFrame:
    """Sharpened target, its class, its confidence and whether it passes."""
    target = V.sharpen(F.col("logits"), temperature)
    return rows.withColumn("target", target).select(
        "*",
        V.argmax(F.col("target")).alias("pseudo_label"),
        F.array_max("target").alias("confidence"),
        (F.array_max("target") >= F.lit(threshold)).alias("kept"),
    )


def mask_rates(rows: DataFrame, step: int, steps: int, classes: int) -> DataFrame:
    """Shares kept on the unlabelled and the labelled side at a training step.

    A labelled row counts while its true-class probability is not above the
    annealed threshold.
    """
    limit = V.confidence_threshold(step, steps, classes)
    true_p = F.element_at(V.softmax(F.col("logits")), F.col("label") + 1)
    return pseudo_labels(rows).agg(
        F.avg(F.col("kept").cast("double")).alias("unlabelled_rate"),
        F.avg((true_p <= F.lit(limit)).cast("double")).alias("labelled_rate"),
    )


def confidence_based_loss(rows: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Masked loss of strong-view logits against confident weak-view classes."""
    weak = V.softmax(F.col("weak"))
    ready = rows.select(
        F.col("strong").alias("logits"),
        V.argmax(weak).alias("label"),
        F.array_max(weak).alias("best"),
    )
    return masked_cross_entropy(ready, F.col("best") > F.lit(threshold))


def consistency_losses(
    rows: DataFrame,
    by: list[str],
    temperature: float = V.SHARPEN_TEMPERATURE,
    threshold: float = UDA_THRESHOLD,
    activation: str = "softmax",
    ratio: int = 1,
) -> DataFrame:
    """Labelled and unlabelled terms per group.

    ``rows`` holds ``logits`` and class ``label`` of a labelled row next to
    ``u_ori`` and ``u_aug`` logits of unlabelled ones. The first pair of
    columns divides by the number of rows (times ``ratio`` on the unlabelled
    side); ``unlabelled_mean`` also divides by the number of classes.
    """
    if activation == "softmax":
        labelled = -F.element_at(V.log_softmax(F.col("logits")), F.col("label") + 1)
        target = V.sharpen(F.col("u_ori"), temperature)
        guess = V.log_softmax(F.col("u_aug"))
    else:
        logistic = lambda x: F.lit(1.0) / (1 + F.exp(-x))
        labelled = _sigmoid_terms()
        target = F.transform(F.col("u_ori"), lambda x: logistic(x / F.lit(temperature)))
        guess = F.transform(F.col("u_aug"), logistic)
    kept = F.array_max(target) >= F.lit(threshold)
    term = F.when(kept, -V.inner_product(target, guess)).otherwise(F.lit(0.0))
    parts = rows.select(
        *by,
        labelled.alias("l"),
        term.alias("u"),
        kept.cast("double").alias("kept"),
        F.size("u_ori").alias("classes"),
    )
    return parts.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.sum("l") / F.count("*")).alias("labelled"),
        (F.sum("u") / F.count("*") / F.lit(ratio)).alias("unlabelled"),
        F.avg(F.col("u") / F.col("classes")).alias("unlabelled_mean"),
        F.avg("kept").alias("kept_rate"),
    )
