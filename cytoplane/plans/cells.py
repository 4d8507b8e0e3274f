"""Queries: filters, normalisation, gene selection, annotation, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.functions import strings as T
from cytoplane.functions import vectors as V
from cytoplane.operators import annotation as A
from cytoplane.operators import batching as B
from cytoplane.operators import hvg as H
from cytoplane.operators import preprocess as P
from cytoplane.plans import fixtures as fx
from cytoplane.plans.fixtures import r6
from cytoplane.plans.registry import block, query
from cytoplane.session import cut

# ------------------------------------------------------------------- filters


@query("filter_cells_min_genes", "kept", "SELECT cell_id, gene_id, value FROM kept")
def filter_cells_min_genes(spark, d):
    return P.filter_cells(fx.expr(spark, d), fx.MIN_GENES).select("cell_id", "gene_id", "value")


@query(
    "filter_genes_min_cells",
    "expr",
    """SELECT e.cell_id, e.gene_id, e.value FROM expr e JOIN (SELECT gene_id FROM expr WHERE value > 0
  GROUP BY gene_id HAVING count(*) >= 25) k USING (gene_id)""",
)
def filter_genes_min_cells(spark, d):
    return P.filter_genes(fx.expr(spark, d), 25).select("cell_id", "gene_id", "value")


@query(
    "drop_gene_prefixes",
    "var_genes",
    """SELECT gene_id, gene_name FROM var_genes
WHERE NOT (starts_with(gene_name, 'red') OR starts_with(gene_name, 'cold'))""",
)
def drop_gene_prefixes(spark, d):
    kept = P.drop_gene_prefixes(fx.var_genes(spark, d), ["red", "cold"])
    return kept.select("gene_id", "gene_name")


@query(
    "filter_obs",
    "obs",
    """SELECT cell_id, batch, sample, score FROM
  (SELECT cell_id, batch, sample, CASE WHEN score >= 0 THEN grp END AS grp, score FROM obs)
WHERE batch <> 'MACHINERY' AND (grp IN ('ASIA', 'EUROPE') OR grp IS NULL) AND sample NOT IN ('NATION_1', 'NATION_2')""",
)
def filter_obs(spark, d):
    """Inequality, null-aware membership and negated membership together."""
    rows = fx.obs(spark, d).withColumn("grp", F.when(F.col("score") >= 0, F.col("grp")))
    return P.filter_obs(
        rows,
        differs={"batch": "MACHINERY"},
        among={"grp": ["ASIA", "EUROPE", None]},
        outside={"sample": ["NATION_1", "NATION_2"]},
    ).select("cell_id", "batch", "sample", "score")


@query(
    "select_genes",
    "expr markers",
    "SELECT cell_id, gene_id, value FROM expr WHERE gene_id IN (SELECT gene_id FROM markers)",
)
def select_genes(spark, d):
    return P.select_genes(fx.expr(spark, d), fx.markers(spark, d))


@query("default_batch", "obs", "SELECT cell_id, '0' AS batch FROM obs")
def default_batch(spark, d):
    return P.default_batch(fx.obs(spark, d)).select("cell_id", "batch")


# ------------------------------------------------------------ normalisation


@query(
    "normalize_total",
    "expr",
    """SELECT cell_id, gene_id, round(value * 10000.0 / t, 6) AS value
FROM expr JOIN (SELECT cell_id, sum(value) AS t FROM expr GROUP BY cell_id) USING (cell_id)""",
)
def normalize_total(spark, d):
    return P.normalize_total(fx.expr(spark, d)).withColumn("value", r6("value"))


@query("log1p_expr", "norm", "SELECT cell_id, gene_id, round(value, 6) AS value, round(exp(value) - 1, 4) AS back FROM norm")
def log1p_expr(spark, d):
    back = F.round(F.expm1("value"), 4).alias("back")
    return fx.norm(spark, d).select("cell_id", "gene_id", r6("value").alias("value"), back)


# ----------------------------------------------------------- gene selection

block(
    "moments",
    "norm",
    """SELECT g.gene_id, coalesce(s, 0) / n AS mean,
         (coalesce(q, 0) - n * (coalesce(s, 0) / n) * (coalesce(s, 0) / n)) / (n - 1) AS variance
  FROM (SELECT p_partkey AS gene_id FROM part) g
  LEFT JOIN (SELECT gene_id, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS q FROM norm GROUP BY gene_id) USING (gene_id),
  (SELECT count(DISTINCT cell_id) AS n FROM norm)""",
)
block(
    "batch_moments",
    "norm obs",
    """SELECT batch, gene_id, s / n AS mean, (q - n * (s / n) * (s / n)) / (n - 1) AS variance
  FROM (SELECT o.batch, gene_id, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS q
        FROM norm JOIN obs o USING (cell_id) GROUP BY ALL)
  JOIN (SELECT o.batch, count(DISTINCT cell_id) AS n FROM norm JOIN obs o USING (cell_id) GROUP BY ALL) USING (batch)""",
)


def _scored_sql(moments: str, batch: str) -> str:
    """Steps 2 to 4 of the selection on a moments block, per ``batch`` expression."""
    return f"""SELECT batch, gene_id, mean, variance, log_mean, bin, dispersion,
    CASE WHEN dispersion IS NULL THEN NULL WHEN count(dispersion) OVER w = 1 THEN 1.0
         ELSE (dispersion - avg(dispersion) OVER w) / nullif(stddev_samp(dispersion) OVER w, 0) END AS score
  FROM (SELECT *, CAST(greatest(1, ceil(20 * coalesce((log_mean - min(log_mean) OVER b) /
            nullif(max(log_mean) OVER b - min(log_mean) OVER b, 0), 0))) AS INTEGER) AS bin
    FROM (SELECT {batch} AS batch, gene_id, mean, variance,
            ln(1 + CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) AS log_mean,
            CASE WHEN variance > 0 THEN ln(variance / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) END AS dispersion
          FROM {moments}) WINDOW b AS (PARTITION BY batch))
  WINDOW w AS (PARTITION BY batch, bin)"""


block("scored", "moments", _scored_sql("moments", "0"))
block("batch_scored", "batch_moments", _scored_sql("batch_moments", "batch"))


def _moments(spark, d):
    """Sums over the scan itself: only a row per cell is written, never the normalised table."""
    cells = cut(P.cell_totals(fx.expr(spark, d), fx.MIN_GENES))
    return H.gene_moments(P.scale_and_log(fx.expr(spark, d), cells), cells.select("cell_id"), fx.var_genes(spark, d))


def _batch_moments(spark, d):
    totals = P.cell_totals(fx.expr(spark, d), fx.MIN_GENES)
    cells = cut(totals.join(fx.obs(spark, d).select("cell_id", "batch"), "cell_id"))
    return H.gene_moments(P.scale_and_log(fx.expr(spark, d), cells), cells.select("cell_id", "batch"))


@query("gene_moments", "moments", "SELECT gene_id, round(mean, 6) AS mean, round(variance, 4) AS variance FROM moments")
def gene_moments(spark, d):
    return _moments(spark, d).select("gene_id", r6("mean").alias("mean"), F.round("variance", 4).alias("variance"))


@query(
    "hvg_select",
    "scored",
    f"""SELECT gene_id, bin, round(log_mean, 6) AS log_mean, round(score, 6) AS score FROM scored
WHERE score >= (SELECT min(score) FROM (SELECT score FROM scored WHERE score IS NOT NULL ORDER BY score DESC LIMIT {fx.N_TOP}))""",
)
def hvg_select(spark, d):
    kept = H.select_hvg(_moments(spark, d), n_top=fx.N_TOP)
    return kept.select("gene_id", "bin", r6("log_mean").alias("log_mean"), r6("score").alias("score"))


block(
    "batch_floors",
    "batch_scored",
    f"""SELECT batch, min(score) AS floor FROM (SELECT batch, score, row_number() OVER (PARTITION BY batch ORDER BY score DESC) AS r
    FROM batch_scored WHERE score IS NOT NULL) WHERE r <= {fx.N_TOP} GROUP BY batch""",
)
# every gene in every batch: zero where the batch does not show it, null where it shows it without a score
block(
    "batch_grid",
    "batch_scored batch_floors",
    """SELECT g.gene_id, b.batch, CASE WHEN s.gene_id IS NULL THEN 0 ELSE s.score END AS score, coalesce(s.score >= f.floor, false) AS hit
  FROM (SELECT DISTINCT gene_id FROM batch_scored) g CROSS JOIN (SELECT DISTINCT batch FROM batch_scored) b
  LEFT JOIN batch_scored s ON s.gene_id = g.gene_id AND s.batch = b.batch LEFT JOIN batch_floors f ON f.batch = b.batch""",
)


@query(
    "hvg_select_batched",
    "batch_grid",
    f"""SELECT gene_id, count(*) FILTER (hit) AS n_batches, round(avg(score), 6) AS score FROM batch_grid
GROUP BY gene_id ORDER BY count(*) FILTER (hit) DESC, round(avg(score), 10) DESC NULLS LAST, gene_id LIMIT {fx.N_TOP}""",
)
def hvg_select_batched(spark, d):
    genes = H.select_hvg_batched(_batch_moments(spark, d), fx.N_TOP)
    return genes.select("gene_id", "n_batches", r6("score").alias("score"))


def _half_moments_sql(name: str, where: str) -> None:
    block(
        f"{name}_norm",
        "norm obs",
        f"SELECT n.* FROM norm n JOIN obs o USING (cell_id) WHERE {where}",
    )
    block(
        f"{name}_moments",
        f"{name}_norm",
        f"""SELECT g.gene_id, coalesce(s, 0) / n AS mean,
         (coalesce(q, 0) - n * (coalesce(s, 0) / n) * (coalesce(s, 0) / n)) / (n - 1) AS variance
  FROM (SELECT p_partkey AS gene_id FROM part) g
  LEFT JOIN (SELECT gene_id, sum(exp(value) - 1) AS s, sum((exp(value) - 1) * (exp(value) - 1)) AS q FROM {name}_norm GROUP BY gene_id) USING (gene_id),
  (SELECT count(DISTINCT cell_id) AS n FROM {name}_norm)""",
    )
    block(f"{name}_scored", f"{name}_moments", _scored_sql(f"{name}_moments", "0"))


_half_moments_sql("ref_half", f"o.batch <> '{fx.HELD_OUT}'")
_half_moments_sql("query_half", f"o.batch = '{fx.HELD_OUT}'")
LOW_SCORE = 0.5


@query(
    "hvg_intersect",
    "ref_half_scored query_half_scored",
    f"""SELECT a.gene_id, round(a.score, 6) AS ref_score, round(b.score, 6) AS query_score
FROM ref_half_scored a JOIN query_half_scored b USING (gene_id)
WHERE a.score > {LOW_SCORE} AND b.score > {LOW_SCORE}
  AND a.log_mean > 0.0125 AND a.log_mean < 6 AND b.log_mean > 0.0125 AND b.log_mean < 6""",
)
def hvg_intersect(spark, d):
    """Cut-off selection on reference cells and on query cells, kept where both agree."""
    rows, genes = fx.norm(spark, d), fx.var_genes(spark, d)
    held = fx.obs(spark, d).select("cell_id", (F.col("batch") == fx.HELD_OUT).alias("held"))
    tagged = cut(rows.join(held, "cell_id"))

    def side(part):
        mine = part.drop("held")
        moments = H.gene_moments(mine, mine.select("cell_id").distinct(), genes)
        return H.select_hvg(moments, max_mean=6.0, min_score=LOW_SCORE)

    a = side(tagged.where("not held")).select("gene_id", r6("score").alias("ref_score"))
    b = side(tagged.where("held")).select("gene_id", r6("score").alias("query_score"))
    shared = H.shared_hvg(a, b)
    return a.join(shared, "gene_id", "left_semi").join(b, "gene_id")


@query(
    "gene_overlap",
    "ref_genes query_expr",
    """SELECT count(*) FILTER (q.gene_id IS NULL) AS only_left, count(*) FILTER (r.gene_id IS NOT NULL AND q.gene_id IS NOT NULL) AS shared,
  count(*) FILTER (r.gene_id IS NULL) AS only_right
FROM ref_genes r FULL JOIN (SELECT DISTINCT gene_id FROM query_expr) q ON r.gene_id = q.gene_id""",
)
def gene_overlap(spark, d):
    return P.overlap_counts(fx.ref_genes(spark, d), fx.query_expr(spark, d))


@query(
    "gene_overlap_list",
    "ref_genes query_expr",
    """SELECT gene_id FROM ref_genes INTERSECT SELECT gene_id FROM query_expr""",
)
def gene_overlap_list(spark, d):
    both = P.gene_overlap(fx.ref_genes(spark, d), fx.query_expr(spark, d))
    return both.where("in_left AND in_right").select("gene_id")


block(
    "ref_expr",
    "expr ref_genes",
    "SELECT cell_id, gene_id, value FROM expr WHERE gene_id IN (SELECT gene_id FROM ref_genes)",
)


@query(
    "concat_cells",
    "ref_expr query_expr",
    """SELECT 'reference' AS source, cell_id, gene_id, value FROM ref_expr WHERE gene_id IN (SELECT gene_id FROM query_expr)
UNION ALL SELECT 'query', cell_id, gene_id, value FROM query_expr WHERE gene_id IN (SELECT gene_id FROM ref_expr)""",
)
def concat_cells(spark, d):
    ref = P.select_genes(fx.expr(spark, d), fx.ref_genes(spark, d))
    return P.concat_cells(ref, fx.query_expr(spark, d), ("reference", "query")).select(
        "source", "cell_id", "gene_id", "value"
    )


@query(
    "concat_features",
    "expr var_genes expr_protein",
    """SELECT cell_id, gene_name || '#' || gene_id || '_RNA' AS feature, value FROM expr JOIN var_genes USING (gene_id)
UNION ALL SELECT cell_id, gene_id || '_Protein', value FROM expr_protein""",
)
def concat_features(spark, d):
    names = fx.var_genes(spark, d).select("gene_id", F.concat_ws("#", "gene_name", "gene_id").alias("feature"))
    rna = fx.expr(spark, d).join(names, "gene_id").select("cell_id", "feature", "value")
    protein = fx.expr_protein(spark, d).select("cell_id", F.col("gene_id").cast("string").alias("feature"), "value")
    return A.stack_features(
        A.suffix_features(rna, "_RNA", "feature"), A.suffix_features(protein, "_Protein", "feature")
    )


# -------------------------------------------------------------- annotation

COARSE = {f"NATION_{i}": f"ZONE_{i // 4}" for i in range(20)}


@query(
    "recode_labels",
    "obs",
    """SELECT cell_id, sample, CASE WHEN CAST(substr(sample, 8) AS INTEGER) < 20
  THEN 'ZONE_' || (CAST(substr(sample, 8) AS INTEGER) // 4) END AS coarse FROM obs""",
)
def recode_labels(spark, d):
    """Dictionary lookup; nations without an entry become null."""
    return fx.obs(spark, d).select("cell_id", "sample", A.recode(F.col("sample"), COARSE).alias("coarse"))


@query(
    "recode_labels_by_table",
    "obs",
    """SELECT o.cell_id, o.sample, r.r_name AS coarse FROM obs o LEFT JOIN nation n ON n.n_name = o.sample
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def recode_labels_by_table(spark, d):
    nation, region = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    lookup = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("fine"), F.col("r_name").alias("coarse")
    )
    return A.recode_by_table(fx.obs(spark, d).select("cell_id", "sample"), "sample", lookup, "coarse")


@query(
    "conditional_relabel",
    "obs",
    """SELECT cell_id, CASE WHEN score > 7000 THEN 'exhausted' WHEN batch = 'BUILDING' AND score > 2000 THEN 'proliferating'
  ELSE grp END AS label FROM obs""",
)
def conditional_relabel(spark, d):
    rules = [
        ((F.col("batch") == "BUILDING") & (F.col("score") > 2000), "proliferating"),
        (F.col("score") > 7000, "exhausted"),
    ]
    return fx.obs(spark, d).select("cell_id", A.override(F.col("grp"), rules).alias("label"))


@query(
    "derive_group_from_id",
    "",
    "SELECT c_custkey AS cell_id, CASE WHEN length(c_name) > 5 THEN substr(c_name, 3, length(c_name) - 5) ELSE '' END AS derived FROM customer",
)
def derive_group_from_id(spark, d):
    rows = fx.table(spark, d, "customer")
    return rows.select(F.col("c_custkey").alias("cell_id"), T.inner_substring(F.col("c_name"), 2, 3).alias("derived"))


@query(
    "tag_source",
    "obs",
    """SELECT cell_id, coalesce(CASE WHEN score >= 0 THEN sample END, 'cohort_a') AS sample, 'cohort_a' AS source FROM obs WHERE batch <> 'HOUSEHOLD'
UNION ALL SELECT cell_id, coalesce(CASE WHEN score >= 0 THEN sample END, 'cohort_b'), 'cohort_b' FROM obs WHERE batch = 'HOUSEHOLD'""",
)
def tag_source(spark, d):
    rows = fx.obs(spark, d).select("cell_id", "batch", F.when(F.col("score") >= 0, F.col("sample")).alias("sample"))
    a = A.tag_and_fill(rows.where(F.col("batch") != fx.HELD_OUT).drop("batch"), "cohort_a")
    b = A.tag_and_fill(rows.where(F.col("batch") == fx.HELD_OUT).drop("batch"), "cohort_b")
    return a.unionByName(b)


@query(
    "suffix_feature_names",
    "var_genes",
    "SELECT gene_id, gene_name || '_RNA' AS gene_name FROM var_genes",
)
def suffix_feature_names(spark, d):
    return A.suffix_features(fx.var_genes(spark, d).select("gene_id", "gene_name"), "_RNA")


@query("negate_feature", "expr_protein", "SELECT cell_id, gene_id, -value AS value FROM expr_protein")
def negate_feature(spark, d):
    return A.negate(fx.expr_protein(spark, d), "value").select("cell_id", "gene_id", "value")


@query(
    "confident_subset",
    "probs",
    """SELECT vec_id, round(list_max(p), 6) AS best, 'at_least' AS rule FROM probs WHERE list_max(p) >= 0.4
UNION ALL SELECT vec_id, round(list_max(p), 6), 'above' FROM probs WHERE list_max(p) > 0.5""",
)
def confident_subset(spark, d):
    rows = fx.logits(spark, d).select("vec_id", V.softmax(F.col("logits")).alias("p"))
    pick = lambda df, rule: df.select("vec_id", r6(F.array_max("p")).alias("best"), F.lit(rule).alias("rule"))
    return pick(A.confident(rows, F.col("p"), 0.4), "at_least").unionByName(
        pick(A.confident(rows, F.col("p"), 0.5, strict=True), "above")
    )


@query(
    "any_pattern_match",
    "",
    """SELECT doc_id, regexp_matches(text, '[0-9]{3}-[0-9]{2}') OR regexp_matches(text, '(?i)copyright|licen[cs]e')
  OR regexp_matches(text, '@[a-z]+') AS hit FROM documents""",
)
def any_pattern_match(spark, d):
    patterns = ["[0-9]{3}-[0-9]{2}", "(?i)copyright|licen[cs]e", "@[a-z]+"]
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", T.any_pattern_match(F.col("text"), patterns).alias("hit"))


# -------------------------------------------------------------------- joins


@query(
    "annotate_by_id",
    "obs expr",
    """SELECT o.cell_id, o.sample, o.grp, x.n_genes FROM obs o
JOIN (SELECT cell_id, count(*) AS n_genes FROM expr GROUP BY cell_id) x USING (cell_id)""",
)
def annotate_by_id(spark, d):
    facts = fx.expr(spark, d).groupBy("cell_id").agg(F.count("*").alias("n_genes"))
    return A.attach_by_id(fx.obs(spark, d).select("cell_id", "sample", "grp"), facts)


@query(
    "held_out_membership",
    "obs expr expr_protein",
    """SELECT cell_id, 'rna' AS source FROM obs WHERE cell_id IN (SELECT cell_id FROM expr)
UNION ALL SELECT cell_id, 'protein' FROM obs WHERE cell_id IN (SELECT cell_id FROM expr_protein)""",
)
def held_out_membership(spark, d):
    cells = fx.obs(spark, d).select("cell_id")
    rna = A.members(cells, fx.expr(spark, d)).withColumn("source", F.lit("rna"))
    protein = A.members(cells, fx.expr_protein(spark, d)).withColumn("source", F.lit("protein"))
    return rna.unionByName(protein)


# ------------------------------------------------------------ mini-batches

SIZE = 16
MINIBATCH = f"""SELECT cell_id, batch, pos // {SIZE} AS minibatch_id, pos % {SIZE} AS place FROM (
  SELECT cell_id, batch, row_number() OVER (PARTITION BY batch ORDER BY {{order}}) - 1 AS pos, count(*) OVER (PARTITION BY batch) AS n FROM obs)
WHERE pos < n // {SIZE} * {SIZE}"""


@query("assign_minibatches", "obs", MINIBATCH.format(order="cell_id"))
def assign_minibatches(spark, d):
    rows = fx.obs(spark, d).select("cell_id", "batch")
    return B.assign_minibatches(rows, SIZE).select("cell_id", "batch", "minibatch_id", "place")


@query(
    "assign_minibatches_shuffled",
    "obs",
    MINIBATCH.format(order="md5(cell_id || ':42'), cell_id"),
)
def assign_minibatches_shuffled(spark, d):
    rows = fx.obs(spark, d).select("cell_id", "batch")
    return B.assign_minibatches(rows, SIZE, seed=42).select("cell_id", "batch", "minibatch_id", "place")


@query(
    "limit_full_batches",
    "obs",
    f"""SELECT cell_id, 'all' AS scope FROM (SELECT cell_id, row_number() OVER (ORDER BY cell_id) AS r, count(*) OVER () AS n FROM obs) WHERE r <= n // {SIZE} * {SIZE}
UNION ALL SELECT cell_id, 'per batch' FROM (SELECT cell_id, row_number() OVER (PARTITION BY batch ORDER BY cell_id) AS r, count(*) OVER (PARTITION BY batch) AS n FROM obs)
WHERE r <= n // {SIZE} * {SIZE}""",
)
def limit_full_batches(spark, d):
    rows = fx.obs(spark, d).select("cell_id", "batch")
    whole = B.limit_full_batches(rows, SIZE).select("cell_id", F.lit("all").alias("scope"))
    per = B.limit_full_batches(rows, SIZE, by=["batch"]).select("cell_id", F.lit("per batch").alias("scope"))
    return whole.unionByName(per)


@query(
    "zip_labelled_unlabelled",
    "obs",
    f"""SELECT a.cell_id, b.cell_id AS unlabelled_id, a.pos // {SIZE} AS minibatch_id FROM
  (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS pos, count(*) OVER () AS n FROM obs WHERE batch <> '{fx.HELD_OUT}') a JOIN
  (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS pos, count(*) OVER () AS n FROM obs WHERE batch = '{fx.HELD_OUT}') b ON a.pos = b.pos
WHERE a.pos < a.n // {SIZE} * {SIZE} AND b.pos < b.n // {SIZE} * {SIZE}""",
)
def zip_labelled_unlabelled(spark, d):
    cells = fx.obs(spark, d).select("cell_id", "batch")
    left = B.assign_minibatches(cells.where(F.col("batch") != fx.HELD_OUT).drop("batch"), SIZE, by=())
    right = B.assign_minibatches(cells.where(F.col("batch") == fx.HELD_OUT).drop("batch"), SIZE, by=())
    zipped = B.zip_minibatches(left, right.withColumnRenamed("cell_id", "unlabelled_id"))
    return zipped.select("cell_id", "unlabelled_id", "minibatch_id")


@query(
    "sample_n",
    "obs",
    "SELECT cell_id, batch FROM obs ORDER BY md5(cell_id || ':7'), cell_id LIMIT 100",
)
def sample_n(spark, d):
    return B.sample_n(fx.obs(spark, d).select("cell_id", "batch"), 100, ["cell_id"], seed=7)


@query(
    "shuffle_rows",
    "obs",
    "SELECT cell_id, row_number() OVER (ORDER BY md5(cell_id || ':11'), cell_id) - 1 AS position FROM obs",
)
def shuffle_rows(spark, d):
    return B.shuffle_rows(fx.obs(spark, d).select("cell_id"), ["cell_id"], seed=11)


@query(
    "last_row_flag",
    "",
    "SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations",
)
def last_row_flag(spark, d):
    turns = fx.table(spark, d, "conversations").select("conv_id", "turn")
    return B.flag_last(turns, ["conv_id"], "turn")


@query(
    "running_mean",
    "",
    """SELECT event_type AS file, event_id AS step, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-10, 6) AS mean_loss FROM events""",
)
def running_mean(spark, d):
    log = fx.table(spark, d, "events").select(
        F.col("event_type").alias("file"), F.col("event_id").alias("step"), "value"
    )
    run = B.running_mean(log, ["file"], ["step"], "value", "mean_loss")
    # Means of cents over 2^n steps end in an exact half: nudge it off the edge.
    return run.select("file", "step", r6(F.col("mean_loss") + 1e-10).alias("mean_loss"))


@query(
    "label_change_rate",
    "emb",
    """SELECT iteration, round(avg(CASE WHEN was IS NULL THEN NULL WHEN label <> was THEN 1.0 ELSE 0.0 END), 6) AS change_rate,
  coalesce(avg(CASE WHEN was IS NULL THEN NULL WHEN label <> was THEN 1.0 ELSE 0.0 END) < 0.905, false) AS stop
FROM (SELECT id, iteration, label, lag(label) OVER (PARTITION BY id ORDER BY iteration) AS was FROM (
  SELECT vec_id AS id, CAST(i AS INTEGER) AS iteration, list_position(vec[10*i+1:10*i+10], list_max(vec[10*i+1:10*i+10])) AS label FROM emb, range(6) r(i)))
GROUP BY iteration""",
)
def label_change_rate(spark, d):
    """Argmax over successive ten-element slices stands in for iterations."""
    slices = F.array(*[V.argmax(F.slice("vec", 10 * i + 1, 10)) for i in range(6)])
    rows = fx.emb(spark, d).select(F.col("vec_id").alias("id"), F.posexplode(slices).alias("iteration", "label"))
    return B.label_change_rate(rows, 0.905).withColumn("change_rate", r6("change_rate"))


@query(
    "best_checkpoint",
    "",
    """SELECT epoch, round(loss, 6) AS loss, round(score, 6) AS score,
  coalesce(loss < min(loss) OVER w, true) AS best_loss, coalesce(score > max(score) OVER w, true) AS best_score
FROM (SELECT CAST(ts AS DATE) AS epoch, round(avg(value), 9) AS loss, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 9) AS score FROM events GROUP BY 1)
WINDOW w AS (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def best_checkpoint(spark, d):
    log = fx.table(spark, d, "events").select(
        F.to_date("ts").alias("epoch"), "value", (F.col("value") > 10).cast("double").alias("hit")
    )
    flagged = B.best_so_far(log, "epoch", "value", "hit")
    return flagged.withColumn("loss", r6("loss")).withColumn("score", r6("score"))
