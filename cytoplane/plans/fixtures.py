"""Stand-in tables: the driver's tables read as expression, annotation and vectors.

Cells are customers, genes are parts (or, for the second modality, brands),
values are ordered quantities. Every function takes the session and the
folder of the tables and is lazy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.functions import vectors as V
from cytoplane.operators import preprocess as P
from cytoplane.operators.encode import AttentionWeights, HeadWeights
from cytoplane.operators.ordering import with_position
from cytoplane.plans.registry import block
from cytoplane.session import ship

MIN_GENES = 30
N_TOP = 500
HELD_OUT = "HOUSEHOLD"
MISSING_IN_REF, MISSING_IN_QUERY = "Brand#3", "Brand#7"
WIDTH = 8


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# ------------------------------------------------------------- expression

block(
    "expr",
    "",
    """SELECT o.o_custkey AS cell_id, l.l_partkey AS gene_id, SUM(l.l_quantity) AS value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, l.l_partkey""",
)
block(
    "expr_protein",
    "",
    """SELECT o.o_custkey AS cell_id, CAST(substr(p.p_brand, 7) AS BIGINT) AS gene_id, SUM(l.l_quantity) AS value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE c.c_acctbal >= 0
  GROUP BY 1, 2""",
)
block(
    "obs",
    "",
    """SELECT c.c_custkey AS cell_id, c.c_custkey AS cell_ix, c.c_mktsegment AS batch, c.c_acctbal AS score,
         n.n_name AS sample, r.r_name AS grp
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
)
block(
    "var_genes",
    "",
    "SELECT p_partkey AS gene_id, p_partkey AS gene_ix, p_name AS gene_name, p_brand AS brand FROM part",
)
block("markers", "", "SELECT p_type AS set_name, p_partkey AS gene_id FROM part WHERE p_size <= 2")
block(
    "ref_genes",
    "",
    f"""SELECT p_partkey AS gene_id, row_number() OVER (ORDER BY p_partkey) - 1 AS gene_ix
  FROM part WHERE p_brand <> '{MISSING_IN_REF}'""",
)
block(
    "query_expr",
    "expr",
    f"""SELECT e.cell_id, e.gene_id, e.value FROM expr e JOIN part p ON e.gene_id = p.p_partkey
  WHERE p.p_brand <> '{MISSING_IN_QUERY}'""",
)
block(
    "kept",
    "expr",
    f"""SELECT e.* FROM expr e JOIN (SELECT cell_id FROM expr WHERE value > 0
    GROUP BY cell_id HAVING count(*) >= {MIN_GENES}) k USING (cell_id)""",
)
block(
    "norm",
    "kept",
    """SELECT cell_id, gene_id, ln(1 + value * 10000.0 / t) AS value
  FROM kept JOIN (SELECT cell_id, SUM(value) AS t FROM kept GROUP BY cell_id) USING (cell_id)""",
)


def expr(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def expr_protein(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    brands = table(spark, d, "part").select(
        "p_partkey", F.expr("cast(substring(p_brand, 7) as bigint)").alias("gene_id")
    )
    cells = table(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(cells, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("cell_id"), "gene_id")
        .agg(F.sum("l_quantity").alias("value"))
    )


def obs(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").alias("cell_id"),
            F.col("c_custkey").alias("cell_ix"),
            F.col("c_mktsegment").alias("batch"),
            F.col("c_acctbal").alias("score"),
            F.col("n_name").alias("sample"),
            F.col("r_name").alias("grp"),
        )
    )


def var_genes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("gene_id"),
        F.col("p_partkey").alias("gene_ix"),
        F.col("p_name").alias("gene_name"),
        F.col("p_brand").alias("brand"),
    )


def markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size <= 2").select(
        F.col("p_type").alias("set_name"), F.col("p_partkey").alias("gene_id")
    )


def ref_genes(spark: SparkSession, d: str) -> DataFrame:
    kept = var_genes(spark, d).where(F.col("brand") != MISSING_IN_REF).select("gene_id")
    return with_position(kept, ["gene_id"], "gene_ix")


def query_expr(spark: SparkSession, d: str) -> DataFrame:
    genes = var_genes(spark, d).where(F.col("brand") != MISSING_IN_QUERY)
    return P.select_genes(expr(spark, d), genes)


def norm(spark: SparkSession, d: str) -> DataFrame:
    return P.preprocess(expr(spark, d), MIN_GENES)


# -------------------------------------------------------------- embeddings

block(
    "emb",
    "",
    """SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label,
         CASE WHEN label < 5 THEN 0 ELSE 1 END AS l1,
         CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'ref' END AS part_role
  FROM embeddings""",
)
block(
    "sims",
    "emb",
    """SELECT q.vec_id AS query_id, r.vec_id AS ref_id, r.label AS label, r.l1 AS l1,
         round(list_dot_product(q.vec, r.vec), 10) AS sim
  FROM emb q, emb r WHERE q.part_role = 'query' AND r.part_role = 'ref'""",
)
block(
    "near",
    "sims",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank
    FROM sims) WHERE rank <= 5""",
)
block(
    "voted",
    "near",
    """SELECT query_id, label, w / n AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, first_rank) AS place FROM (
      SELECT query_id, label, round(sum(sim), 10) AS w, count(*) AS n, min(rank) AS first_rank
      FROM near GROUP BY query_id, label)) WHERE place = 1""",
)
block(
    "preds",
    "emb",
    """SELECT vec_id, label AS truth,
         list_position(vec[1:10], list_max(vec[1:10])) - 1 AS pred FROM emb""",
)
block(
    "logits",
    "emb",
    """SELECT vec_id, label, list_transform(vec[1:10], lambda x: x * 10) AS logits,
         list_transform(vec[11:20], lambda x: x * 10) AS aug, vec_id // 20 AS minibatch_id FROM emb""",
)
block(
    "probs",
    "logits",
    """SELECT vec_id, label, logits, aug, minibatch_id,
         list_transform(e, lambda x: x / list_sum(e)) AS p,
         list_transform(f, lambda x: x / list_sum(f)) AS q,
         list_transform(logits, lambda x: x - list_max(logits) - ln(list_sum(e))) AS logp,
         list_transform(aug, lambda x: x - list_max(aug) - ln(list_sum(f))) AS logq,
         list_transform(s, lambda x: x / list_sum(s)) AS sharp
  FROM (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e,
               list_transform(aug, lambda x: exp(x - list_max(aug))) AS f,
               list_transform(logits, lambda x: exp((x - list_max(logits)) / 0.5)) AS s FROM logits)""",
)
block(
    "pairs",
    "emb",
    """SELECT a.vec_id, a.vec AS a, b.vec AS b, a.vec_id // 20 AS minibatch_id
  FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1""",
)


def emb(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors; one fifth act as queries, all the others as references."""
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("vec"),
        "label",
        F.when(F.col("label") < 5, 0).otherwise(1).alias("l1"),
        F.when(F.col("vec_id") % 5 == 0, "query").otherwise("ref").alias("part_role"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select(F.col("vec_id").alias("id"), "vec", "label")


def ref_and_query(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = emb(spark, d).withColumnRenamed("vec_id", "id")
    return (
        rows.where("part_role = 'query'").select("id", "vec"),
        rows.where("part_role = 'ref'").select("id", "vec", "label", "l1"),
    )


def preds(spark: SparkSession, d: str) -> DataFrame:
    guess = V.argmax(F.slice("vec", 1, 10))
    return emb(spark, d).select("vec_id", F.col("label").alias("truth"), guess.alias("pred"))


def logits(spark: SparkSession, d: str) -> DataFrame:
    ten = lambda start: F.transform(F.slice("vec", start, 10), lambda x: x * 10)
    return emb(spark, d).select(
        "vec_id",
        "label",
        ten(1).alias("logits"),
        ten(11).alias("aug"),
        F.expr("vec_id div 20").alias("minibatch_id"),
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = emb(spark, d)
    a = rows.select("vec_id", F.col("vec").alias("a"), (F.col("vec_id") + 1).alias("next"))
    b = rows.select(F.col("vec_id").alias("next"), F.col("vec").alias("b"))
    return a.join(b, "next").select("vec_id", "a", "b", F.expr("vec_id div 20").alias("minibatch_id"))


# ---------------------------------------------------------- encoder weights


def gene_vectors(genes: DataFrame, phase: float = 0.0) -> DataFrame:
    """Vector element j of a gene: sin(gene_ix * 0.1 + j + phase)."""
    places = F.sequence(F.lit(0), F.lit(WIDTH - 1))
    return genes.select(
        "gene_ix",
        F.transform(places, lambda j: F.sin(F.col("gene_ix") * 0.1 + j + phase)).alias("vec"),
    )


def attention_weights(phase: float) -> AttentionWeights:
    i = np.arange(WIDTH)
    return AttentionWeights(
        value_scale=0.2,
        value_shift=0.1,
        w=np.round(np.cos(i[:, None] + 2 * i[None, :] + phase) / 3, 4),
        b=np.round(0.05 * i - 0.1, 4),
        u=np.round(np.sin(i + 1 + phase), 4),
        out_scale=np.round(0.8 + 0.05 * i, 4),
        out_shift=np.round(0.02 * i - 0.05, 4),
    )


def head_weights() -> HeadWeights:
    i = np.arange(WIDTH)
    return HeadWeights(
        d=np.round(np.sin(3 * i[:, None] + i[None, :]) / 2, 4), c=np.round(0.1 - 0.01 * i, 4)
    )


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def _columns(matrix: np.ndarray) -> str:
    return "[" + ", ".join(_list(matrix[:, j]) for j in range(matrix.shape[1])) + "]"


def pooled_sql(source: str, phase: float) -> tuple[str, str, str]:
    """SQL for scored entries, attention shares and pooled vectors of one modality.

    ``source`` yields ``cell_id, gene_ix, value``.
    """
    w = attention_weights(phase)
    scored = f"""SELECT cell_id, gene_ix, h, exp(list_dot_product(
      list_transform(list_zip({_columns(w.w)}, {_list(w.b)}), lambda c: tanh(list_dot_product(h, c[1]) + c[2])),
      {_list(w.u)})) AS a
  FROM (SELECT cell_id, gene_ix, list_transform(range({WIDTH}), lambda j:
      sin(gene_ix * 0.1 + j + {phase}) * (value * {w.value_scale} + {w.value_shift})) AS h FROM {source})"""
    attn = """SELECT cell_id, gene_ix, a / (sum(a) OVER (PARTITION BY cell_id) + 1e-7) AS weight FROM {scored}"""
    pooled = f"""SELECT cell_id, list(tanh(t / (s + 1e-7)) * sc + sh ORDER BY pos) AS z FROM (
    SELECT cell_id, pos, sum(a * h[pos]) AS t, sum(a) AS s FROM {{scored}}, range(1, {WIDTH + 1}) r(pos) GROUP BY ALL),
    (SELECT unnest(range(1, {WIDTH + 1})) AS pos2, unnest({_list(w.out_scale)}) AS sc, unnest({_list(w.out_shift)}) AS sh)
    WHERE pos = pos2 GROUP BY cell_id"""
    return scored, attn, pooled


def head_sql(source: str, normalize: bool = True) -> str:
    """SQL for the dense layer on ``cell_id, z``: ``cell_id, vec``."""
    h = head_weights()
    dense = f"""SELECT cell_id, list_transform(list_zip({_columns(h.d)}, {_list(h.c)}),
      lambda c: greatest(list_dot_product(z, c[1]) + c[2], 0.0)) AS y FROM {source}"""
    if not normalize:
        return f"SELECT cell_id, y AS vec FROM ({dense})"
    return f"""SELECT cell_id, list_transform(y, lambda x:
      x / sqrt(greatest(list_dot_product(y, y), 1e-12))) AS vec FROM ({dense})"""


block("rna_in", "norm", "SELECT cell_id, gene_id AS gene_ix, value FROM norm")
block("protein_in", "expr_protein", "SELECT cell_id, gene_id AS gene_ix, ln(1 + value) AS value FROM expr_protein")
for _name, _phase in (("rna", 0.0), ("protein", 0.5)):
    _scored, _attn, _pooled = pooled_sql(f"{_name}_in", _phase)
    block(f"{_name}_scored", f"{_name}_in", _scored)
    block(f"{_name}_attn", f"{_name}_scored", _attn.format(scored=f"{_name}_scored"))
    block(f"{_name}_pooled", f"{_name}_scored", _pooled.format(scored=f"{_name}_scored"))
block(
    "joint_pooled",
    "rna_pooled protein_pooled",
    """SELECT cell_id, list_transform(list_zip(a.z, b.z), lambda p: p[1] + p[2]) AS z
  FROM rna_pooled a JOIN protein_pooled b USING (cell_id)""",
)


def rna_side(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, AttentionWeights]:
    from cytoplane.sources.records import build_records

    rows = norm(spark, d).select("cell_id", F.col("gene_id").alias("gene_ix"), "value")
    genes = var_genes(spark, d).select("gene_ix")
    return build_records(rows), gene_vectors(genes), attention_weights(0.0)


def protein_side(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, AttentionWeights]:
    from cytoplane.sources.records import build_records

    rows = expr_protein(spark, d).select(
        "cell_id", F.col("gene_id").alias("gene_ix"), F.log1p("value").alias("value")
    )
    brands = table(spark, d, "part").select(
        F.expr("cast(substring(p_brand, 7) as bigint)").alias("gene_ix")
    ).distinct()
    return build_records(rows), gene_vectors(brands, 0.5), attention_weights(0.5)
