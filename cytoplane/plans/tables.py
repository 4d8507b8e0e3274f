"""Queries: sources, sinks, records and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.operators import annotation as A
from cytoplane.operators import preprocess as P
from cytoplane.operators.ordering import with_position
from cytoplane.plans import fixtures as fx
from cytoplane.plans.registry import block, query
from cytoplane.session import workspace
from cytoplane.sources import records as R
from cytoplane.sources import tables as S


@query(
    "scan_expr",
    "expr obs var_genes",
    """SELECT e.cell_id, e.gene_id, e.value, o.batch, o.sample, g.gene_name
FROM expr e JOIN obs o USING (cell_id) JOIN var_genes g USING (gene_id)""",
)
def scan_expr(spark, d):
    rows = S.annotate(fx.expr(spark, d), fx.obs(spark, d), fx.var_genes(spark, d))
    return rows.select("cell_id", "gene_id", "value", "batch", "sample", "gene_name")


@query("scan_matrix", "expr", "SELECT cell_id, gene_id, value FROM expr")
def scan_matrix(spark, d):
    """Expression rows written as a headed coordinate matrix with its name files, and read back."""
    folder = workspace(spark, "matrix")
    S.write_matrix(fx.expr(spark, d), folder)
    found = S.read_matrix(spark, f"{folder}/matrix", f"{folder}/genes", f"{folder}/cells")
    return found.select(F.col("cell").cast("bigint").alias("cell_id"), F.col("gene").cast("bigint").alias("gene_id"), "value")


@query(
    "scan_text_formats",
    "expr obs var_genes",
    """SELECT f AS format, e.cell_id, e.gene_id, e.value, o.batch, g.gene_name
FROM expr e JOIN obs o USING (cell_id) JOIN var_genes g USING (gene_id), (SELECT unnest(['csv', 'json']) AS f)""",
)
def scan_text_formats(spark, d):
    """Expression rows read from CSV and from JSON lines, with their annotation."""
    out = None
    for kind, options in (("csv", {"header": True}), ("json", {})):
        path = workspace(spark, kind)
        fx.expr(spark, d).select("cell_id", "gene_id", "value").write.format(kind).options(**options).save(path)
        rows = S.annotate(S.read_expression(spark, path, kind, **options), fx.obs(spark, d), fx.var_genes(spark, d))
        rows = rows.select(F.lit(kind).alias("format"), "cell_id", "gene_id", "value", "batch", "gene_name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "snapshot_expr",
    "expr obs var_genes",
    """SELECT o.sample, g.brand, count(*) AS n, sum(e.value) AS total
FROM expr e JOIN obs o USING (cell_id) JOIN var_genes g USING (gene_id) GROUP BY ALL""",
)
def snapshot_expr(spark, d):
    path = workspace(spark, "snapshot")
    S.save_snapshot(path, expr=fx.expr(spark, d), obs=fx.obs(spark, d), var=fx.var_genes(spark, d))
    rows = S.annotate(*S.load_snapshot(spark, path, "expr", "obs", "var"))
    return rows.groupBy("sample", "brand").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


block(
    "codes",
    "obs",
    """SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY first_ix, value) - 1 AS INTEGER) AS code
  FROM (SELECT 'batch' AS kind, batch AS value, min(cell_ix) AS first_ix FROM obs GROUP BY batch
        UNION SELECT 'label', sample, min(cell_ix) FROM obs GROUP BY sample)""",
)


def _dictionary(spark, d):
    return R.encode_dictionary(fx.obs(spark, d), {"batch": "batch", "label": "sample"})


def _coded_cells(spark, d, dictionary, labelled=False):
    cells = R.apply_dictionary(fx.obs(spark, d), dictionary, "batch", "batch", "batch_code")
    if labelled:
        cells = R.apply_dictionary(cells, dictionary, "label", "sample", "label")
    keep = ["cell_id", *(["label"] if labelled else []), F.col("batch_code").alias("batch")]
    return cells.select(*keep)


def _records(spark, d, labelled=False):
    cells = _coded_cells(spark, d, _dictionary(spark, d), labelled)
    rows = fx.expr(spark, d).select("cell_id", F.col("gene_id").alias("gene_ix"), "value")
    return R.build_records(R.nonzero(rows), cells)


def _entries(records, *extra):
    long = records.select(
        "cell_id", *extra, "batch", F.posexplode(F.arrays_zip("feature", "value")).alias("pos", "e")
    )
    return long.select(
        "cell_id",
        *extra,
        "batch",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("e.feature").alias("gene_ix"),
        F.col("e.value").alias("value"),
    )


ENTRIES = """SELECT e.cell_id, {extra} b.code AS batch,
  row_number() OVER (PARTITION BY e.cell_id ORDER BY e.gene_id) - 1 AS pos, e.gene_id AS gene_ix, e.value
FROM expr e JOIN obs o USING (cell_id) JOIN codes b ON b.kind = 'batch' AND b.value = o.batch
JOIN codes l ON l.kind = 'label' AND l.value = o.sample WHERE e.value > 0"""


@query("export_records", "expr obs codes", ENTRIES.format(extra=""))
def export_records(spark, d):
    path = workspace(spark, "records")
    R.write_records(_records(spark, d), path)
    return _entries(R.read_records(spark, path))


@query("export_records_supervised", "expr obs codes", ENTRIES.format(extra="l.code AS label,"))
def export_records_supervised(spark, d):
    path = workspace(spark, "records")
    R.write_records(_records(spark, d, labelled=True), path)
    return _entries(R.read_records(spark, path, labelled=True), "label")


@query(
    "export_records_single_batch",
    "expr obs codes",
    ENTRIES.format(extra="l.code AS label,") + f" AND o.batch = '{fx.HELD_OUT}'",
)
def export_records_single_batch(spark, d):
    """The slice's codes come from the dictionaries of the whole table."""
    path = workspace(spark, "dictionary")
    _dictionary(spark, d).write.parquet(path)
    saved = spark.read.parquet(path)
    one = saved.where((F.col("kind") == "batch") & (F.col("value") == fx.HELD_OUT))
    cells = _coded_cells(spark, d, saved, labelled=True).join(
        F.broadcast(one.select(F.col("code").alias("batch"))), "batch", "left_semi"
    )
    rows = fx.expr(spark, d).select("cell_id", F.col("gene_id").alias("gene_ix"), "value")
    out = workspace(spark, "records")
    mine = rows.join(cells.select("cell_id"), "cell_id", "left_semi")
    R.write_single_batch(R.build_records(R.nonzero(mine), cells), out)
    return _entries(R.read_records(spark, out, labelled=True), "label")


@query(
    "record_metadata",
    "var_genes codes",
    """SELECT 'vocabulary_size' AS fact, count(DISTINCT gene_id) AS n FROM var_genes
UNION ALL SELECT kind || '_count', count(*) FROM codes GROUP BY kind""",
)
def record_metadata(spark, d):
    return R.record_metadata(fx.var_genes(spark, d), _dictionary(spark, d))


@query(
    "load_dictionaries",
    "obs codes",
    """SELECT o.cell_id, b.code AS batch_code, l.code AS label_code FROM obs o
JOIN codes b ON b.kind = 'batch' AND b.value = o.batch
JOIN codes l ON l.kind = 'label' AND l.value = o.sample""",
)
def load_dictionaries(spark, d):
    path = workspace(spark, "dictionary")
    _dictionary(spark, d).write.parquet(path)
    saved = spark.read.parquet(path)
    cells = R.apply_dictionary(fx.obs(spark, d), saved, "batch", "batch", "batch_code")
    cells = R.apply_dictionary(cells, saved, "label", "sample", "label_code")
    return cells.select("cell_id", "batch_code", "label_code")


@query(
    "scan_records",
    "expr obs codes",
    """SELECT o.cell_id, b.code AS batch, count(e.gene_id) AS n_genes, coalesce(sum(e.value), 0) AS total,
  coalesce(min(e.gene_id), -1) AS first_gene
FROM obs o JOIN codes b ON b.kind = 'batch' AND b.value = o.batch LEFT JOIN expr e ON e.cell_id = o.cell_id AND e.value > 0
GROUP BY ALL""",
)
def scan_records(spark, d):
    path = workspace(spark, "records")
    R.write_records(_records(spark, d), path)
    return R.read_records(spark, path).select(
        "cell_id",
        "batch",
        F.size("feature").cast("bigint").alias("n_genes"),
        F.aggregate("value", F.lit(0.0), lambda s, x: s + x).alias("total"),
        F.coalesce(F.get("feature", F.lit(0)), F.lit(-1)).cast("bigint").alias("first_gene"),
    )


@query("scan_gene_list", "ref_genes", "SELECT gene_id, gene_ix FROM ref_genes")
def scan_gene_list(spark, d):
    """Round trip of the vocabulary through a CSV file with column ``0``."""
    path = workspace(spark, "genes")
    genes = fx.ref_genes(spark, d).select(F.col("gene_ix").alias("ix"), F.col("gene_id").alias("0"))
    genes.write.option("header", True).csv(path)
    return S.read_gene_list(spark, path)


@query(
    "scan_selected_batches",
    "expr obs codes",
    f"""SELECT CASE WHEN o.batch = '{fx.HELD_OUT}' THEN 'held_out' ELSE 'training' END AS part, b.code AS batch,
  count(DISTINCT o.cell_id) AS n_cells, count(e.gene_id) AS n_entries
FROM obs o JOIN codes b ON b.kind = 'batch' AND b.value = o.batch LEFT JOIN expr e ON e.cell_id = o.cell_id AND e.value > 0
GROUP BY ALL""",
)
def scan_selected_batches(spark, d):
    """All batches but one, and that one alone, by partition filter."""
    path = workspace(spark, "records")
    dictionary = _dictionary(spark, d)
    R.write_records(_records(spark, d), path)
    held = dictionary.where((F.col("kind") == "batch") & (F.col("value") == fx.HELD_OUT)).first()["code"]
    parts = R.read_selected(spark, path, without=[held]).withColumn("part", F.lit("training")).unionByName(
        R.read_selected(spark, path, only=[held]).withColumn("part", F.lit("held_out"))
    )
    return parts.groupBy("part", "batch").agg(
        F.count("*").alias("n_cells"), F.sum(F.size("feature")).alias("n_entries")
    )


DENSE = """SELECT c.cell_id, count(*) AS n_entries, round(sum(coalesce(e.value, 0) + {eps}), 6) AS total,
  round(sum((coalesce(e.value, 0) + {eps}) * (g.gene_ix + 1)), 4) AS checksum
FROM {cells} c CROSS JOIN {genes} g LEFT JOIN {expr} e ON e.cell_id = c.cell_id AND e.gene_id = g.gene_id
GROUP BY c.cell_id"""


def _dense_summary(records):
    plain = lambda s, x: s + x
    weighted = F.zip_with("feature", "value", lambda g, x: x * (g + 1))
    return records.select(
        "cell_id",
        F.size("feature").cast("bigint").alias("n_entries"),
        F.round(F.aggregate("value", F.lit(0.0), plain), 6).alias("total"),
        F.round(F.aggregate(weighted, F.lit(0.0), plain), 4).alias("checksum"),
    )


@query(
    "nonzero_filter",
    "expr obs var_genes",
    f"""SELECT 'nonzero' AS form, cell_id, count(*) AS n_entries, round(sum(value), 6) AS total,
  round(sum(value * (gene_id + 1)), 4) AS checksum FROM expr WHERE value > 0 GROUP BY cell_id
UNION ALL SELECT 'shifted', * FROM ({DENSE.format(eps='1e-5', cells='obs', genes='var_genes', expr='expr')})""",
)
def nonzero_filter(spark, d):
    """Both export forms: entries above zero, and all genes shifted by 1e-5."""
    rows = fx.expr(spark, d).select("cell_id", F.col("gene_id").alias("gene_ix"), "value")
    cells = fx.obs(spark, d).select("cell_id")
    records = R.build_records(R.nonzero(rows), cells)
    n_genes = fx.var_genes(spark, d).count()
    sparse = _dense_summary(records).where("n_entries > 0").withColumn("form", F.lit("nonzero"))
    full = _dense_summary(R.densify(records, n_genes, R.EPSILON)).withColumn("form", F.lit("shifted"))
    return sparse.unionByName(full).select("form", "cell_id", "n_entries", "total", "checksum")


@query(
    "pad_to_reference_genes",
    "query_expr obs ref_genes",
    DENSE.format(eps="0.0", cells="obs", genes="ref_genes", expr="query_expr"),
)
def pad_to_reference_genes(spark, d):
    vocabulary = fx.ref_genes(spark, d)
    size = vocabulary.count()
    aligned = P.align_to_vocabulary(fx.query_expr(spark, d), vocabulary, declared=size)
    records = R.build_records(aligned, fx.obs(spark, d).select("cell_id"))
    return _dense_summary(R.densify(records, size))


@query(
    "dictionary_encode",
    "codes",
    "SELECT kind, value, code FROM codes",
)
def dictionary_encode(spark, d):
    return _dictionary(spark, d)


@query(
    "decode_codes",
    "obs codes",
    "SELECT o.cell_id, l.code AS label_code, o.sample AS label FROM obs o JOIN codes l ON l.kind = 'label' AND l.value = o.sample",
)
def decode_codes(spark, d):
    dictionary = _dictionary(spark, d)
    coded = R.apply_dictionary(fx.obs(spark, d), dictionary, "label", "sample", "label_code")
    return R.decode(coded.select("cell_id", "label_code"), dictionary, "label", "label_code", "label")


@query(
    "append_file_results",
    "expr obs",
    """SELECT o.batch, count(DISTINCT e.cell_id) AS n_cells, round(sum(e.value), 6) AS total
FROM expr e JOIN obs o USING (cell_id) WHERE e.value > 0 GROUP BY o.batch""",
)
def append_file_results(spark, d):
    """Per-file results in one scan over all record partitions."""
    path = workspace(spark, "records")
    dictionary = _dictionary(spark, d)
    R.write_records(_records(spark, d), path)
    per = (
        R.read_records(spark, path)
        .where(F.size("feature") > 0)
        .groupBy("batch")
        .agg(
            F.count("*").alias("n_cells"),
            F.round(F.sum(F.aggregate("value", F.lit(0.0), lambda s, x: s + x)), 6).alias("total"),
        )
        .withColumnRenamed("batch", "batch_code")
    )
    return R.decode(per, dictionary, "batch", "batch_code", "batch").select("batch", "n_cells", "total")


@query(
    "pair_modalities",
    "expr expr_protein",
    """SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, coalesce(a.n, 0) AS n_rna, coalesce(b.n, 0) AS n_protein,
  CASE WHEN b.cell_id IS NULL THEN 'rna' WHEN a.cell_id IS NULL THEN 'protein' ELSE 'both' END AS present_in
FROM (SELECT cell_id, count(*) AS n FROM expr GROUP BY 1) a
FULL JOIN (SELECT cell_id, count(*) AS n FROM expr_protein GROUP BY 1) b USING (cell_id)""",
)
def pair_modalities(spark, d):
    """Paired records by id, and the cells only one modality holds."""

    def records(rows):
        rows = rows.select("cell_id", F.col("gene_id").alias("gene_ix"), "value")
        return R.build_records(rows)

    rna, protein = records(fx.expr(spark, d)), records(fx.expr_protein(spark, d))
    joined = A.pair_all(rna, protein, ("rna", "protein"))
    sizes = [
        F.coalesce(F.size(f"feature_{n}"), F.lit(0)).cast("bigint").alias(f"n_{n}") for n in ("rna", "protein")
    ]
    return joined.select("cell_id", *sizes, "present_in")


@query(
    "select_cells_by_id",
    "obs",
    """SELECT o.cell_id, o.sample, i.position FROM obs o
JOIN (SELECT cell_id, row_number() OVER (ORDER BY score DESC, cell_id) - 1 AS position FROM obs WHERE score > 0) i USING (cell_id)""",
)
def select_cells_by_id(spark, d):
    """Cells in the order of an id list (here: positive scores, highest first)."""
    ids = fx.obs(spark, d).where("score > 0").select("cell_id", "score")
    ordered = with_position(ids, [F.desc("score"), F.col("cell_id")], "position")
    rows = fx.obs(spark, d).select("cell_id", "sample")
    return A.select_in_order(rows, ordered.select("cell_id", "position"))
