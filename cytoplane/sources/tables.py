"""Reading and writing expression tables, annotation and gene lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoplane import schema
from cytoplane.operators.ordering import SHARED_BYTES, with_position
from cytoplane.session import cut


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", fields: T.StructType | None = None, **options
) -> DataFrame:
    """Any table Spark reads; a schema given up front saves the inference pass."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(fields) if fields is not None else reader).load(path)


def read_expression(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return read_table(spark, path, fmt, schema.EXPR, **options)


def read_triples(spark: SparkSession, path: str, comment: str = "%") -> DataFrame:
    """Space-separated ``gene_ix cell_ix value`` lines, as sparse matrices are shipped."""
    return read_table(spark, path, "csv", schema.TRIPLES, sep=" ", comment=comment)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``pos, line``: text lines with their place, from 0, in a file or in the files of a folder by name.

    Files are read in splits; a line's place follows from its file, the start of
    its split and its order there, by a distributed sort.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    return with_position(lines, ["file", "split", "at"], "pos").select("pos", "line")


def read_matrix(
    spark: SparkSession, matrix: str, genes: str, cells: str, shared_bytes: int = SHARED_BYTES
) -> DataFrame:
    """``cell, gene, value`` from a coordinate matrix with its files of gene and cell names.

    ``matrix`` holds comment lines (``%``), one line with the numbers of genes,
    cells and entries, and entries ``gene cell value`` counted from 1; the n-th
    line of ``genes`` and ``cells`` is the n-th name (up to its first tab). The
    first line that is no comment is the head, in whatever split it stands. The
    numbers in it must agree with the files. Names are joined by place, sent to
    all tasks if they measure up to ``shared_bytes``.
    """
    lines = spark.read.text(matrix).select(
        F.col("value").alias("line"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    ).where("line not like '!%%' escape '!' and trim(line) <> ''")
    head = lines.agg(F.min(F.struct("at", "line")).alias("h"), F.count("*").alias("n")).select("h.at", "h.line", "n").first()
    if head["line"] is None:
        raise ValueError(f"{matrix} has no head line")
    sizes = [int(x) for x in head["line"].split()]
    parts = F.split(F.trim("line"), "\\s+")
    entries = lines.where(F.col("line") != head["line"]).select(
        (parts[0].cast("bigint") - 1).alias("gene_pos"), (parts[1].cast("bigint") - 1).alias("cell_pos"), parts[2].cast("double").alias("value")
    )
    # an entry may read like the head; it then stands as often as the head line is repeated
    if head["n"] - 1 != sizes[2]:
        raise ValueError(f"{matrix} has {head['n'] - 1} entries, its head says {sizes[2]}")
    twice = lines.where(F.col("line") == head["line"]).count() - 1
    if twice:
        row = spark.range(twice).select(F.lit(sizes[0] - 1).cast("bigint"), F.lit(sizes[1] - 1).cast("bigint"), F.lit(float(sizes[2])))
        entries = entries.union(row)
    for path, place, name, n in ((genes, "gene_pos", "gene", sizes[0]), (cells, "cell_pos", "cell", sizes[1])):
        names = cut(read_lines(spark, path).select(F.col("pos").alias(place), F.split("line", "\t")[0].alias(name)))
        held = names.agg(F.count("*").alias("n"), F.sum(F.length(name) + 24).alias("bytes")).first()
        if held["n"] != n:
            raise ValueError(f"{path} has {held['n']} lines, the head of {matrix} says {n}")
        entries = entries.join(F.broadcast(names) if (held["bytes"] or 0) <= shared_bytes else names, place)
    return entries.select("cell", "gene", "value")


def write_matrix(expr: DataFrame, folder: str) -> None:
    """``cell_id, gene_id, value`` as folders ``matrix``, ``genes`` and ``cells`` that ``read_matrix`` reads."""
    expr = cut(expr.select("cell_id", "gene_id", "value"))
    sides = {}
    for column, name in (("gene_id", "genes"), ("cell_id", "cells")):
        sides[name] = cut(with_position(expr.select(column).distinct(), [column], f"{name}_pos"))
        ordered = sides[name].orderBy(f"{name}_pos").select(F.col(column).cast("string").alias("value"))
        ordered.write.text(f"{folder}/{name}")
    head = f"{sides['genes'].count()} {sides['cells'].count()} {expr.count()}"
    start = expr.sparkSession.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, head)], "o bigint, value string")
    rows = expr.join(sides["genes"], "gene_id").join(sides["cells"], "cell_id")
    value = F.concat_ws(" ", F.col("genes_pos") + 1, F.col("cells_pos") + 1, F.col("value"))
    # the head stands in the first file; the order of entries is free
    body = rows.select((F.pmod(F.xxhash64("cell_id"), F.lit(1 << 20)) + 2).alias("o"), value.alias("value"))
    start.unionByName(body).orderBy("o").select("value").write.text(f"{folder}/matrix")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """Gene vocabulary from a CSV file: an index column and column ``0``."""
    rows = spark.read.schema(schema.GENE_LIST).option("header", True).csv(path)
    return rows.select(F.col("0").alias("gene_id"), F.col("ix").alias("gene_ix"))


def annotate(expr: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """Expression rows with their cell and gene annotation."""
    return expr.join(obs, "cell_id").join(var, "gene_id")


def save_snapshot(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{name}") for name in names]
