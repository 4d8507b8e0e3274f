"""Per-cell training records: export, dictionaries, metadata and reading back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane import schema
from cytoplane.functions.arrays import fill_missing
from cytoplane.operators.ordering import with_position_in_group

# Fixed value: added to every entry when zeros are exported too.
EPSILON = 1e-5
DENSE_BYTES = 32 << 20
SHARED_BYTES = 32 << 20


def encode_dictionary(obs: DataFrame, columns: dict[str, str], order: str = "cell_ix") -> DataFrame:
    """Codes by order of first appearance: ``kind, value, code``.

    ``columns`` maps the kind of dictionary (batch, label) to its column.
    """
    first = None
    for kind, column in columns.items():
        one = obs.groupBy(F.col(column).cast("string").alias("value")).agg(
            F.min(order).alias("first_ix")
        )
        one = one.select(F.lit(kind).alias("kind"), "value", "first_ix")
        first = one if first is None else first.unionByName(one)
    coded = with_position_in_group(first, ["kind"], ["first_ix", "value"], "code")
    return coded.select("kind", "value", F.col("code").cast("int").alias("code"))


def apply_dictionary(
    df: DataFrame, dictionary: DataFrame, kind: str, column: str, name: str, strict: bool = True
) -> DataFrame:
    """Attach codes; a value the dictionary does not hold fails when ``strict``."""
    part = dictionary.where(F.col("kind") == kind).select(
        F.col("value").alias("__value"), F.col("code").alias(name)
    )
    # one row per value of the column: shared if it measures small, so that a hot value moves no rows
    size = part.agg(F.sum(F.octet_length("__value") + 64)).first()[0] or 0
    if size <= SHARED_BYTES:
        part = F.broadcast(part)
    joined = df.join(part, df[column].cast("string") == F.col("__value"), "left").drop("__value")
    if not strict:
        return joined
    problem = F.concat(F.lit(f"{kind} not in dictionary: "), F.coalesce(F.col(column), F.lit("null")))
    checked = F.when(F.col(name).isNull(), F.raise_error(problem).cast("int")).otherwise(F.col(name))
    return joined.withColumn(name, checked)


def decode(df: DataFrame, dictionary: DataFrame, kind: str, code: str, name: str) -> DataFrame:
    part = dictionary.where(F.col("kind") == kind).select(
        F.col("code").alias(code), F.col("value").alias(name)
    )
    return df.join(part, code)


def nonzero(expr: DataFrame) -> DataFrame:
    return expr.where(F.col("value") > 0)


def densify(records: DataFrame, n_genes: int, epsilon: float = 0.0, batch_bytes: int = DENSE_BYTES) -> DataFrame:
    """Every gene of the vocabulary in every record: absent entries are zero.

    ``epsilon`` is added to all entries; entries below zero are left out. Works
    record by record, so the dense grid is never shuffled; a task holds about
    ``batch_bytes`` of dense rows, or one row if that is larger.
    """
    at_once = max(1, batch_bytes // (16 * max(n_genes, 1)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, at_once):
                batch = whole.slice(low, at_once)
                feature, value = batch.column("feature"), batch.column("value")
                sizes = np.diff(np.asarray(feature.offsets))
                row = np.repeat(np.arange(batch.num_rows), sizes)
                dense = np.zeros((batch.num_rows, n_genes))
                dense[row, np.asarray(feature.flatten(), dtype=np.int64)] = np.asarray(value.flatten())
                dense += epsilon
                keep = dense >= 0
                edges = pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]), pa.int32())
                genes = pa.array(np.nonzero(keep)[1].astype(np.int64))
                lists = {
                    "feature": pa.ListArray.from_arrays(edges, genes),
                    "value": pa.ListArray.from_arrays(edges, pa.array(dense[keep])),
                }
                yield pa.RecordBatch.from_arrays(
                    [lists.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names
                )

    ready = records.withColumns({"feature": F.col("feature").cast("array<bigint>"), "value": F.col("value").cast("array<double>")})
    return ready.mapInArrow(spread, ready.schema)


def build_records(expr: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row per cell: gene indexes in order, their values, and the cell's codes.

    ``expr`` is ``cell_id, gene_ix, value``; a cell of ``cells`` without rows
    keeps empty lists. Without ``cells``, those of ``expr`` are taken, and
    nothing is joined. A record is bounded by the gene vocabulary.
    """
    packed = expr.groupBy("cell_id").agg(
        F.array_sort(F.collect_list(F.struct("gene_ix", "value"))).alias("__e")
    )
    lists = packed.select(
        "cell_id",
        F.col("__e.gene_ix").cast("array<bigint>").alias("feature"),
        F.col("__e.value").cast("array<double>").alias("value"),
    )
    if cells is None:
        return lists
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    extra = [c for c in cells.columns if c != "cell_id"]
    return cells.join(lists, "cell_id", "left").select(
        "cell_id", empty("feature", "array<bigint>"), empty("value", "array<double>"), *extra
    )


def write_records(records: DataFrame, path: str) -> None:
    """One directory per batch; a rerun replaces only the batches it holds.

    Rows are brought together by batch first, in as many tasks as a batch's
    bytes ask for, so that tasks x batches small files don't arise.
    """
    (
        records.hint("rebalance", "batch").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def write_single_batch(records: DataFrame, path: str) -> None:
    """As ``write_records`` for a slice that must hold exactly one batch."""
    found = records.agg(F.min("batch").alias("lo"), F.max("batch").alias("hi")).first()
    if found["lo"] is None or found["lo"] != found["hi"]:
        raise ValueError("expected the records of exactly one batch")
    write_records(records, path)


def read_records(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    fields = schema.RECORD_LABELLED if labelled else schema.RECORD
    rows = spark.read.schema(fields).parquet(path)
    return rows.withColumn("value", fill_missing(F.col("value"))).withColumn(
        "feature", F.transform("feature", lambda x: F.coalesce(x, F.lit(0).cast("bigint")))
    )


def read_selected(
    spark: SparkSession,
    path: str,
    only: Iterable[int] | None = None,
    without: Iterable[int] | None = None,
    labelled: bool = False,
) -> DataFrame:
    """Records of some batches; the filter is on the partition column."""
    rows = read_records(spark, path, labelled)
    if only is not None:
        rows = rows.where(F.col("batch").isin(*only))
    if without is not None:
        rows = rows.where(~F.col("batch").isin(*without))
    return rows


def record_metadata(genes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Vocabulary size and number of classes and batches, one row per fact."""
    facts = dictionary.groupBy("kind").agg(F.count("*").alias("n")).select(
        F.concat("kind", F.lit("_count")).alias("fact"), "n"
    )
    size = genes.agg(F.countDistinct("gene_id").alias("n")).select(
        F.lit("vocabulary_size").alias("fact"), "n"
    )
    return size.unionByName(facts)
