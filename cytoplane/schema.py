"""Explicit schemas of the tables the operators exchange."""

from pyspark.sql import types as T

EXPR = T.StructType(
    [
        T.StructField("cell_id", T.LongType(), False),
        T.StructField("gene_id", T.LongType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)

# Coordinate triples as written by sparse matrix exporters.
TRIPLES = T.StructType(
    [
        T.StructField("gene_ix", T.LongType()),
        T.StructField("cell_ix", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

RECORD = T.StructType(
    [
        T.StructField("cell_id", T.LongType()),
        T.StructField("feature", T.ArrayType(T.LongType())),
        T.StructField("value", T.ArrayType(T.DoubleType())),
        T.StructField("batch", T.IntegerType()),
    ]
)

RECORD_LABELLED = T.StructType(
    RECORD.fields[:3] + [T.StructField("label", T.IntegerType())] + RECORD.fields[3:]
)

DICTIONARY = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("code", T.IntegerType()),
    ]
)

GENE_LIST = T.StructType(
    [T.StructField("ix", T.LongType()), T.StructField("0", T.LongType())]
)

NEIGHBOURS = "query_id bigint, ref_id bigint, sim double, label int"
