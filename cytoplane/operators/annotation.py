"""Joins and rewrites on cell annotation and feature tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_by_id(left: DataFrame, right: DataFrame, key: str = "cell_id", how: str = "inner") -> DataFrame:
    return left.join(right, key, how)


def select_in_order(rows: DataFrame, ids: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows named by an id list; the list's order stays as a column of it."""
    return rows.join(ids, key)


def members(source: DataFrame, ids: DataFrame, key: str = "cell_id") -> DataFrame:
    return source.join(ids.select(key), key, "left_semi")


def pair_modalities(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Records of the same cell side by side, matched by id.

    Cells present in one table only stay out; ``unpaired`` reports them.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        keep = [F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "cell_id"]
        return df.select("cell_id", *keep)

    return side(left, names[0]).join(side(right, names[1]), "cell_id")


def pair_all(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """As ``pair_modalities`` with the unpaired cells too: one full join.

    ``present_in`` is the name of the only table that holds the cell, or
    ``both``; what the other would give is null.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        keep = [F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "cell_id"]
        return df.select("cell_id", *keep, F.lit(True).alias(f"__{name}"))

    joined = side(left, names[0]).join(side(right, names[1]), "cell_id", "full")
    one, two = (F.col(f"__{n}").isNotNull() for n in names)
    where = F.when(one & two, "both").when(one, names[0]).otherwise(names[1])
    return joined.withColumn("present_in", where).drop(*[f"__{n}" for n in names])


def unpaired(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Cells of one table only, with its name."""
    return pair_all(left, right, names).where("present_in <> 'both'").select("cell_id", "present_in")


def recode(column: Column, mapping: dict[str, str]) -> Column:
    """Map fine labels to coarse ones; labels without an entry become null."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, column)


def recode_by_table(rows: DataFrame, column: str, lookup: DataFrame, name: str) -> DataFrame:
    """As ``recode`` with a lookup table ``fine, coarse``."""
    part = lookup.select(F.col("fine").alias(column), F.col("coarse").alias(name))
    return rows.join(part, column, "left")


def override(start: Column, rules: list[tuple[Column, str]]) -> Column:
    """Apply rules in order; a later rule that holds wins."""
    out = start
    for condition, value in rules:
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def tag_and_fill(rows: DataFrame, tag: str, name: str = "source") -> DataFrame:
    """Constant source column; missing text in any column becomes that constant."""
    texts = [n for n, t in rows.dtypes if t == "string"]
    filled = rows.na.fill(tag, texts) if texts else rows
    return filled.withColumn(name, F.lit(tag))


def suffix_features(rows: DataFrame, suffix: str, column: str = "gene_name") -> DataFrame:
    return rows.withColumn(column, F.concat(F.col(column).cast("string"), F.lit(suffix)))


def stack_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """Features of two modalities in one long table."""
    return left.unionByName(right)


def negate(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, -F.col(column))


def confident(rows: DataFrame, probabilities: Column, threshold: float, strict: bool = False) -> DataFrame:
    """Rows whose largest class probability reaches (or, strict, exceeds) a threshold."""
    best = F.array_max(probabilities)
    return rows.where(best > threshold if strict else best >= threshold)
