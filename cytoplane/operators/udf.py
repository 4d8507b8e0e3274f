"""User functions over partitions and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def parallel_map(
    rows: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply ``func`` to Arrow batches on all executors; no order is promised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield func(batch)

    return rows.mapInPandas(run, schema)


def grouped_apply(
    rows: DataFrame,
    keys: list[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    merge: list[Column],
) -> DataFrame:
    """User aggregation per group in two steps.

    ``partial`` reduces one group's rows inside one Arrow batch, before the
    shuffle; ``merge`` combines the partial rows with Spark aggregates. No
    group is ever gathered whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(keys, dropna=False, sort=False):
                yield partial(part)

    return rows.mapInPandas(run, schema).groupBy(*keys).agg(*merge)
