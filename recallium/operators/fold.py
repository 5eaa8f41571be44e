"""Folds over the rows of a key in order: what no window function can say.

Rows are dealt by key and sorted; each task streams through its rows and carries only the state of
the current key from batch to batch, so a key of any size takes constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Any, Any], tuple[Any, tuple]], added: str) -> DataFrame:
    """Append columns ``added`` (DDL) to each row: ``step(state, row)`` gets None at a key's first
    row and gives the next state and the row's values."""
    names = [part.split()[0] for part in added.split(",")]
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Any = object()
        state = None
        for pdf in batches:
            values = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, None
                state, out = step(state, row)
                values.append(out)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(values, columns=names)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])
    return df.select(columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
