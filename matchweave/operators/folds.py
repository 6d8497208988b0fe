"""Ordered folds per key whose memory is one row: for rules in which a rejected row must leave no trace.

Rows are dealt by key and sorted inside partitions; each partition is then read once, in order. Unlike a grouped map, no
key's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple]], schema: str) -> DataFrame:
    """``step(state, row)`` returns the next state of the row's key and the output row; ``start()`` is a key's first state."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                k = getattr(row, key)
                if k != last:
                    last, state = k, start()
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=columns)

    return df.where(df[key].isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
