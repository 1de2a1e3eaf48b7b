"""Sequential folds over ordered rows of a key, streamed: memory does not grow with a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], needs: list[str], out: list[str], schema: str) -> DataFrame:
    """rows with columns `out` that step(state, needed values) gives, row after row in order within each key."""
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: Any = object()
        state = None
        for frame in frames:
            made = []
            for k, *values in zip(frame[key].tolist(), *(frame[c].tolist() for c in needs), strict=True):
                if k != last:
                    last, state = k, start()
                state, result = step(state, tuple(values))
                made.append(result)
            yield frame.assign(**{c: [m[i] for m in made] for i, c in enumerate(out)})

    return sorted_rows.mapInPandas(run, schema)
