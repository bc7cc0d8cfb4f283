"""Work on many whole groups at a time, for groups too small to be worth a call each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys start, of rows sorted by the keys; nulls are equal."""
    opens = np.zeros(len(frame), bool)
    opens[:1] = True
    for k in keys:
        own, before = frame[k], frame[k].shift()
        opens |= ~((own == before) | (own.isna() & before.isna())).to_numpy(bool)
    return np.nonzero(opens)[0]


def whole_groups(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work() on frames that hold whole groups of keys, sorted by keys and order: as many groups as come in a batch of Arrow, or one that is longer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last group so far
        for batch in batches:
            if not len(batch):
                continue
            at = starts(batch, keys)
            if held and len(starts(pd.concat([held[-1].tail(1), batch.head(1)], ignore_index=True), keys)) == 1:
                if len(at) == 1:
                    held.append(batch)
                    continue
            if held or at[-1]:
                yield work(pd.concat([*held, batch.iloc[: at[-1]]], ignore_index=True))
            held = [batch.iloc[at[-1] :]]
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
