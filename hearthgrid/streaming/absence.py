"""Structured Streaming variant of the absence counter and the run differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key string, run long, event string, price double, before double"
_STATE = "price double, last_run long, missed int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, gone_at: int) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("run", kind="stable")
    price, last_run, missed = state.get if state.exists else (None, None, 0)
    out = []
    for r in rows.itertuples():
        if last_run is not None and r.run <= last_run:
            continue  # a run that comes twice changes nothing
        now = None if pd.isna(r.price) else float(r.price)
        if r.seen:
            if last_run is None:
                out.append((key[0], r.run, "alta", now, None))
            elif now is not None and price is not None and now != price:
                out.append((key[0], r.run, "precio", now, price))
            price, missed = now if now is not None else price, 0
        elif last_run is not None:
            missed += 1
            if missed == gone_at:
                out.append((key[0], r.run, "baja", price, None))
        else:
            continue
        last_run = r.run
    if last_run is not None:
        state.update((price, last_run, missed))
    yield pd.DataFrame(out, columns=["key", "run", "event", "price", "before"])


def market_events(marks: DataFrame, gone_at: int = 3) -> DataFrame:
    """Events of a stream of (key, run, seen, price): one row for each key and run in which its source delivered.

    The counter advances by runs, not by time, so a source that is down moves nothing.
    """
    return marks.groupBy("key").applyInPandasWithState(
        lambda k, b, s: _advance(k, b, s, gone_at), _OUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )
