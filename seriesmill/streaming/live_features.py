"""Features of an unbounded panel, an extension beyond whole tables.

Each series keeps its last values as state; a new row gets the lags and rolling
statistics of the rows up to it. Rows of a series are taken in date order within
a micro-batch; a row older than the last one taken is late and is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.forecasting import tail_value
from ..plans.formula import parse


def live_features(stream: DataFrame, formula: str, date: str, groups: Sequence[str], *, idle: str | None = None) -> DataFrame:
    """(groups, date, target, features) of each row as it comes; ``idle``, such as '7 days', forgets a series that long without rows (processing time)."""
    spec = parse(formula, stream.columns)
    moving = spec.of("lag") + spec.rolling
    if len(moving) != len(spec.terms):
        raise ValueError("live features are lags and rolling statistics of the target")
    kinds = stream.schema
    out = T.StructType([*[kinds[c] for c in [*groups, date]], T.StructField(spec.target, T.DoubleType()), *[T.StructField(t.column, T.DoubleType()) for t in moving]])
    state = T.StructType([T.StructField("last", T.LongType()), T.StructField("tail", T.ArrayType(T.DoubleType()))])
    need = spec.memory
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last, tail = held.get if held.exists else (None, [])
        tail = [np.nan if v is None else v for v in tail]
        rows = pd.concat(list(batches), ignore_index=True).sort_values(date, kind="stable")
        found = []
        for at, y in zip(rows[date], rows[spec.target].astype(float), strict=True):
            stamp = pd.Timestamp(at).value
            if last is not None and stamp <= last:
                continue
            last = stamp
            # windows end at the row itself, lags before it
            row = [tail_value("lag", tail, t.n) if t.kind == "lag" else tail_value(t.kind, [*tail, y], t.n) for t in moving]
            tail = [*tail, y][-max(1, need) :]
            found.append((*key, at, y, *row))
        held.update((last, [None if np.isnan(v) else float(v) for v in tail]))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(found, columns=out.names)

    return stream.groupBy(*groups).applyInPandasWithState(update, out, state, "append", "NoTimeout" if idle is None else "ProcessingTimeTimeout")
