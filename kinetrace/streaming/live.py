"""Readings as they arrive: windowed statistics, gap alarms, and alignment of what is complete.

Not part of what the batch layer must match; the same column expressions are used on unbounded inputs. State is
bounded by the watermark: late readings beyond it are dropped, as streams demand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expressions import missing


def windowed_stats(readings: DataFrame, time: str, value: str, *keys: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, gaps, min, max, mean and population std for each key and window."""
    x = F.when(~missing(value), F.col(value))
    w = F.window(time, window)
    return readings.withWatermark(time, late).groupBy(w, *keys).agg(
        F.count(F.lit(1)).alias("count"), F.sum(missing(value).cast("bigint")).alias("gaps"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def aligned_stream(readings: DataFrame, episode: str, stream: str, t: str, value: str, start: int, step: int) -> DataFrame:
    """(episode, stream, k, t, value): the forward as-of match on the grid ``start + k * step``, once a reading answers it.

    ``t`` is integer time and rises within a stream. A stream's state is one number: the next grid point that has
    no answer yet.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        k = state.get[0] if state.exists else 0
        out = []
        for pdf in frames:
            for time, x in pdf[[t, value]].sort_values(t, kind="stable").itertuples(index=False):
                while start + k * step <= time:
                    out.append((*key, k, time, x))
                    k += 1
        state.update((k,))
        yield pd.DataFrame(out, columns=[episode, stream, "k", t, value])

    kinds = dict(readings.dtypes)
    schema = f"{episode} {kinds[episode]}, {stream} {kinds[stream]}, k bigint, {t} bigint, {value} {kinds[value]}"
    return readings.select(episode, stream, t, value).groupBy(episode, stream).applyInPandasWithState(run, schema, "k bigint", "append", GroupStateTimeout.NoTimeout)
