"""Structured Streaming: audit events against frozen models, with watermarks for late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_votes(scored: DataFrame, psi: float, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, normal, intrusions, flagged of each time window of a stream of ts and pred: a majority vote, once the watermark has passed."""
    votes = scored.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count_if(F.col("pred") > psi).alias("normal"), F.count_if(F.col("pred") <= psi).alias("intrusions"))
    return votes.select("window.start", "window.end", "normal", "intrusions", (F.col("intrusions") > F.col("normal")).alias("flagged"))


def score_stream(values: DataFrame, table: DataFrame) -> DataFrame:
    """A stream of name, metric, value (and more) with `pred` of a frozen table of parzen_pred(); values that the table hasn't seen have NULL."""
    return values.join(table.select("name", "metric", "value", "pred"), ["name", "metric", "value"], "left")


def incarnation_stream(events: DataFrame) -> DataFrame:
    """pid, event_id, incarnation of a stream of pid, event_id, ts, boundary (a row that ends an incarnation after itself).

    State is one counter a pid. Within a micro-batch rows are taken by time, then event_id.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ends = rows["boundary"].astype(int)
        own = count + ends.cumsum() - ends
        state.update((int(count + ends.sum()),))
        yield pd.DataFrame({"pid": key[0], "event_id": rows["event_id"].to_numpy(), "incarnation": own.to_numpy()})

    return events.groupBy("pid").applyInPandasWithState(step, "pid long, event_id long, incarnation long", "count long", "append", GroupStateTimeout.NoTimeout)
