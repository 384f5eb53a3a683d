"""Streaming: rate limits, running counters, first answers and stale pages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.crawl import WINDOW_MS, admit_hits
from ..plans.site import MOST_SAVED


def rate_limited_stream(hits: DataFrame, most: int, key: str = "key", at: str = "ts_ms", window_ms: int = WINDOW_MS) -> DataFrame:
    """(key, at, admitted) of a stream of hits.

    The state of a key is its admitted times within the window, hence at most
    ``most`` numbers; a key that is silent for a window loses it.  Hits count in time
    order inside a micro-batch and in arrival order between them.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        ok, live = admit_hits(rows[at].tolist(), most, window_ms, live)
        state.update((live,))
        state.setTimeoutDuration(window_ms)
        yield pd.DataFrame({key: [k[0]] * len(rows), at: rows[at].to_numpy(), "admitted": ok})

    kind = dict(hits.dtypes)[key]
    return hits.select(key, F.col(at).cast("long").alias(at)).groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, `{at}` long, admitted boolean", "live array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def running_savings(saved: DataFrame, col: str = "saved") -> DataFrame:
    """The usage counters of a stream of conversions; for complete or update mode."""
    one = F.least(F.greatest(F.floor(col), F.lit(0)), F.lit(MOST_SAVED))
    return saved.agg(F.count("*").alias("conversions"), F.sum(one).alias("tokens_saved"))


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) by tumbling window with a watermark; for append mode."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def first_answers(answers: DataFrame, key: str = "key") -> DataFrame:
    """Each key's first row: the write-through cache of a stream of answers."""
    return answers.dropDuplicates([key])


def stale_stream(current: DataFrame, built: DataFrame) -> DataFrame:
    """Pages of a stream (url, hash) whose document in the static table was built from another text."""
    return current.join(built.select("url", F.col("hash").alias("built")), "url").where("hash <> built")


def upsert_counters(state: dict[str, Any], batch: DataFrame, _id: int) -> None:
    """For foreachBatch: adds a batch's figures to counters kept by the caller; a batch seen again is skipped."""
    if _id <= state.get("last", -1):
        return
    row = running_savings(batch).first()
    state["conversions"] = state.get("conversions", 0) + row["conversions"]
    state["tokens_saved"] = state.get("tokens_saved", 0) + (row["tokens_saved"] or 0)
    state["last"] = _id
