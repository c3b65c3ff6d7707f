"""File-watch events: filter, debounce, throttle. Each takes and gives a (streaming) DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions import fixed as X
from quarry.functions.ignore_rules import is_ignored
from quarry.functions.paths import is_hidden
from quarry.operators.state import SEARCHABLE


def event_filter(events: DataFrame, index_state: DataFrame, ignore_rules: list[str], control: list[str] | None = None) -> DataFrame:
    """Events (corpus, path relative to the root) of searchable corpora that matter: control files
    always, otherwise nothing outside the root, hidden or ignored. Stateless, with one
    stream-static join; adds is_control."""
    p = F.col("path")
    ctl = p.isin(control or X.CONTROL_FILES)
    entry = is_ignored(p, ignore_rules) | is_ignored(F.concat(p, F.lit("/")), ignore_rules)
    keep = F.when(p.isin("", "."), F.lit(True)).when(p.startswith(".."), F.lit(False)).when(ctl, F.lit(True)).otherwise(~is_hidden(p) & ~entry)
    ready = index_state.where(F.col("status").isin(SEARCHABLE)).select("corpus").distinct()
    return events.where(keep).withColumn("is_control", ctl).join(ready, "corpus")


def debounce(events: DataFrame, quiet: str = f"{X.DEBOUNCE_SECONDS} seconds", watermark: str | None = None) -> DataFrame:
    """One sync per burst: a burst of a corpus ends after ``quiet`` without events. Gives the first
    event, the time the sync fires, the number of events and of control-file edits.

    Sessions are merged inside every task before the shuffle, so a busy corpus sends a few
    sessions per task and not its events (``session.build_session`` turns that on). ``watermark`` bounds
    the state of a stream.
    """
    e = events.withWatermark("ts", watermark) if watermark else events
    g = e.groupBy("corpus", F.session_window("ts", quiet).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_control").alias("control_edits"))
    return g.select("corpus", F.col("w.start").alias("first_event"), F.col("w.end").alias("fires_at"), "events", "control_edits")


def throttle(requests: DataFrame, threshold_seconds: float = X.SYNC_THRESHOLD_SECONDS) -> DataFrame:
    """(corpus, request_id, ts, mode, last_sync): a request is synced unless the corpus was synced
    less than the threshold before.

    Decisions of one corpus follow from one another, so they belong to one key; what is kept per
    key is one timestamp. Requests are taken in time order within a trigger, whose size (maxFilesPerTrigger of
    the source) bounds what is sorted; a request that comes a trigger too late is held against the newer sync.
    """
    gap = int(threshold_seconds * 1_000_000)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat([b[["request_id", "at"]] for b in batches]).sort_values(["at", "request_id"], kind="stable")
        at = rows["at"].to_numpy(np.int64)
        due = np.zeros(len(at), dtype=bool)
        if gap <= 0:
            due[:] = True
        else:       # from one sync to the next that is due
            i = 0 if last is None else int(np.searchsorted(at, last + gap))
            while i < len(at):
                due[i] = True
                i = int(np.searchsorted(at, at[i] + gap))
        which = np.maximum.accumulate(np.where(due, np.arange(len(at)), -1))
        lasts = np.where(which >= 0, at[np.maximum(which, 0)], -1 if last is None else last)
        state.update((int(lasts[-1]),))
        yield pd.DataFrame({"corpus": key[0], "request_id": rows["request_id"].to_numpy(), "at": at,
                            "mode": np.where(due, "synced", "skipped_recent"), "last_at": lasts})

    r = requests.select("corpus", "request_id", F.unix_micros("ts").alias("at"))
    types = {f.name: f.dataType.simpleString() for f in r.schema.fields}
    out = r.groupBy("corpus").applyInPandasWithState(
        decide, f"corpus {types['corpus']}, request_id {types['request_id']}, at bigint, mode string, last_at bigint",
        "last bigint", "append", GroupStateTimeout.NoTimeout)
    return out.select("corpus", "request_id", F.timestamp_micros("at").alias("ts"), "mode", F.timestamp_micros("last_at").alias("last_sync"))
