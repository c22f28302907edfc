"""Streams: what the batch operators do to tables, done to what arrives.

Inputs carry event time; watermarks bound state. Every stream has a batch operator that
gives the same rows over the same input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.maintenance import STRIKES
from ..sources import polls


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Event time must be a zoned timestamp to carry a watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def daily_counts(events: DataFrame, time: str = "ts", key: str = "event_type", late: str = "2 days") -> DataFrame:
    """(day, key, n): daily windows that rows up to ``late`` late still reach."""
    counts = _timed(events, time, late).groupBy(F.window(time, "1 day"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), key, "n")


def visits(events: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = "2 days") -> DataFrame:
    """(user_id, started, ended, n): session windows by inactivity."""
    sessions = _timed(events, time, late).groupBy("user_id", F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def unique_jobs(jobs: DataFrame, keys: list[str], time: str = "ts", window: str = "15 minutes") -> DataFrame:
    """One job of each key per ``window``: repeats that arrive inside it are dropped."""
    return _timed(jobs, time, window).dropDuplicatesWithinWatermark(keys)


class _Outcomes(StatefulProcessor):
    """The fold of ``polls.fetch_step`` with its state kept between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("source", "errors int, until long, etag string, last_modified string, content_hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        out: list = []
        state = tuple(self.state.get()) if self.state.exists() else polls._START
        # A source's fetches of one batch.
        state = polls._fold(pd.concat(list(rows)).sort_values(["micros", "fetch_id"]), state, out)
        self.state.update(state)
        yield polls._outcomes(out)

    def close(self) -> None:
        pass


def fetch_outcomes(fetches: DataFrame) -> DataFrame:
    """What ``polls.fetch_outcomes`` gives, fetch by fetch as they arrive. State: five values per source."""
    log = polls.prepared_log(fetches).where("source_id IS NOT NULL AND micros IS NOT NULL")
    return polls.readable(log.groupBy("source_id").transformWithStateInPandas(_Outcomes(), polls.OUTCOMES, "append", "none"))


CHANGED = "source_id long, poll long, body string, content_hash string"


class _Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self.last.get()[0] if self.last.exists() else None
        found = pd.concat(list(rows)).sort_values("poll")
        changed = found[found["content_hash"] != found["content_hash"].shift(1, fill_value=before or "")]
        self.last.update((found["content_hash"].iloc[-1],))
        yield changed

    def close(self) -> None:
        pass


def changed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Polls (source_id, poll, body) whose hash differs from the one before of their source. State: one hash per source."""
    hashed = snapshots.select("source_id", "poll", "body", F.sha2(F.coalesce("body", F.lit("")), 256).alias("content_hash"))
    return hashed.groupBy("source_id").transformWithStateInPandas(_Changes(), CHANGED, "append", "none")


MISSED = "source_id long, external_id string, missing_count int, closed boolean"


class _Absences(StatefulProcessor):
    """Misses of each open posting, one map entry each: a poll rewrites only the entries that it changes."""

    def __init__(self, strikes: int):
        self.strikes = strikes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.missing = handle.getMapState("missing", "external_id string", "misses int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        for _, board in sorted(pd.concat(list(rows)).groupby("poll")):
            seen = set(board["external_id"].dropna())
            for (name,), (misses,) in list(self.missing.iterator()):
                if name in seen:
                    continue
                closed = misses + 1 >= self.strikes
                out.append((key[0], name, misses + 1, closed))
                if closed:
                    self.missing.removeKey((name,))
                else:
                    self.missing.updateValue((name,), (misses + 1,))
            for name in seen:
                self.missing.updateValue((name,), (0,))
        yield pd.DataFrame(out, columns=["source_id", "external_id", "missing_count", "closed"])

    def close(self) -> None:
        pass


def absences(boards: DataFrame, strikes: int = STRIKES) -> DataFrame:
    """Postings that a poll of their source (source_id, poll, external_id) did not show, with their misses in a row.

    A poll without postings is one row with a null external_id. State: a map of a source's open postings,
    which a board bounds.
    """
    return boards.groupBy("source_id").transformWithStateInPandas(_Absences(strikes), MISSED, "append", "none")


class _FirstDates(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.date = handle.getValueState("date", "posted_at timestamp", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        polls_ = pd.concat(list(rows)).sort_values("seen_at")
        known = self.date.exists()
        date = self.date.get()[0] if known else polls_["posted_at"].iloc[0]
        # Written again at every poll: the time to live counts from the last one.
        self.date.update((date,))
        if not known:
            yield pd.DataFrame([(*key, date)], columns=["source_id", "external_id", "posted_at"])

    def close(self) -> None:
        pass


def first_dates(seen: DataFrame, forget_days: int = 90) -> DataFrame:
    """(source_id, external_id, posted_at): each posting's first date that is no estimate, once; later edits don't move it.

    State: one date per posting that a poll showed in the last ``forget_days`` days.
    """
    real = seen.where(~F.col("posted_at_is_estimate") & F.col("posted_at").isNotNull()).select("source_id", "external_id", "seen_at", F.col("posted_at").cast("timestamp").alias("posted_at"))
    dates = real.groupBy("source_id", "external_id").transformWithStateInPandas(_FirstDates(forget_days * 86_400_000), "source_id long, external_id string, posted_at timestamp", "append", "processingTime")
    return dates.withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch overwrites its own folder, so a repeated batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
