"""Streams with state that leaves: joins of two streams, sessions, duplicates, visits and first events by timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.queries import LATE, rocks_db, stream, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


# two streams


def purchases_after_views(events: DataFrame, within: str = "1 hour", late: str = LATE, how: str = "left_outer") -> DataFrame:
    """(user_id, view_id, viewed, purchase_id, bought): views with the purchases of the same user from the view's time to
    `within` after it. how: inner, left_outer (views without any come once, with nulls) or left_semi.

    Both sides are kept as state until the watermarks (`late` behind the latest times of views and of purchases, the
    earlier of the two) and the bound of time show that nothing can join any more; so the state is what an hour and the
    lateness hold, not the stream. Rows behind the watermark are dropped on either side. A view without purchases is given
    when the watermark has passed its last possible one. Null users join nothing."""
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed")).withWatermark("viewed", late)
    buys = events.where("event_type = 'purchase'").select(F.col("user_id").alias("_buyer"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought")).withWatermark("bought", late)
    soon = F.expr(f"user_id = _buyer AND bought >= viewed AND bought <= viewed + INTERVAL {within}")
    return views.join(buys, soon, how).drop("_buyer")


def _plain_times(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


_PAIRS = "v.user_id, v.event_id AS view_id, v.ts AS viewed, p.event_id AS purchase_id, p.ts AS bought FROM (SELECT * FROM events WHERE event_type = 'view') v"
_SOON = "(SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR"


@query(f"SELECT {_PAIRS} JOIN {_SOON}")
def stream_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each view with each purchase of its user within the hour."""
    found = written(purchases_after_views(stream(spark, folder, "events"), how="inner"), "append", "stream-join")
    return _plain_times(found.drop("batch"), "viewed", "bought")


@query(f"""SELECT {_PAIRS} LEFT JOIN {_SOON} WHERE p.event_id IS NOT NULL
OR v.ts + INTERVAL 1 HOUR <= (SELECT least(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'purchase')) FROM events) - INTERVAL {LATE}""")
def stream_join_outer(spark: SparkSession, folder: str) -> DataFrame:
    """The same, and the views without purchases whose hour the watermark has passed at the end of the input."""
    found = written(purchases_after_views(stream(spark, folder, "events")), "append", "stream-join-outer")
    return _plain_times(found.drop("batch"), "viewed", "bought")


# sessions and duplicates


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(user_id, start, stop, n) of each session, once, when the watermark has passed its end (its last event and `gap`).
    Open sessions are the state; rows that arrive out of order can join two of them."""
    made = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def without_repeats(events: DataFrame, by: Iterable[str] = ("event_id",), late: str = LATE) -> DataFrame:
    """The first row of each key to arrive. A key is remembered until the watermark is `late` past it, so repeats within
    that time never pass, and the state is what that time holds."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(by))


_SESSIONS = """SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP AS last, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT event_type) AS n_types FROM
(SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL {gap} > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
_ENDED = f"<= (SELECT max(ts) FROM events) - INTERVAL {LATE}"


@query(f"SELECT user_id, start, last + INTERVAL 30 MINUTE AS stop, n FROM ({_SESSIONS.format(gap='30 MINUTE')}) WHERE last + INTERVAL 30 MINUTE {_ENDED}")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = written(sessions(stream(spark, folder, "events")), "append", "sessions")
    return _plain_times(found.drop("batch"), "start", "stop")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a stream in which each one comes twice."""
    twice = stream(spark, folder, "events").unionByName(stream(spark, folder, "events"))
    return written(without_repeats(twice), "append", "without-repeats").select("event_id", "user_id", "event_type", "value")


# state with timers


def _joined(spans: list[tuple], gap: int) -> list[tuple]:
    """Spans (start, stop, n, total, types) less than gap apart, as one each."""
    out: list[tuple] = []
    for span in sorted(spans):
        if out and span[0] < out[-1][1] + gap:
            a, b, n, total, types = out[-1]
            out[-1] = (a, max(b, span[1]), n + span[2], total + span[3], types | span[4])
        else:
            out.append(span)
    return out


class Visits(StatefulProcessor):
    """A user's visits: events less than `gap` microseconds apart. A user's open visits are one value of the state, as
    arrays in the order of their starts, with one timer at the earliest end; when the watermark reaches that, all visits
    that it has passed are given and leave the state. So a user costs a few calls of the state in a micro-batch, whatever
    the number of visits; a user without open visits has no state. Rows of any order give the same visits, since visits
    that a row joins become one."""

    def __init__(self, gap: int, kinds: list[str]) -> None:
        self.gap, self.kinds = gap, {kind: 1 << i for i, kind in enumerate(kinds)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start array<long>, stop array<long>, n array<long>, total array<double>, types array<long>")

    def _end(self, stop: int) -> int:
        return -(-(stop + self.gap) // 1000)  # timers are in milliseconds

    def _spans(self) -> list[tuple]:
        state = self.open.get()
        return list(zip(*state, strict=True)) if state else []

    def _keep(self, spans: list[tuple]) -> None:
        """Makes spans the state, with a timer at the earliest end. The timers before are gone."""
        if spans:
            self.open.update(tuple(list(column) for column in zip(*spans, strict=True)))
            self.handle.registerTimer(min(self._end(stop) for _, stop, *_ in spans))
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._spans()
        spans = before
        for frame in rows:
            at, value, kinds = frame["at"].to_numpy(), frame["value"].to_numpy(dtype=np.float64, na_value=0.0), frame["event_type"].tolist()
            order = np.argsort(at, kind="stable")
            at, value, types = at[order], value[order], np.array([self.kinds.get(kind, 0) for kind in kinds], np.int64)[order]
            first = np.flatnonzero(np.r_[True, np.diff(at) >= self.gap])
            last = np.r_[first[1:], len(at)]
            own = zip(at[first].tolist(), at[last - 1].tolist(), (last - first).tolist(), np.add.reduceat(value, first).tolist(), np.bitwise_or.reduceat(types, first).tolist(), strict=True)
            spans = _joined(spans + list(own), self.gap)
        if before:
            self.handle.deleteTimer(min(self._end(stop) for _, stop, *_ in before))
        self._keep(spans)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        done, still = [], []
        for span in self._spans():
            (done if self._end(span[1]) <= now else still).append(span)
        self._keep(still)
        if done:
            start, stop, n, total, types = zip(*done, strict=True)
            yield pd.DataFrame({"user_id": [key[0]] * len(done), "start": start, "last": stop, "n": n, "total": total, "n_types": [t.bit_count() for t in types]})

    def close(self) -> None:
        pass


KINDS = ("click", "error", "purchase", "signup", "view")


def visits(events: DataFrame, gap_hours: float = 6.0, late: str = LATE, kinds: Iterable[str] = KINDS) -> DataFrame:
    """(user_id, start, last, n, total, n_types), in microseconds, of each visit (events less than gap_hours apart), once,
    when the watermark is gap_hours past its last event. n_types counts the different event types among `kinds`, at most
    63. Rows behind the watermark are dropped; null values count as 0, rows without a user are one user."""
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_type", "value")
    processor = Visits(int(gap_hours * 3_600_000_000), list(kinds))
    return rows.groupBy("user_id").transformWithStateInPandas(processor, "user_id long, start long, last long, n long, total double, n_types long", "Append", "EventTime")


@query(f"SELECT user_id, start, last, n, total, n_types FROM ({_SESSIONS.format(gap='6 HOUR')}) WHERE last + INTERVAL 6 HOUR {_ENDED}")
def stream_visits(spark: SparkSession, folder: str) -> DataFrame:
    with rocks_db(spark):
        found = written(visits(stream(spark, folder, "events")), "append", "visits")
    times = {c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("start", "last")}
    return found.withColumns(times).select("user_id", "start", "last", "n", F.round("total", 4).alias("total"), "n_types")


class FirstSeen(StatefulProcessor):
    """The first event of each type of a user. A type that wasn't seen for `idle` microseconds counts as new; by then its
    entry has left the map, by a timer for the user's earliest one."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "event_type string", "at long")

    def _wake(self, last: dict[str, int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last:
            self.handle.registerTimer(-(-(min(last.values()) + self.idle) // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = {kind[0]: at[0] for kind, at in self.seen.iterator()}
        first = []
        for at, event, kind in sorted(row for frame in rows for row in zip(frame["at"].tolist(), frame["event_id"].tolist(), frame["event_type"].tolist(), strict=True)):
            if kind not in last or at >= last[kind] + self.idle:
                first.append((kind, event))
            last[kind] = max(at, last.get(kind, at))
        for kind, at in last.items():
            self.seen.updateValue((kind,), (at,))
        self._wake(last)
        if first:
            yield pd.DataFrame({"user_id": [key[0]] * len(first), "event_type": [k for k, _ in first], "event_id": [e for _, e in first]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        last = {kind[0]: at[0] for kind, at in self.seen.iterator()}
        for kind in [k for k, at in last.items() if at + self.idle <= now]:
            self.seen.removeKey((kind,))
            del last[kind]
        self._wake(last)
        yield from ()

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, idle_hours: float = 24.0, late: str = LATE) -> DataFrame:
    """(user_id, event_type, event_id) of a user's events of a type that wasn't seen for idle_hours before, by time and id
    within a micro-batch, whose rows of one user are sorted in memory. Rows without a type or an id are left out, those
    behind the watermark are dropped. The state is a row for each type that users had in the last idle_hours."""
    rows = events.withWatermark("ts", late).where("event_type IS NOT NULL AND event_id IS NOT NULL").select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_type", "event_id")
    return rows.groupBy("user_id").transformWithStateInPandas(FirstSeen(int(idle_hours * 3_600_000_000)), "user_id long, event_type string, event_id long", "Append", "EventTime")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts >= before + INTERVAL 24 HOUR")
def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    with rocks_db(spark):
        return written(first_seen(stream(spark, folder, "events")), "append", "first-seen").drop("batch")
