"""Streams with state: late rows on both sides, rows out of order, state that leaves."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import queries as streams
from tidemark.streaming import stateful

KIND = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"


def at(text):
    hours, minutes = text.split(":")
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(hours), minutes=int(minutes))


@pytest.fixture
def fed(spark, tmp_path):
    """A stream of events, one micro-batch for each list of (user, type, time)."""

    def make(*lists):
        (tmp_path / "events.parquet").mkdir()
        number = 0
        for i, rows in enumerate(lists):
            data = []
            for user, kind, when in rows:
                number += 1
                data.append((number, user, kind, at(when), 1.0))
            spark.createDataFrame(data, KIND).coalesce(1).write.parquet(f"{tmp_path}/{i}")
            next((tmp_path / str(i)).glob("part-*")).rename(tmp_path / f"events.parquet/{i}.parquet")
            os.utime(tmp_path / f"events.parquet/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
        return streams.stream(spark, str(tmp_path), "events", files_at_once=1)

    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def state_rows(progress):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_join_of_two_streams(fed, how):
    """Late rows on either side join nothing, late ones in time do, views without purchases come once, state goes."""
    events = fed(
        [(1, "view", "09:00"), (2, "view", "09:10"), (3, "view", "09:20"), (1, "purchase", "09:30"), (None, "view", "09:30"), (None, "purchase", "09:31")],
        [(3, "purchase", "10:20"), (2, "purchase", "10:11"), (1, "purchase", "10:05"), (4, "view", "10:20")],  # 3: on the hour; 2: a minute late
        [(4, "view", "13:00"), (4, "purchase", "13:00")],
        [(9, "click", "13:00")],  # Spark drops rows by the watermark of the batch before
        [(5, "view", "12:40"), (5, "purchase", "12:55"), (6, "view", "12:55"), (7, "purchase", "12:45")],  # behind 12:50 on either side
        [(6, "purchase", "13:20"), (5, "purchase", "13:10"), (7, "view", "13:30")],
        [(8, "view", "18:00"), (8, "purchase", "18:30")],
        [(9, "click", "18:30")],
    )
    found, progress = streams.run(stateful.purchases_after_views(events, how=how), "append", "join-test")
    pairs = [(1, 1, 4), (3, 3, 7), (4, 11, 12), (6, 16, 18), (8, 21, 22)]
    alone = [(None, 5, None), (2, 2, None), (4, 10, None), (7, 20, None)] if how == "left_outer" else []
    assert rows(found, "user_id", "view_id", "purchase_id") == sorted(pairs + alone, key=str)
    assert max(state_rows(progress)) > state_rows(progress)[-1]  # of the last hour: one view and one purchase


def test_sessions_that_a_late_row_joins(fed):
    """Two open sessions of a user become one by a row that comes last; rows behind the watermark are dropped."""
    events = fed([(1, "view", "09:00"), (1, "view", "09:40"), (2, "view", "09:05")], [(1, "view", "09:45"), (1, "view", "09:35"), (1, "view", "09:20")], [(3, "view", "12:00")], [(3, "view", "12:01")], [(1, "view", "09:50"), (1, "view", "11:55")], [(3, "view", "16:00")], [(3, "view", "16:01")])
    found, progress = streams.run(stateful.sessions(events), "append", "sessions-test")
    assert rows(found, "user_id", "start", "n") == sorted([(1, at("09:00"), 5), (2, at("09:05"), 1), (1, at("11:55"), 1), (3, at("12:00"), 2)], key=str)
    assert state_rows(progress)[-1] == 1


def test_visits_leave_the_state_by_their_timers(spark, fed):
    """The same with timers and a map as state, and no state for users without an open visit."""
    events = fed([(1, "view", "09:00"), (1, "click", "16:00"), (2, "view", "09:05"), (None, "odd", "09:00")], [(5, "view", "16:01")], [(1, "view", "12:30")], [(1, "purchase", "15:52"), (1, "view", "15:55")], [(3, "view", "23:00")], [(4, "view", "47:00")], [(4, "view", "47:01")])
    with streams.rocks_db(spark):
        found, progress = streams.run(stateful.visits(events), "append", "visits-test")
    found = found.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("start", "last")})
    # 12:30 is behind the watermark (15:50), and the visit at 09:00 has been given by then
    assert rows(found, "user_id", "start", "last", "n", "n_types") == sorted([(1, at("09:00"), at("09:00"), 1, 1), (2, at("09:05"), at("09:05"), 1, 1), (None, at("09:00"), at("09:00"), 1, 0), (1, at("15:52"), at("16:00"), 3, 3), (3, at("23:00"), at("23:00"), 1, 1), (5, at("16:01"), at("16:01"), 1, 1)], key=str)
    assert state_rows(progress)[-1] < max(state_rows(progress)) and state_rows(progress)[-1] <= 3


def test_a_user_with_many_visits_has_one_row_of_state(spark, fed):
    """All of a user's open visits are one value and one timer; null and NaN values count as 0."""
    events = fed([(1, "view", f"{9 + 7 * i}:00") for i in range(40)], [(2, "view", "400:00")], [(2, "view", "400:01")])
    values = F.expr("CASE WHEN hour(ts) % 3 = 0 THEN null WHEN hour(ts) % 3 = 1 THEN double('NaN') ELSE value END")
    with streams.rocks_db(spark):
        found, progress = streams.run(stateful.visits(events.withColumn("value", values)), "append", "visits-many")
    assert rows(found, "user_id", "start", "n", "total") == sorted([(1, (9 + 7 * i) * 3_600_000_000 + 1_704_067_200_000_000, 1, float((9 + 7 * i) % 24 % 3 == 2)) for i in range(40)], key=str)
    assert max(state_rows(progress)) <= 5  # 40 visits in a map were 40 and as many timers, by two orders


def test_joined_visits_in_any_order():
    spans = [(i * 5, i * 5, 1, 1.0, 1 << i % 3) for i in (4, 0, 2, 1, 9, 3)]
    once = stateful._joined(spans, 6)
    for cut in range(7):
        assert stateful._joined(stateful._joined(spans[:cut], 6) + spans[cut:], 6) == once
    assert [s[:3] for s in once] == [(0, 20, 5), (45, 45, 1)]


def test_first_seen_again_after_a_day(spark, fed):
    """A type that was away for a day is new; idle users leave the state, which changes no result."""
    events = fed([(1, "view", "09:00"), (1, "view", "09:10"), (1, "click", "09:20"), (2, None, "09:00"), (3, "view", "09:00")], [(1, "view", "09:05"), (2, "view", "09:30")], [(2, "view", "33:29"), (1, "view", "33:10")], [(1, "click", "40:00")], [(4, "view", "90:00")], [(4, "view", "90:01")])
    with streams.rocks_db(spark):
        found, progress = streams.run(stateful.first_seen(events), "append", "first-seen-test")
    assert rows(found, "user_id", "event_type", "event_id") == sorted([(1, "click", 3), (1, "view", 1), (2, "view", 7), (3, "view", 5), (1, "view", 9), (1, "click", 10), (4, "view", 11)], key=str)
    assert state_rows(progress)[-1] < max(state_rows(progress))


def test_repeats_within_the_watermark(spark, fed):
    events = fed([(1, "view", "09:00"), (1, "view", "09:01")], [(1, "view", "09:05"), (2, "view", "09:02")], [(3, "view", "11:00")], [(3, "view", "11:01")], [(1, "view", "11:02")], [(3, "view", "11:02")])
    found, progress = streams.run(stateful.without_repeats(events, ("user_id",)), "append", "repeats-test")
    assert rows(found, "user_id", "event_id") in ([(1, 1), (1, 7), (2, 4), (3, 5)], [(1, 2), (1, 7), (2, 4), (3, 5)])
    assert state_rows(progress)[-1] == 2


def test_empty_streams(spark, fed):
    events = fed([])
    assert streams.written(stateful.sessions(events), "append", "empty").count() == 0
    assert streams.written(stateful.purchases_after_views(events), "append", "empty").count() == 0
    with streams.rocks_db(spark):
        assert streams.written(stateful.visits(events), "append", "empty").count() == 0
