from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldloom.operators.sequence import with_neighbours
from fieldloom.operators.windows import with_possessions
from fieldloom.streaming.possessions import STORE, possession_stream

SCHEMA = "match_id string, action_id long, player_id long, team_id long, period_id int, time_seconds double, type_name string, result_name string, at timestamp"
START = datetime(2024, 5, 1, 12)
AFTER = [("end", 0, None, None, 1, 0.0, None, None, START + timedelta(days=2))]


@pytest.fixture
def rocks(spark):
    spark.conf.set(*STORE)
    yield spark
    spark.conf.unset(STORE[0])


def _match(name: str, n: int, seed: int, begin: datetime = START) -> list[tuple]:
    """Actions about four seconds apart, in order, with nulls and ids beyond what a double holds."""
    dice = random.Random(seed)
    rows, time = [], 0.0
    for i in range(n):
        time += dice.choice((0.0, 1.0, 3.0, 20.0))
        rows.append((name, (1 << 60) + i, dice.choice((1, 2, None)), dice.choice((7, 7, 7, 8, None)), 1, time, dice.choice(("pass", "shot", None)), dice.choice(("success", "success", "success", "fail", None)), begin + timedelta(seconds=time)))
    return rows


def _run(spark, tmp_path, batches: list[list[tuple]], **how) -> tuple[list, int]:
    """All rows that the stream gives out for the batches, one after the other, and the number of late ones."""
    late = 0
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = possession_stream(stream, "at", most_gap=15.0, ahead=2, **how).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        late += sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    got = spark.read.parquet(str(tmp_path / "out"))
    return sorted(map(tuple, got.where("match_id <> 'end'").collect()), key=str), late


def _batch(spark, rows: list[tuple]) -> list:
    a = with_possessions(with_neighbours(spark.createDataFrame(rows, SCHEMA), 2, columns=("type", "team")), 15.0)
    wanted = "match_id action_id player_id team_id period_id time_seconds type_name result_name possession_no possession_step type_1 team_1 type_2 team_2".split()
    return sorted(map(tuple, a.select(*wanted).withColumns({c: F.col(c).cast("long") for c in ("possession_no", "possession_step")}).collect()), key=str)


def test_shuffled_batches_give_the_batch_result(rocks, tmp_path):
    rows = _match("a", 90, 1) + _match("b", 60, 2) + _match("c", 1, 3)
    mixed = sorted(rows, key=lambda r: r[-1].timestamp() + random.Random(r[1]).uniform(0, 200))  # up to 200 s out of order
    random.Random(5).shuffle(mixed[:40])
    cut = len(mixed) // 3
    got, late = _run(rocks, tmp_path, [mixed[:cut], mixed[cut : 2 * cut], mixed[2 * cut :], AFTER], delay="5 minutes")
    assert late == 0 and got == _batch(rocks, rows)


def test_late_actions_are_counted_and_others_stay_right(rocks, tmp_path):
    rows = _match("a", 60, 4)
    late_rows = [rows[2], rows[3]]
    rest = [r for r in rows if r not in late_rows]
    got, late = _run(rocks, tmp_path, [rest, [("x", 1, 1, 7, 1, 0.0, "pass", "success", rows[-1][-1] + timedelta(hours=1))], late_rows, AFTER], delay="1 minute", close_after=7200.0)
    assert late == 2 and [r for r in got if r[0] == "a"] == _batch(rocks, rest)


def test_a_match_closes_and_begins_anew(rocks, tmp_path):
    first, second = _match("a", 5, 6), _match("a", 5, 7, START + timedelta(hours=9))
    got, _ = _run(rocks, tmp_path, [first, [("x", 1, 1, 7, 1, 0.0, "pass", "success", START + timedelta(hours=8))], second, AFTER], delay="1 minute")
    assert sorted(r for r in map(str, got) if r.startswith("('a'")) == sorted(map(str, _batch(rocks, first) + _batch(rocks, second)))


def test_rows_without_time_or_match_and_the_store(rocks, tmp_path):
    rows = _match("a", 6, 8)
    odd = [(None, *rows[0][1:]), (*rows[0][:-1], None)]
    got, _ = _run(rocks, tmp_path, [rows + odd, AFTER])
    assert got == _batch(rocks, rows)
    rocks.conf.unset(STORE[0])
    with pytest.raises(ValueError, match="stateStore"):
        possession_stream(rocks.createDataFrame([], SCHEMA), "at")
