"""Possessions and following actions of a stream: actions of a match are held until the watermark has passed them, put in order, numbered,
and given out once enough later ones are known. A session window can't do this, as a possession also ends with a change of team or
a failure.

Actions may come in any order and in any micro-batches, so long as none is later than `delay`; those that are, Spark leaves out
and counts (numRowsDroppedByWatermark). Event time must not fall along (period, time, action id) within a match. A match ends when
the watermark is `close_after` past its last action: its last rows are given out without the neighbours that never came, and
its state goes; what comes later still begins a match anew. Actions without an event time or a match can't be placed
and are left out; other columns may be null, as in the batch. Repeated actions are numbered each.

State of a match: the actions of the last `delay`, up to `ahead` numbered ones, and one row; it doesn't grow with the match. Needs
the RocksDB state store (STORE)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldloom.operators.sequence import NEIGHBOUR, ORDER

#: The setting that the operator needs, and its value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = ("action_id", "player_id", "team_id", "period_id", "time_seconds", "type_name", "result_name")
SHOWN = ("type", "team")
_AT, _NUMBERS = "at_ms", ("possession_no", "possession_step")


def _place(row: Row) -> tuple:
    """The place in a match, nulls first as in Spark's order."""
    return tuple((row[c] is not None, row[c] if row[c] is not None else 0) for c in ORDER)


class Possessions(StatefulProcessor):
    """held: actions that an earlier one may still precede; waiting: numbered ones that lack later neighbours; last: what the next
    action is compared with."""

    def __init__(self, types: dict[str, T.DataType], most_gap: float, ahead: int, close_ms: int):
        self.most_gap, self.ahead, self.close_ms = most_gap, ahead, close_ms
        fields = [T.StructField(c, types[c]) for c in COLUMNS]
        self.held_schema = T.StructType([*fields, T.StructField(_AT, T.LongType())])
        self.waiting_schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in _NUMBERS]])
        self.last_schema = T.StructType([T.StructField("team", T.StringType()), T.StructField("result", T.StringType()), T.StructField("time", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in (*_NUMBERS, _AT)]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.last = handle.getValueState("last", self.last_schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        new = [tuple(r[c] for c in (*COLUMNS, _AT)) for r in rows]
        if new:
            self.held.appendList(new)
            self.handle.registerTimer(min(r[-1] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = [Row(*self.held_schema.names)(*r) for r in self.held.get()]
        ready, later = [r for r in held if r[_AT] <= until], [tuple(r) for r in held if r[_AT] > until]
        waiting = [Row(*self.waiting_schema.names)(*r) for r in self.waiting.get()]
        last = tuple(self.last.get()) if self.last.exists() else (None, None, 0.0, 0, 0, 0)
        for r in sorted(ready, key=_place):
            last = self._after(last, r)
            waiting.append(Row(*self.waiting_schema.names)(*[r[c] for c in COLUMNS], last[3], last[4]))
        closes = last[5] + self.close_ms
        ended = not later and until >= closes
        done = len(waiting) if ended else max(len(waiting) - self.ahead, 0)
        out = [self._shown(key[0], waiting, i) for i in range(done)]
        self.held.put(later) if later else self.held.clear()
        if ended:
            self.waiting.clear()
            self.last.clear()
            return iter(out)
        rest = [tuple(r) for r in waiting[done:]]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.last.update(last)
        self.handle.registerTimer(min([r[-1] for r in later], default=closes))
        return iter(out)

    def _after(self, last: tuple, r: Row) -> tuple:
        """last as it is after the action r."""
        team, time = "unknown_team" if r["team_id"] is None else str(r["team_id"]), float(r["time_seconds"] or 0.0)
        held = team == last[0] and last[1] == "success" and time - last[2] <= self.most_gap
        return (team, r["result_name"], time, *((last[3], last[4] + 1) if held else (last[3] + 1, 1)), max(last[5], r[_AT]))

    def _shown(self, match: Any, rows: list[Row], i: int) -> Row:
        following = [rows[j][NEIGHBOUR[k]] if j < len(rows) else None for j in range(i + 1, i + 1 + self.ahead) for k in SHOWN]
        return Row(match_id=match, **{c: rows[i][c] for c in (*COLUMNS, *_NUMBERS)}, **dict(zip(self.names, following, strict=True)))

    @property
    def names(self) -> list[str]:
        return [f"{k}_{j}" for j in range(1, self.ahead + 1) for k in SHOWN]


def possession_stream(actions: DataFrame, event_time: str, delay: str = "10 minutes", most_gap: float = 15.0, ahead: int = 3, close_after: float = 4 * 3600.0) -> DataFrame:
    """Each action with possession_no and possession_step, by the rules of operators.windows.with_possessions, and type_1, team_1, ... of
    the next `ahead` actions of the match, as operators.sequence.with_neighbours gives them. event_time: a column of timestamps."""
    if actions.sparkSession.conf.get(*STORE[:1], "") != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    types = {f.name: f.dataType for f in actions.schema}
    timed = actions.where(F.col(event_time).isNotNull() & F.col("match_id").isNotNull()).withWatermark(event_time, delay)
    rows = timed.select("match_id", *COLUMNS, event_time, F.unix_millis(event_time).alias(_AT))
    processor = Possessions(types, most_gap, ahead, int(close_after * 1000))
    shown = [T.StructField(name, types[NEIGHBOUR[name.split("_")[0]]]) for name in processor.names]
    out = T.StructType([T.StructField("match_id", types["match_id"]), *[T.StructField(c, types[c]) for c in COLUMNS], *[T.StructField(c, T.LongType()) for c in _NUMBERS], *shown])
    return rows.groupBy("match_id").transformWithState(processor, out, "Append", "EventTime")
