"""Tables: explicit schemas, readers and sinks, and the play-by-play views over the event table."""

from __future__ import annotations

import csv
import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_double = ("time_seconds", "start_x", "start_y", "end_x", "end_y", "minutes_played")
ACTIONS = T.StructType([T.StructField("action_id", T.LongType(), False), *[T.StructField(c, T.StringType()) for c in ("match_id", "player_id", "team_id", "type_name", "result_name", "bodypart_name")], T.StructField("period_id", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in _double], T.StructField("is_home", T.BooleanType())])
TARGETS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("match_id", "player_id", "Date", "birth_date", "Comp", "Squad", "Opponent", "Venue")], T.StructField("xAG", T.DoubleType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed scan; the header decides nothing but the order, which must be the schema's."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A header in each file; as many files as the frame has partitions."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(value: dict, path: str) -> None:
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str))


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def append_ledger(row: dict[str, object], path: str, header: tuple[str, ...]) -> None:
    """One line of an experiment ledger; the header is written with the first."""
    p = Path(path)
    new = not p.exists()
    with p.open("a", newline="") as f:
        out = csv.DictWriter(f, header, extrasaction="ignore")
        if new:
            out.writeheader()
        out.writerow(row)


def write_names(names: list[str], path: str) -> None:
    Path(path).write_text("".join(f"{n}\n" for n in names))


def read_names(path: str) -> list[str]:
    return [n for n in Path(path).read_text().splitlines() if n]


def missing_files(paths: list[str]) -> list[str]:
    return [p for p in paths if not Path(p).exists()]


def split_id(method: str, splits: int, seed: int) -> str:
    return hashlib.md5(f"{method}_{splits}_{seed}".encode()).hexdigest()[:8]


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and a hash of all rows that doesn't depend on their order. Equal rows are counted by their sum."""
    h = F.xxhash64(*df.columns)
    wide = lambda seed: F.sum(F.pmod(F.xxhash64(h, F.lit(seed)), F.lit(1 << 31)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", F.lower(F.hex(F.coalesce(wide(1), F.lit(0)))), F.lower(F.hex(F.coalesce(wide(2), F.lit(0))))).alias("fingerprint"))


def profile(df: DataFrame) -> DataFrame:
    """column, nulls, values: one pass over the table."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)], F.count(F.lit(1)).alias("n"))
    entry = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), (F.col("n") - F.col(f"n{i}")).alias("values")) for i, c in enumerate(df.columns)]
    return one.select(F.inline(F.array(*entry)))


def feature_info(df: DataFrame) -> dict:
    """Number, names, types and missing values of the columns, and the table's shape, as written beside a set of features."""
    found = profile(df).collect()  # one row a column
    return {"n_features": len(df.columns), "features": df.columns, "dtypes": dict(df.dtypes), "missing_counts": {r["column"]: r["nulls"] for r in found}, "shape": [found[0]["nulls"] + found[0]["values"] if found else 0, len(df.columns)]}


# ---- play-by-play views over `events` ----


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event, read as an on-ball action of a match (a day), a player (the user) and a team (the user's parity)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    second = F.hour("ts").cast("long") * 3600 + F.minute("ts") * 60 + F.second("ts")
    place = lambda m, n: F.pmod(F.col("event_id") * m, F.lit(n)).cast("double") / 10.0
    kind = F.when(F.col("event_type").isin("view", "click"), "pass").when(F.col("event_type") == "signup", "carry").when(F.col("event_type") == "error", "cross").otherwise("shot")
    return e.withColumn("sod", second).select(
        F.col("event_id").alias("action_id"), F.col("ts").cast("date").cast("string").alias("match_id"), F.col("user_id").alias("player_id"), (F.col("user_id") % 2).alias("team_id"),
        F.when(F.col("sod") < 43200, 1).otherwise(2).alias("period_id"), ((F.col("sod") % 43200).cast("double") / 16.0).alias("time_seconds"), kind.alias("type_name"),
        F.when(F.col("k") % 3 != 0, "success").otherwise("fail").alias("result_name"),
        place(37, 1051).alias("start_x"), place(53, 681).alias("start_y"), place(71, 1051).alias("end_x"), place(89, 681).alias("end_y"),
        (F.col("user_id") % 2 == 0).alias("is_home"), (15 + F.col("user_id") % 76).alias("minutes_played"),
        F.when(F.col("k") % 4 == 0, "head").when(F.col("k") % 4 == 1, "left_foot").otherwise("right_foot").alias("bodypart_name"),
    )


def targets(of: DataFrame) -> DataFrame:
    """A target for each match and player of four in five players, with fold, squad, opponent and league."""
    shots: Column = F.sum(F.when(F.col("type_name") == "shot", 1).otherwise(0))
    return of.where("player_id % 5 <> 4").groupBy("match_id", "player_id").agg((shots.cast("double") / 10).alias("xag"), F.min("team_id").alias("squad")).select(
        "match_id", "player_id", "xag", (F.substring("match_id", 9, 2).cast("int") % 5 + 1).alias("fold"), "squad", (1 - F.col("squad")).alias("opponent"), (F.col("player_id") % 3).alias("comp")
    )
