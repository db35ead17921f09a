from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom.sources.stages import Stages


def _run(spark, folder, made, rate=1, most=100, version="1", fail=False):
    """Three tables: the second needs the first, the third only the files. Says what was made."""

    def first(path, rate):
        made.append("first")
        return spark.read.parquet(path).select((F.col("id") * rate).alias("v"))

    def second(table, most):
        made.append("second")
        return table.where(F.col("v") < most) if not fail else table.select(F.raise_error(F.lit("stopped")).alias("v"))

    def third(path):
        made.append("third")
        return spark.read.parquet(path).groupBy().count()

    stages = Stages(spark, str(folder / "kept"), version)
    a = stages.keep("first", first, str(folder / "in"), rate=rate)
    c = stages.keep("third", third, str(folder / "in"))
    b = stages.keep("second", second, a, most=most)
    return stages, a, b, c


@pytest.fixture
def folder(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    return tmp_path


def test_only_what_depends_on_a_change_is_made_again(spark, folder):
    made = []
    _, a, b, c = _run(spark, folder, made)
    assert made == ["first", "third", "second"] and not (a.reused or b.reused or c.reused) and b.table.count() == 50
    made.clear()
    _, _, b, _ = _run(spark, folder, made)
    assert made == [] and b.reused and b.table.count() == 50
    _run(spark, folder, made, most=10)
    assert made == ["second"]
    made.clear()
    assert _run(spark, folder, made, rate=3)[2].table.agg(F.max("v")).first()[0] == 99 and made == ["first", "second"]
    made.clear()
    _run(spark, folder, made, version="2")
    assert made == ["first", "third", "second"]


def test_changed_files_change_all(spark, folder):
    made = []
    _run(spark, folder, made)
    spark.range(7).write.mode("append").parquet(str(folder / "in"))
    made.clear()
    assert _run(spark, folder, made)[3].table.first()[0] == 57 and made == ["first", "third", "second"]


def test_a_stopped_run_goes_on(spark, folder):
    made = []
    with pytest.raises(Exception, match="stopped"):
        _run(spark, folder, made, fail=True)
    assert any(p.name.startswith(".second") for p in (folder / "kept").iterdir())
    made.clear()
    stages, _, b, _ = _run(spark, folder, made)
    assert made == ["second"] and b.table.count() == 50
    _run(spark, folder, made, most=1)
    gone = stages.drop_unused()
    assert len(gone) == 2 and sum(n.startswith(".second") for n in gone) == 1 and len(list((folder / "kept").iterdir())) == 3
    made.clear()
    assert _run(spark, folder, made)[2].reused and made == []


def test_an_empty_table_is_kept(spark, folder):
    made = []
    _run(spark, folder, made, most=-1)
    made.clear()
    assert _run(spark, folder, made, most=-1)[2].table.count() == 0 and made == []
