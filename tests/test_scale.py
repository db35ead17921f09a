"""Steps whose work must grow no faster than their input."""

from __future__ import annotations

import time

import numpy as np
import pytest

from fieldloom.models import boosting
from fieldloom.models.boosting import How, Loss, Wanted
from fieldloom.operators import network, selection
from tests.test_boosting import NAMES, made, table


def test_paths_of_many_levels_cost_their_own_edges_alone():
    n, own = 20_000, np.arange(0, 8)
    begun = time.perf_counter()
    lean, reach, far = network.hop_measures(np.arange(n - 1), np.arange(1, n), n, own)
    assert time.perf_counter() - begun < 20  # all edges at each of 20,000 levels took minutes
    at = np.arange(n)
    before = np.minimum(at, len(own))
    assert (reach == before).all() and (lean == before * (n - 1 - at)).all()
    assert (far == [sum(max(i - s, 0) for s in own) for i in range(n)]).all()


def test_one_walk_serves_all_sources_bound_to_its_root(spark, monkeypatch):
    rng = np.random.default_rng(2)
    for n in [*range(2, 25), 6]:
        e = np.unique(rng.integers(0, n, 2 * n) * n + rng.integers(0, n, 2 * n)) if n % 3 else np.append(np.arange(n) * n + (np.arange(n) + 1) % n, 2)  # a ring with a way across
        e = e if n != 6 else np.arange(6) * 6 + np.array([1, 2, 0, 0, 3, 1])  # a ring alone, and what leads there
        src, dst = e // n, e % n
        src, dst = src[src != dst], dst[src != dst]
        tails = network.Tails.of(src, dst, n)
        roots = np.flatnonzero(tails.root == np.arange(n))
        got = [sum(x) for x in zip(*(network.tail_measures(src, dst, n, tails, p) for p in (roots[::2], roots[1::2]) if len(p)), strict=True)]
        for a, b in zip(network.hop_measures(src, dst, n, np.arange(n)), got, strict=True):
            assert a == pytest.approx(b)
    walks, real = [], network._walked
    monkeypatch.setattr(network, "_walked", lambda *a: walks.append(len(a[3])) or real(*a))
    n = 300
    line = network.Tails.of(np.arange(n - 1), np.arange(1, n), n)
    network.tail_measures(np.arange(n - 1), np.arange(1, n), n, line, np.flatnonzero(line.root == np.arange(n)))
    assert walks == [1]  # not one a node


def test_a_graph_moves_in_few_rows(spark, monkeypatch):
    e = {(int(a), int(b)) for a, b in np.random.default_rng(4).integers(0, 400, (1600, 2))}
    df = spark.createDataFrame([("m", 0, a, b, 1) for a, b in e], "match_id string, team_id long, src long, dst long, weight long")
    rows, real = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda df, *a: rows.append(df) or real(df, *a))
    monkeypatch.setattr(network, "PATH_SOURCES", 1)
    out = network.hop_centrality(df)
    assert out.count() == len({x for p in e for x in p})
    sizes = [len(r["src"]) + len(r["dst"]) for r in rows[0].collect()]
    assert len(sizes) <= 16 and max(sizes) <= 8 * len(e)  # a row a block of sources, sixteen bytes an edge, grew with the square of the graph


def test_percentiles_of_many_columns(spark, monkeypatch):
    monkeypatch.setattr(selection, "POINTS", 7)
    monkeypatch.setattr(selection, "CHUNK", 50)
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(0, 1, 900), rng.integers(0, 3, 900), np.full(900, 0.1), rng.exponential(1, 900).round(1)], 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(5)
    shares = [0.0, *[i / 16 for i in range(1, 16)], 0.999, 1.0]

    def values(batch):
        for i in range(4):
            yield i, batch.column(i).to_numpy()

    found = selection.exact_percentiles(df, values, shares)
    for i in range(4):
        assert found[i] == pytest.approx(np.quantile(x[:, i], shares), abs=1e-12)
    assert selection.exact_percentiles(df.where("a > 99"), values, shares) == {}


def test_fits_side_by_side_share_their_passes(spark, monkeypatch):
    df = table(spark, *made()).cache()
    wanted = [Wanted("y", Loss("squared"), How(rounds=3, depth=3, bins=16, least_rows=5, patience=1, rate=0.5), "w"), Wanted("y", Loss("tweedie", 1.5), How(rounds=5, depth=2, bins=16, least_rows=5, row_share=0.8, feature_share=0.5), "w"), Wanted("y", Loss("quantile", 0.7), How(rounds=2, depth=3, bins=16, least_rows=5, monotone={"c": 1}), None, NAMES[1:])]
    passes = []
    real = boosting._Fit.splits
    monkeypatch.setattr(boosting._Fit, "splits", lambda self, state: passes.append(1) or real(self, state))
    together = boosting.fit_all(df, NAMES, (1, 2, 3), ("id",), wanted)
    assert len(passes) <= 3 * 3 + 2 * 2
    x = made()[0]
    for want, one in zip(wanted, together, strict=True):
        of = list(want.features or NAMES)
        alone = boosting.fit(df, of, "y", (1, 2, 3), ("id",), want.loss, want.how, want.weight)
        assert one.features == of and one.best == alone.best and one.starts == pytest.approx(alone.starts)
        at = [NAMES.index(f) for f in of]
        assert one.scores(x[:, at]) == pytest.approx(alone.scores(x[:, at]))


def test_ordered_target_reads_its_rows_from_a_written_table(spark, small):
    from fieldloom.plans.catalog import QUERIES

    assert not [f for f in QUERIES["ordered_target"](spark, small).inputFiles() if "events.parquet" in f]


def test_fused_blocks_are_summed_by_hash(spark, small):
    from fieldloom.plans.catalog import KINDS, prepared
    from fieldloom.plans.full import fused_blocks
    from fieldloom.plans.fusion import fuse

    plan = fuse(prepared(spark, small), fused_blocks(KINDS, value=False))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Window [") == 1


def counted_passes(monkeypatch) -> list:
    passes, real = [], boosting._Fit.splits
    monkeypatch.setattr(boosting._Fit, "splits", lambda self, state: passes.append(len(self.models)) or real(self, state))
    return passes


def test_a_pass_over_a_groups_actions_serves_all_folds(spark, monkeypatch):
    from fieldloom.models import trees

    rng, passes = np.random.default_rng(5), counted_passes(monkeypatch)
    rows = [(i, "pass" if i % 3 else "cross", i % 4 + 1, float(x), "success" if rng.random() < 1 / (1 + np.exp(-3 * x)) else "fail") for i, x in enumerate(rng.normal(0, 1, 400))]
    df = spark.createDataFrame(rows, "action_id long, `group` string, fold int, x double, result_name string")
    out = trees.success_probability(df, ["x"], ["pass", "cross"], (1, 2, 3, 4), rounds=2).toPandas()
    assert sorted(out["action_id"]) == list(range(400))
    assert 0 < len(passes) <= 2 * 2 * 3 and set(passes) == {4}  # rounds, groups and levels, whatever the folds


def test_three_learners_share_their_passes(spark, monkeypatch):
    from fieldloom.plans import full

    rng, passes = np.random.default_rng(6), counted_passes(monkeypatch)
    rows = [(f"m{i % 9}", i, i % 3 + 1 if i % 10 else None, float(max(x, 0)) if i % 10 else None, i % 2, (i + 1) % 2, i % 3, float(x + rng.normal())) for i, x in enumerate(rng.normal(0, 1, 300))]
    df = spark.createDataFrame(rows, "match_id string, player_id long, fold int, xag double, squad long, opponent long, comp long, a double")
    got = full.predict(df, ["a"], (1, 2, 3), how=How(rounds=3, depth=2, least_rows=5, patience=3)).toPandas()
    assert len(got) == 300 and got["prediction"].notna().all()
    assert len(passes) <= 3 * 2 + 1 and set(passes) == {9}


def test_chained_encodings_read_their_rows_once_each(spark, tmp_path):
    from fieldloom.operators import encoding

    spark.createDataFrame([(i, i % 3, i % 2, 1 - i % 2, i % 4 + 1, float(i)) for i in range(40)], "id long, comp long, squad long, opponent long, fold int, xag double").write.parquet(str(tmp_path / "t"))
    plan = encoding.with_residuals(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [") <= 2 + 3 * 3  # the rows, their means, and three a key, not four times those of the key before


def test_boosting_keeps_its_rows_in_blocks(spark, monkeypatch):
    x, y, fold, w = made()
    df = table(spark, x, y, fold, w)
    edges = boosting.bin_edges(df, NAMES, 16)
    blocks = boosting._table(df, NAMES, edges, ["y"], ["w"], ("id",), [0.0, 1.0])
    assert blocks.count() <= 3  # one a task, not one a row
    monkeypatch.setattr(boosting, "BLOCK", 1000)
    small = boosting._table(df, NAMES, edges, ["y"], ["w"], ("id",), [0.0, 1.0]).toArrow().to_batches()
    parts = [p for batch in small for p in boosting._blocks(batch)]
    assert len(parts) > 3 and all(sum(a.nbytes for a in p) <= 1000 for p in parts)
    numbers = np.hstack([p[3] for p in parts])
    assert sorted(numbers[0]) == sorted(y) and (numbers[2:] == [[0.0], [1.0]]).all()
    assert np.hstack([p[2] for p in parts]).shape == (4, 400) and sorted(np.concatenate([p[1] for p in parts])) == sorted(fold)


def test_one_pass_predicts_all_groups(spark, monkeypatch):
    from fieldloom.models import trees

    rng, calls, real = np.random.default_rng(5), [], boosting.predict_all
    monkeypatch.setattr(boosting, "predict_all", lambda fits, *a, **k: calls.append(len(fits)) or real(fits, *a, **k))
    rows = [(i, ("pass", "cross", "carry")[i % 3], i % 4 + 1, float(x), "success" if rng.random() < 1 / (1 + np.exp(-3 * x)) or i % 3 == 2 else "fail") for i, x in enumerate(rng.normal(0, 1, 400))]
    df = spark.createDataFrame(rows, "action_id long, `group` string, fold int, x double, result_name string")
    out = trees.success_probability(df, ["x"], ["pass", "cross", "carry"], (1, 2, 3, 4), rounds=2, keep=["action_id", "group"])
    assert out.columns == ["action_id", "group", "xpass_prob"] and calls == [2]  # carries always succeed: their own rate
    got = out.toPandas()
    assert sorted(got["action_id"]) == list(range(400)) and got.loc[got["group"] == "carry", "xpass_prob"].tolist() == pytest.approx([1 - 1e-4] * 133)


def test_expected_value_reads_its_tables_from_written_ones(spark, small):
    from fieldloom.plans.catalog import QUERIES

    assert not [f for f in QUERIES["edxt_pipeline"](spark, small).inputFiles() if "events.parquet" in f]


def test_few_positions_are_broadcast(spark):
    from pyspark.sql import functions as F

    from fieldloom.operators import encoding

    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    plan = encoding.empirical_position(df, "v", F.lit(True))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_team_sums_are_joined(spark):
    from fieldloom.operators import windows

    rows = [("a", 1, 0, 1.0), ("a", 2, 0, 3.0), ("a", 3, None, 2.0), ("a", 4, None, None), ("b", 5, 0, -1.0), ("b", 6, 0, 1.0), (None, 7, 1, None)]
    df = windows.team_context(spark.createDataFrame(rows, "match_id string, player_id long, squad long, v double"), ["v"])
    assert "Window" not in df._jdf.queryExecution().sparkPlan().toString() and df.columns == ["match_id", "player_id", "squad", "v", "v_team_sum", "v_team_share", "v_team_lopo"]
    got = {r["player_id"]: (r["v_team_sum"], r["v_team_share"], r["v_team_lopo"]) for r in df.collect()}
    assert got == {1: (4.0, 0.25, 3.0), 2: (4.0, 0.75, 1.0), 3: (2.0, 1.0, 0.0), 4: (2.0, None, None), 5: (0.0, 0.0, 1.0), 6: (0.0, 0.0, -1.0), 7: (None, None, None)}


def test_a_players_groups_are_summed_one_below_the_other(spark):
    from fieldloom.operators import expected

    rows = [("a", 1, "pass", 0.5, 0.2, 0.1, 0.3), ("a", 1, "pass", -1.0, 0.4, 0.3, 0.5), ("a", 1, "carry", 2.0, 1.0, 0.5, 0.1), ("a", 2, "cross", 1.0, 1.0, 1.0, 1.0), ("b", 1, "carry", None, 1.0, None, 0.2)]
    df = expected.expected_features(spark.createDataFrame(rows, "match_id string, player_id long, `group` string, success double, fail_raw double, fail_scaled double, fail_weight double"), {"pass": 0.5, "carry": 1.0})
    assert df._jdf.queryExecution().sparkPlan().toString().count("Exchange hashpartitioning") <= 1
    got = {(r["match_id"], r["player_id"]): r for r in df.collect()}
    one, other, none = got["a", 1], got["a", 2], got["b", 1]
    assert len(got) == 3 and [one[f"pass_edxt_{n}"] for n in ("sum", "mean", "max", "positive_sum", "positive_mean", "count")] == pytest.approx([-0.8, -0.4, 0.4, 0.4, 0.2, 2])
    assert one["carry_edxt_scaled_sum"] == pytest.approx(1.5) and one["pass_fail_weight_sum"] == pytest.approx(0.8)
    assert all(v == 0 for k, v in other.asDict().items() if k not in ("match_id", "player_id"))
    assert none["carry_edxt_count"] == 0 and none["carry_edxt_sum"] == 0.0 and none["carry_edxt_fail_sum"] == 1.0


def test_features_of_few_bins_are_counted_together(monkeypatch):
    rng, calls, real = np.random.default_rng(8), [], np.bincount
    n, sizes = 500, [3, 4, 33, 2, 5, 33, 33, 3, 40, 3, 2, 3]
    columns = np.stack([rng.integers(0, k, n) for k in sizes]).astype(np.uint8)
    fold, y, w = rng.integers(1, 4, n).astype(np.int32), rng.random(n), rng.integers(1, 6, n).astype(float)
    losses = [Loss(), Loss("tweedie", 1.4)]
    models = [boosting._Model(loss, How(depth=2), f, k, 0, 0) for loss in losses for k, f in enumerate((1, 2, 3))]

    class Table:
        def mapInArrow(self, f, schema):
            return f

    work = boosting._Fit(Table(), len(sizes), [np.arange(k - 2.0) for k in sizes], models, [[0] * len(sizes)] * 6, 1, 1)
    tree = boosting.Tree.empty(2)
    tree.feature[0], tree.bin[0] = 2, 15
    few = frozenset({0, 2, 5, 11})
    state = boosting._State([[] for _ in models], [tree] * 6, [{1: None, 2: None}] * 6, [{1: frozenset(range(12)), 2: few}] * 5 + [{1: few, 2: few}], [True] * 6, 0)
    numbers = np.vstack([y, w, *[np.full(n, m / 10) for m in range(6)]])
    batches = [boosting._block(np.arange(i, i + 250), fold[i : i + 250], columns[:, i : i + 250], numbers[:, i : i + 250]) for i in (0, 250)]
    monkeypatch.setattr(boosting.np, "bincount", lambda *a, **k: calls.append(1) or real(*a, **k))
    found = {(r["model"], r["node"]): np.frombuffer(r["hist"]) for batch in work.histograms(state)(iter(batches)) for r in batch.to_pylist()}
    monkeypatch.undo()
    assert len(calls) < 6 * len(sizes) * 2 and len(found) == 18  # three a feature and model before
    begin = np.cumsum([0, *sizes])
    for m, model in enumerate(models):
        g, h = model.loss.gradient(y, np.full(n, m / 10), w)
        assert found[m, -1][:2] == pytest.approx([model.loss.value(y, np.full(n, m / 10), w)[fold == model.fold].sum(), (fold == model.fold).sum()])
        for node in (1, 2):
            use = (fold != model.fold) & ((columns[2] > 15) == (node == 2))
            for f in range(12) if m < 5 else sorted(few):
                want = [real(columns[f][use], v[use], sizes[f]) for v in (g, h, np.ones(n))]
                assert found[m, node].reshape(-1, 3)[begin[f] : begin[f + 1]] == pytest.approx(np.stack(want, 1), abs=1e-9)


def test_percentiles_stay_out_of_the_sums_of_all_blocks(spark, small):
    from fieldloom.operators import value, windows
    from fieldloom.plans import catalog, full
    from fieldloom.plans.fusion import fuse
    from fieldloom.sources.staging import staged

    a = staged(catalog.valued(spark, small), "actions")
    one = full.own_features(a, catalog.KINDS)[0]
    steps = [line.split("(")[0].split()[-1] for line in one._jdf.queryExecution().sparkPlan().toString().splitlines() if "(" in line]
    assert "HashAggregate" in steps  # with percentiles among the sums, ObjectHashAggregate was the only one
    want = fuse(windows.with_own_previous(value.with_heuristic_value(a)), [*full.fused_blocks(catalog.KINDS), *full.more_blocks()])
    assert one.dtypes == want.dtypes
    got, want = (df.toPandas().sort_values(["match_id", "player_id"]).reset_index(drop=True) for df in (one, want))
    assert (got["box_receive_time_to_shot_p50"] > 0).any() and np.allclose(got.iloc[:, 2:].to_numpy(float), want.iloc[:, 2:].to_numpy(float), atol=1e-9, rtol=0, equal_nan=True)
    assert (got["player_id"] == want["player_id"]).all()
