from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.models import blending, evaluation, trees
from fieldloom.operators import expected, network, value


def test_nonnegative_least_squares_against_all_active_sets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.normal(size=(30, 4)), rng.normal(size=30)
        a, b = x.T @ x, x.T @ y
        got = blending.nonnegative_least_squares(a, b)
        best = np.inf
        for k in range(5):
            for s in itertools.combinations(range(4), k):
                w = np.zeros(4)
                if s:
                    w[list(s)] = np.linalg.solve(a[np.ix_(s, s)], b[list(s)])
                if (w >= 0).all():
                    best = min(best, w @ a @ w - 2 * b @ w)
        assert (got >= 0).all() and got @ a @ got - 2 * b @ got <= best + 1e-8


def test_blend_search(spark):
    rows = spark.createDataFrame([(0.0, 0.1, 0.4), (0.2, 0.1, 0.3), (0.3, 0.5, 0.2)], "y double, a double, b double")
    w, e = blending.best_blend(blending.gram(rows, ["a", "b"], "y", F.lit(1.0)).first())
    pdf = rows.toPandas()
    errors = {i / 20: float(np.sqrt(((pdf.y - i / 20 * pdf.a - (1 - i / 20) * pdf.b) ** 2).mean() + 1e-9)) for i in range(21)}
    assert e == pytest.approx(min(errors.values())) and errors[w] == pytest.approx(e)
    both, e2 = blending.best_simplex_blend(blending.gram(rows, ["a", "b"], "y", F.lit(1.0)).first(), 2)
    assert e2 == pytest.approx(e) and sum(both) == pytest.approx(1)


def test_isotonic_leaves_low_rows(spark):
    rows = spark.createDataFrame([(0.05, 0.0), (0.2, 0.3), (0.3, 0.1), (0.4, 0.5)], "p double, y double")
    got = {r["p"]: r["c"] for r in blending.apply_isotonic(rows, blending.fit_isotonic(rows, "p", "y"), "p", "c").collect()}
    assert got[0.05] == 0.05 and got[0.2] == pytest.approx(0.2) and got[0.3] == pytest.approx(0.2) and got[0.4] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        blending.fit_isotonic(rows, "p", "y", threshold=0.9)


def test_group_folds_keep_groups(spark):
    rows = spark.createDataFrame([(f"g{i % 7}", float(i % 3) / 10) for i in range(70)], "match_id string, xag double")
    for folds in (evaluation.group_folds(rows), evaluation.stratified_group_folds(rows)):
        got = folds.collect()
        assert len(got) == 7 and {r["fold"] for r in got} <= {1, 2, 3, 4, 5}
    sizes = evaluation.group_folds(rows).groupBy("fold").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1
    hashed = evaluation.hashed_folds(rows)
    assert hashed.groupBy("match_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert evaluation.fold_warnings(hashed)


def test_ranking_quality_with_ties(spark):
    rng = np.random.default_rng(2)
    p, y = rng.integers(0, 6, 200) / 5, rng.integers(0, 2, 200)
    got = evaluation.ranking_quality(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int"), "p", "y").first()
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert got["auc"] == pytest.approx(np.mean(pairs))
    ap = sum(y[p == t].sum() * y[p >= t].mean() for t in np.unique(p)) / y.sum()
    assert got["average_precision"] == pytest.approx(ap)


def test_mixture_predicts_every_row_with_both_experts(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(x), float(max(0.0, round(x, 1))), int(i % 3) + 1) for i, x in enumerate(rng.uniform(-0.5, 1, 150))], "x double, y double, fold int")
    out = trees.mixture_oof(trees.with_vector(rows, ["x"]), "y", [1, 2, 3], rounds=2, least_rows=10).toPandas()
    assert len(out) == 150 and out[["gate", "low", "high", "soft", "hard"]].notna().all().all()
    assert (out[out.y >= 0.1].low.abs() < 0.2).all()  # also where the label says the other expert


def test_hurdle_log_and_search(spark):
    rows = trees.with_vector(spark.createDataFrame([(float(i % 10), float(max(0, i % 10 - 4)) / 10, i % 2 + 1) for i in range(60)], "x double, y double, fold int"), ["x"])
    assert trees.hurdle_oof(rows, "y", [1, 2], rounds=2).where("hurdle is null").count() == 0
    assert trees.out_of_fold(rows, trees.log_regressor("y", "p", rounds=2), [1, 2]).count() == 60
    found = trees.random_search(rows, "y", [1, 2], trials=2)
    assert found[0]["wrmse"] <= found[1]["wrmse"]
    scored = trees.out_of_fold(rows, trees.regressor("y", "p", rounds=3), [1, 2])
    assert trees.monotone_violations(scored, "x", "p", 5).where("falls").count() == 0


def brute_paths(nodes, links):
    """Betweenness and closeness by listing all shortest paths."""
    paths = {}
    for s in nodes:
        queue, best = [(0.0, (s,))], {}
        while queue:
            d, p = min(queue)
            queue.remove((d, p))
            if d > best.get(p[-1], (np.inf,))[0] + 1e-12:
                continue
            best.setdefault(p[-1], (d, []))[1].append(p)
            queue += [(d + w, (*p, t)) for t, w in links.get(p[-1], {}).items() if t not in p]
        paths |= {(s, t): x for t, x in best.items() if t != s}
    n = len(nodes)
    between = {v: sum(sum(v in p[1:-1] for p in ps) / len(ps) for (_, ps) in paths.values()) / ((n - 1) * (n - 2)) for v in nodes}
    close = {}
    for v in nodes:
        d = [x[0] for (_, t), x in paths.items() if t == v]
        close[v] = len(d) / sum(d) * len(d) / (n - 1) if d else 0.0
    return between, close


@pytest.mark.parametrize("weighted", [False, True])
def test_path_measures(weighted):
    rng = np.random.default_rng(4)
    for _ in range(15):
        nodes = list(range(6))
        links = {a: {b: float(rng.integers(1, 4)) if weighted else 1.0 for b in nodes if b != a and rng.random() < 0.4} for a in nodes}
        between, close = brute_paths(nodes, links)
        got = network.path_measures(nodes, links)
        for v in nodes:
            assert got[v] == pytest.approx((between[v], close[v]))


def test_clustering_of_a_triangle_with_a_tail():
    got = network.weighted_clustering([1, 2, 3, 4], {(1, 2): 2.0, (2, 1): 4.0, (2, 3): 4.0, (3, 1): 4.0, (3, 4): 1.0})
    assert got[1] == pytest.approx(1.0) and got[3] == pytest.approx(1 / 3) and got[4] == 0.0


def test_value_iteration_is_a_fixed_point(spark, small):
    from fieldloom.plans.catalog import prepared

    counts = value.transition_counts(prepared(spark, small))
    v = value.solve_values(counts, tolerance=1e-12)
    n = value.CELLS_X * value.CELLS_Y
    t, s, g, lost = np.zeros((n, n)), np.zeros(n), np.zeros(n), np.zeros(n)
    for r in counts.collect():
        if r["end_zone"] is not None:
            t[r["start_zone"], r["end_zone"]] = r["moves"]
        s[r["start_zone"]] += r["shots"]
        g[r["start_zone"]] += r["goals"]
        lost[r["start_zone"]] += r["losses"]
    total = np.maximum(t.sum(1) + s + lost, 1)
    assert np.allclose(v, g / total + 0.95 * (t / total[:, None]) @ v, atol=1e-9)


def test_best_penalty_finds_the_minimum():
    stats = [{"n": 10, "wrr": 5.0, "wrq": -1.0, "wqq": 2.0}, {"n": 20, "wrr": 3.0, "wrq": -2.0, "wqq": 1.0}]
    error = lambda x: sum(np.sqrt((r["wrr"] + 2 * x * r["wrq"] + x * x * r["wqq"]) / r["n"] + 1e-9) for r in stats)
    x = expected.best_penalty(stats)
    assert error(x) <= min(error(y) for y in np.linspace(-1, 2, 301)) + 1e-6


def test_ordered_and_exploded_folds(spark):
    rows = spark.range(60).withColumnRenamed("id", "day")
    got = evaluation.ordered_folds(rows, ["day"], 5).toPandas().sort_values("day")
    assert got["fold"].is_monotonic_increasing and set(got["fold"]) == {-1, 0, 1, 2, 3, 4}
    assert got["fold"].value_counts().max() <= 11
    each = evaluation.explode_folds(evaluation.hashed_folds(rows, "day", 3), 3, "x").toPandas()
    assert len(each) == 180 and (each["fold"] > 0).sum() == 60


def test_hop_centrality_equals_path_measures(spark, monkeypatch):
    monkeypatch.setattr(network, "PATH_SOURCES", 4)
    rng = np.random.default_rng(6)
    rows = {(f"m{g}", g % 2, int(a), int(b)) for g in range(6) for a, b in rng.integers(0, 6 + 3 * g, (5 + 8 * g, 2))}
    df = spark.createDataFrame([(*r, 1) for r in rows], "match_id string, team_id long, src long, dst long, weight long")
    got = {(r["match_id"], r["player_id"]): (r["pass_net_betweenness"], r["pass_net_closeness"]) for r in network.hop_centrality(df).collect()}
    want = {}
    for g in range(6):
        links = {}
        for m, _, a, b in rows:
            if m == f"m{g}":
                links.setdefault(a, {})[b] = 1.0
        nodes = sorted(set(links) | {b for out in links.values() for b in out})
        want |= {(f"m{g}", v): x for v, x in network.path_measures(nodes, links).items()}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k] == pytest.approx(x)


def test_percentiles_are_exact(spark):
    from fieldloom.operators.quantiles import percentiles

    rng = np.random.default_rng(8)
    rows = [(int(g), None if x > 2.3 else float(np.round(x, 1)), int(n)) for g, x, n in zip(rng.integers(0, 3, 500), rng.normal(0, 1, 500), rng.integers(1, 4, 500), strict=True)]
    df = spark.createDataFrame(rows, "g int, x double, n int")
    shares = (0.0, 0.1, 0.25, 0.5, 0.77, 1.0)
    for r in percentiles(df, "x", shares, ("g",), "n").collect():
        values = np.repeat([x for g, x, n in rows if g == r["g"] and x is not None], [n for g, x, n in rows if g == r["g"] and x is not None])
        assert r["q"] == pytest.approx(np.quantile(values, shares))
    assert percentiles(df, "x", shares).first()["q"] == pytest.approx(np.quantile([x for _, x, _ in rows if x is not None], shares))


def test_stratified_folds(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id % 10 = 0 as int) AS y")
    out = evaluation.stratified_folds(rows, "y", ["id"], 5, 1)
    counts = {(r["y"], r["fold"]): r["count"] for r in out.groupBy("y", "fold").count().collect()}
    assert counts == {(y, f): (180, 20)[y] for y in (0, 1) for f in range(5)}
    a, b, c = ({r["id"]: r["fold"] for r in evaluation.stratified_folds(rows, "y", ["id"], 5, s).collect()} for s in (1, 1, 2))
    assert a == b != c


def test_success_probabilities_of_known_and_new_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "pass" if i % 4 else "cross", None if i % 5 == 4 else int(i % 5) + 1, float(x), "success" if rng.random() < 1 / (1 + np.exp(-3 * x)) else "fail") for i, x in enumerate(rng.normal(0, 1, 600))]
    rows += [(1000 + i, "carry", 1, 0.0, "success" if i < 3 else "fail") for i in range(4)]
    df = spark.createDataFrame(rows, "action_id long, `group` string, fold int, x double, result_name string")
    out = trees.success_probability(df, ["x"], ["pass", "cross", "carry"], (1, 2, 3, 4), rounds=3).toPandas().set_index("action_id")
    assert len(out) == len(rows) and (out.xpass_prob[out.group == "carry"] == 0.75).all()
    rest = out[out.group != "carry"]
    for part in (rest[rest.fold.notna()], rest[rest.fold.isna()]):
        y = part.result_name == "success"
        assert part.xpass_prob.between(1e-4, 1 - 1e-4).all() and part.xpass_prob[y].mean() > part.xpass_prob[~y].mean() + 0.2
    assert abs(rest.xpass_prob[rest.fold.notna()].mean() - (rest.result_name[rest.fold.notna()] == "success").mean()) < 0.05  # calibrated


def test_best_isotonic_threshold(spark):
    from pyspark.sql import functions as F

    rows = [(i / 100, i / 100 if i < 12 else 0.5 * i / 100) for i in range(40)]
    df = spark.createDataFrame(rows, "p double, y double")
    t, error, model = blending.best_isotonic_threshold(df, "p", "y", F.lit(1.0))
    errors = {c: blending.apply_isotonic(df, blending.fit_isotonic(df, "p", "y", c), "p", "q", c).toPandas() for c in (0.05, 0.08, t, 0.19)}
    assert all((((e.q - e.y) ** 2).mean() + 1e-9) ** 0.5 >= error - 1e-6 for e in errors.values())
    with pytest.raises(ValueError):
        blending.best_isotonic_threshold(df.where("p < 0.05"), "p", "y", F.lit(1.0))


def test_passes_are_centred_by_position_and_others_by_spread(spark):
    from fieldloom.operators import expected

    rng = np.random.default_rng(5)
    rows = [(i, ("pass", "cross", "carry")[i % 3], None if i % 7 == 6 else i % 7 % 3 + 1, float(np.round(x, 1)), 0.5) for i, x in enumerate(rng.normal(1, 1, 90))] + [(99, "corner", 1, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "action_id long, `group` string, fold int, xt_learned_start double, fail_weight double")
    got = {r["action_id"]: r["fail_scaled"] for r in expected.with_scaled_failure(df, expected.fold_moments(df)).collect()}
    known = np.array([x for _, _, f, x, _ in rows if f])
    passes = np.sort([x for _, g, f, x, _ in rows if f and g == "pass"])
    for i, g, f, x, w in rows:
        if g == "pass":
            want = np.clip((np.searchsorted(passes, x) + 0.5) / len(passes), 1e-6, 1 - 1e-6) - 0.5
        else:
            other = np.array([y for _, h, e, y, _ in rows if h == g and e and e != f])
            mean, std = (other.mean(), other.std()) if len(other) else (known.mean(), known.std())
            want = (x - mean) / (std if std > 1e-6 else known.std())
        assert got[i] == pytest.approx(w * want), (i, g, f)


def greedy(sizes, splits):
    load = [0] * splits
    for n in sorted(sizes, reverse=True):
        f = min(range(splits), key=lambda i: (load[i], i))
        load[f] += n
    return load


@pytest.mark.parametrize("seed", range(6))
def test_dealing_by_classes_is_greedy(seed):
    rng = np.random.default_rng(seed)
    splits = int(rng.integers(2, 7))
    sizes = [int(n) for n in rng.choice([1, 2, 3, 7, 50, 400], 60)] if seed else [5]
    load = [0] * splits
    for n in sorted(set(sizes), reverse=True):
        count = sizes.count(n)
        starts, turns, after = evaluation.deal(load, list(range(splits)), n, count)
        for rank in range(count):
            i = max(k for k, s in enumerate(starts) if s <= rank)
            f = turns[i][(rank - starts[i]) % len(turns[i])]
            assert load[f] == min(load)
            load[f] += n
        assert load == after
    assert sorted(load) == sorted(greedy(sizes, splits))


def test_a_million_groups_are_dealt(spark):
    groups = spark.range(1_000_000).select(F.col("id").alias("match_id"), (F.when(F.col("id") % 1000 == 0, 50).when(F.col("id") % 3 == 0, 2).otherwise(1)).alias("n"))
    rows = groups.select("match_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("xag", (F.col("match_id") % 2 == 0).cast("double"))
    folds = evaluation.group_folds(rows)
    loads = [r["s"] for r in folds.join(groups, "match_id").groupBy("fold").agg(F.sum("n").alias("s"), F.count("*").alias("c")).collect()]
    assert len(loads) == 5 and max(loads) - min(loads) <= 1 and sum(loads) == groups.agg(F.sum("n")).first()[0]
    strata = evaluation.stratified_group_folds(rows)
    found = strata.join(groups, "match_id").groupBy("fold", (F.col("match_id") % 2 == 0).alias("pos")).agg(F.sum("n").alias("s")).collect()
    for pos in (True, False):
        s = [r["s"] for r in found if r["pos"] == pos]
        assert len(s) == 5 and max(s) - min(s) <= 50


def test_ordered_encoding_sees_only_rows_before(spark):
    from fieldloom.operators import encoding

    rng = np.random.default_rng(7)
    rows = [(i, None if rng.random() < 0.1 else int(rng.integers(0, 4)) if rng.random() < 0.6 else 9, None if rng.random() < 0.1 else round(float(rng.random()), 3)) for i in range(400)]
    df = encoding.permuted(spark.createDataFrame(rows, "id long, k long, xag double"), ["id"], 3)
    order = {r["id"]: r["_order"] for r in df.collect()}
    got = {r["id"]: r["k_ordered_enc"] for r in encoding.ordered_target_encoding(df, "k", ["_order", "id"], prior=2.0).collect()}
    mean = np.mean([v for _, _, v in rows if v is not None])
    assert len(got) == 400
    for i, k, v in rows:
        past = [b for j, c, b in rows if c == k and b is not None and (v is None or (order[j], j) < (order[i], i))]
        assert got[i] == pytest.approx((sum(past) + 2 * mean) / (len(past) + 2))
    wide, names = encoding.ordered_encodings(df.drop("_order"), ["k"], ["id"], seeds=(1, 2))
    assert names == ["k_ordered_enc_1", "k_ordered_enc_2"] and wide.count() == 400


def test_columns_of_categories_of_any_name(spark):
    from fieldloom.operators.encoding import category_crosses, one_hot

    values = ["Cup", "a.b", "a_b", "cup", "of `x`"]
    rows = spark.createDataFrame([(v, 2.0) for v in [*values, None]], "league string, v double")
    wide = category_crosses(one_hot(rows, "league", values), ["v"], "league", values).drop("league", "v")
    assert wide.columns == [f"{a}{n}" for a in ("league_", "v__comp_gate_") for n in ("Cup", "a_b", "a_b_2", "cup_2", "of _x_")]
    got = sorted(map(tuple, wide.select(*wide.columns).collect()), reverse=True)
    assert got == [*[tuple([float(i == j) for j in range(5)] + [2.0 * (i == j) for j in range(5)]) for i in range(5)], (0.0,) * 10]
