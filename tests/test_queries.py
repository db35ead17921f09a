"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from fieldloom.plans.catalog import QUERIES
from fieldloom.plans.oracles import ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, con, name):
    got, want = QUERIES[name](spark, small).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        want[c] = want[c].astype(got[c].dtype) if got[c].dtype.kind in "if" else want[c]
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["pass_betweenness", "passnet_centrality", "edxt_features", "group_fold_sizes", "strat_group_folds", "blend_two", "nnls_stack", "isotonic_pos", "table_fingerprint", "xpass_model", "platt_by_fold", "hurdle_oof", "mixture_oof", "log_oof", "blend_simplex", "isotonic_threshold", "edxt_pipeline", "gbt_oof", "tweedie_oof", "ordered_splits"])
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_query_has_sql_or_a_test():
    rest = {"pass_betweenness", "passnet_centrality", "edxt_features", "group_fold_sizes", "strat_group_folds", "blend_two", "nnls_stack", "isotonic_pos", "platt_by_fold", "gbt_oof", "tweedie_oof", "xpass_model", "table_fingerprint", "hurdle_oof", "mixture_oof", "log_oof", "tree_search", "blend_simplex", "isotonic_threshold", "edxt_pipeline", "full_run", "boosted_monotone", "boosted_groups", "boosted_tweedie", "boosted_quantiles", "boosted_history", "boosted_importance", "ordered_splits"}
    assert set(QUERIES) - set(ORACLE_SQL) == rest


def few_rounds(monkeypatch):
    from dataclasses import replace

    from fieldloom.models import boosting

    real = boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda rows, features, y, folds, key, loss=boosting.Loss(), how=boosting.How(), weight=None, edges=None: real(rows, features, y, folds, key, loss, replace(how, rounds=2, depth=2), weight, edges))  # noqa: B008


def test_boosted_queries(spark, small, monkeypatch):
    """Their rows, with few rounds; what they hold is tested in test_boosting."""
    few_rounds(monkeypatch)
    targets = QUERIES["step_weights"](spark, small).count()
    rising = QUERIES["boosted_monotone"](spark, small).collect()
    assert len(rising) == 5 * 17 and all(r["falls"] == 0 and r["rows"] == targets for r in rising)
    history = QUERIES["boosted_history"](spark, small).collect()
    assert len(history) == 5 * 3 and sum(r["counts"] for r in history) == 5


def test_entry_has_one_exchange_for_all_blocks(spark, small):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == QUERIES["distinct_pairs"](spark, small).where("player_id % 5 <> 4").count()
    assert set(__spark_entry__.queries()) >= set(QUERIES)


def test_fused_blocks_equal_single_ones(spark, small):
    from fieldloom.operators import blocks
    from fieldloom.plans.catalog import prepared
    from fieldloom.plans.fusion import fuse, run

    a = prepared(spark, small)
    made = [blocks.gca_spatial(), blocks.vision(), blocks.box_receiver_volume(), blocks.attack_tempo()]
    wide = fuse(a, made).toPandas().set_index(["match_id", "player_id"])
    for b in made:
        one = run(a, b).toPandas().set_index(["match_id", "player_id"])
        both = wide.loc[one.index, list(b.columns)]
        assert ((both - one[list(b.columns)]).abs().max() < 1e-9).all()
        assert (wide.drop(one.index)[list(b.columns)].abs().sum() < 1e-9).all()


def test_block_plan_has_few_exchanges(spark, small):
    from fieldloom.operators import blocks
    from fieldloom.plans.catalog import actions
    from fieldloom.plans.fusion import fuse

    plan = fuse(actions(spark, small), [blocks.gca_spatial(), blocks.vision(), blocks.box_receiver_volume()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_full_run_learns_from_known_rows_alone(spark, small):
    pdf = QUERIES["full_run"](spark, small).toPandas()
    assert len(pdf) == QUERIES["distinct_pairs"](spark, small).where("player_id % 5 <> 4").count()
    known = pdf[pdf["fold"].notna()]
    assert pdf["prediction"].notna().all() and (pdf["prediction"] >= 0).all() and pdf["xag"][pdf["fold"].isna()].isna().all()
    error = lambda p: ((known["xag"] - p) ** 2).mean()
    assert error(known["prediction"]) < error(known["xag"].mean())
