"""Match odds by phase: no table is sent whole to the driver."""

from oddslake.plans import phases


def test_no_side_is_broadcast(spark, sf_dir):
    plan = phases.match_odds_phases(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
