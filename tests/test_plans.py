"""Physical plans at a glance, and results that do not depend on partitioning."""

import pytest
from pyspark.sql import functions as F

from axonframe.operators import attach as attach_mod
from axonframe.operators import pair, pick, summarise
from suite import load_all

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w4_pair_dedup", "w5_slice_min_ties", "w6_nearest_to_target", "e1_region_balance", "a7_group_mode"])
def test_row_picks_limit_groups_before_the_shuffle(spark, name):
    plan = plan_of(load_all()[name].run(spark, SF))
    assert plan.count("Partial") >= 1 and "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["w10_moving_average", "w11_savitzky_golay", "w15_second_peak_after_trough", "f6_stimulus_percent", "j6_first_mention"])
def test_array_and_text_operators_stay_in_the_jvm(spark, name):
    plan = plan_of(load_all()[name].run(spark, SF))
    assert "Python" not in plan and "Pandas" not in plan
    if name != "j6_first_mention":
        assert "Exchange" not in plan


@pytest.mark.parametrize("name", ["j2_dimension_join", "j4_control_drug_pairs", "j10_level_pairs", "i12_circle_sampling", "i18_warp", "i2_tile_coverage", "a12_kernel_density"])
def test_no_nested_loops(spark, name):
    plan = plan_of(load_all()[name].run(spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(load_all()["a1_grouped_mean_null_keys"].run(spark, SF))
    assert "l_orderkey" not in plan.split("FileScan")[1].split("]")[0]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i % 7, i % 5 if i % 11 else None, float(i * 37 % 101), i) for i in range(600)]
    return spark.createDataFrame(rows, "a int, b int, v double, o int")


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitioning_does_not_change_results(table, parts):
    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    d = table.repartition(parts)
    for f in (
        lambda t: pick.pair_dedup(t, "a", "b", ["v", "o"]),
        lambda t: pick.nearest(t, ["b"], "v", 40.0, ["o"]),
        lambda t: pick.nearest_to_median(t, ["a"], "v"),
        lambda t: pick.group_mode(t, ["a"], "b"),
        lambda t: summarise.box_stats(t, ["b"], "v"),
        lambda t: summarise.min_max_scale(t, ["b"], "v", "s"),
    ):
        assert rows(f(d)) == rows(f(table))


def test_null_keys_and_joins_without_broadcast(spark, table, monkeypatch):
    small = summarise.min_max_scale(table, ["b"], "v", "s")
    assert small.count() == 600 and small.filter("b IS NULL AND s IS NOT NULL").count() > 0
    monkeypatch.setattr(attach_mod, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(attach_mod, "auto_broadcast_bytes", lambda _: -1)
    big = summarise.min_max_scale(table, ["b"], "v", "s")
    assert sorted(map(tuple, big.collect()), key=repr) == sorted(map(tuple, small.collect()), key=repr)


def test_pairs_match_null_keys(spark):
    df = spark.createDataFrame([("c", None, False, 1.0), ("c", None, True, 2.0), ("d", 1, False, 3.0)], "cell string, stim int, drug boolean, v double")
    got = pair.pair_join(df, ~F.col("drug"), F.col("drug"), ["cell", "stim"], ["v"], ("_a", "_b")).collect()
    assert [(r["cell"], r["stim"], r["v_a"], r["v_b"]) for r in got] == [("c", None, 1.0, 2.0)]
    left = pair.pair_unique(df, ~F.col("drug"), F.col("drug"), ["cell", "stim"], ["v"], ("_a", "_b"))
    assert {(r["cell"], r["v_b"]) for r in left.collect()} == {("c", 2.0), ("d", None)}
