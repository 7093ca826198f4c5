"""Physical-plan checks: the plans Catalyst picks for the key operators."""

import contextlib
import io

import __spark_entry__ as E
from conftest import SMALL

Q = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_topk_uses_window_group_limit_and_pruned_scan(spark):
    p = plan(Q["win_topk_features"](spark, SMALL))
    assert "WindowGroupLimit" in p
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in p


def test_blacklist_join_is_equi_join(spark):
    p = plan(Q["join_blacklist"](spark, SMALL))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_knn_limits_before_shuffle(spark):
    p = plan(Q["topk_neighbours"](spark, SMALL))
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_split_read_prunes_partitions(spark):
    from chromatide.plans.fixtures import Inputs
    from chromatide.session import scratch_path
    from chromatide.sources import tables as IO
    path = scratch_path(spark, "plan-splits")
    IO.write_splits(Inputs(spark, SMALL).corpus, path)
    p = plan(IO.read_splits(spark, path, "test"))
    assert "PartitionFilters: [isnotnull(split" in p and "(split#" in p


def test_region_fetch_is_equi_join(spark):
    p = plan(Q["join_region_sequence"](spark, SMALL))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_stratified_sample_limits_before_shuffle(spark):
    p = plan(Q["sample_species_uniform"](spark, SMALL))
    assert "WindowGroupLimit" in p


def test_rank_sum_has_no_window_over_a_feature(spark):
    # mid-ranks come from (feature, score) counts; windows only run per partition or over partitions
    p = plan(Q["stat_rank_sum"](spark, SMALL))
    assert "NestedLoop" not in p and "Cartesian" not in p
