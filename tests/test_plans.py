"""Plans that would not hold at scale are refused here."""

import pytest
from conftest import SF

from tidelog.operators import log, state, tables
from tidelog.plans import catalogue, inputs
from tidelog.sources.logs import events_log


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - {"stream_state"}))
def test_no_cross_join_and_no_row_python(spark, name):
    p = plan(catalogue.queries()[name](spark, SF))
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p  # no scalar Python functions
    if name not in ("rotate_by_bytes", "block_index", "block_contiguity"):
        assert "MapInPandas" not in p


def test_scans_read_the_columns_they_need(spark):
    p = plan(log.noop_deletes(events_log(spark, SF)))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in p
    p = plan(state.tombstones(inputs.entries(spark, SF)))
    assert "value:double" not in p


def test_latest_combines_before_the_shuffle(spark):
    p = plan(state.latest(inputs.entries(spark, SF)))
    assert "partial_max_by" in p


def test_ranges_are_swept_not_joined(spark):
    p = plan(tables.range_prune(inputs.catalog(spark, SF), inputs.probes(spark, SF)))
    assert "smallest_key" not in "".join(x for x in p.splitlines() if "NestedLoopJoin" in x)
