"""Plan invariants the scale design relies on (checked on the final plans)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df, df._jdf.queryExecution().executedPlan().toString()


def test_envelope_filter_does_not_reparse(spark):
    """Each message is decoded in one place (and a status payload in one more), below the filter."""
    df, _ = _plan(spark, "envelope_parse")
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    lines = optimized.split("\n")
    assert sum("ArrowEvalPython" in line for line in lines) == 2
    assert any("Filter " in line for line in lines) and not any("decode(" in line for line in lines if "Filter " in line)


@pytest.mark.parametrize("name", ["node_list", "node_usage_latest", "deployment_status", "edge_health"])
def test_edge_state_needs_no_ordered_scan(spark, name):
    _, plan = _plan(spark, name)
    assert "Window [" not in plan


@pytest.mark.parametrize("name", ["battery_series", "snapshot_2s"])
def test_readings_shuffled_once(spark, name):
    """Exactly one exchange moves raw readings (by robot and chunk); every other
    exchange on those keys carries a per-chunk partial aggregate."""
    _, plan = _plan(spark, name)
    lines = plan.split("\n")
    raw_moves = 0
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(robot_id#\d+, _chunk#\d+", line):
            child = next((x for x in lines[i + 1:] if x.strip()), "")
            if "Aggregate" not in child:
                raw_moves += 1
    assert raw_moves == 1


@pytest.mark.parametrize("name", ["telemetry_latest", "status_upsert", "route_blobs"])
def test_keyed_state_is_partially_aggregated(spark, name):
    _, plan = _plan(spark, name)
    assert "partial_max_by" in plan


def test_no_broadcast_hints():
    import pathlib

    # the training-data operators broadcast sides of a bounded size (a sample, one row for each partition)
    files = [p for p in pathlib.Path(E.__file__).parent.joinpath("roverlake").rglob("*.py") if "llm" not in p.parts]
    src = "\n".join(p.read_text() for p in files)
    assert "broadcast(" not in src and ".hint(" not in src
