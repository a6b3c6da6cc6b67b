"""Plan guards over every registered query."""

import re

import pytest

import __spark_entry__ as entry
from quarry.plans import catalog

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(plan: str) -> list[str]:
    """Window nodes whose spec starts with an ordering or the frame, i.e.
    has no partition columns."""
    out = []
    for line in plan.splitlines():
        if not re.search(r"\bWindow \[", line):
            continue
        for spec in re.findall(r"windowspecdefinition\(([^,]*)", line):
            if spec.startswith("specifiedwindowframe") or re.search(r" (ASC|DESC) NULLS ", spec):
                out.append(line)
    return out


def test_guard_sees_the_offset_window(spark):
    plan = _plan(entry.queries()["range_slice"](spark, SF_SMALL))
    lines = unpartitioned_windows(plan)
    assert lines and all("_pid" in ln for ln in lines)
    topk = _plan(entry.queries()["bm25_topk"](spark, SF_SMALL))
    assert "Window [" in topk and not unpartitioned_windows(topk)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan_guards(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDF
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    for line in unpartitioned_windows(plan):
        # the only unpartitioned window allowed: ordinal offsets over the
        # per-partition counts (one row per partition)
        assert "_pid" in line, line


def test_joins_with_bounded_sides_broadcast(spark):
    plan = _plan(entry.queries()["resume_anti"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    plan = _plan(entry.queries()["dedupe_first"](spark, SF_SMALL))
    assert "partial_min" in plan  # keep-first is a partial aggregate, not a window
