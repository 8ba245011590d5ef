"""Registered queries against their SQL at the smallest scale.

A spread of them runs by default; FAULTLENS_ALL=1 runs every one (tools/check.py does so at any scale).
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tools.check import connect, same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = {q for m in entry._modules() for q in m.QUERIES}
SPREAD = (
    "parse_ts ground_truth format_line label_trace_phase time_buckets sample_traces flag_novel snippets budget_services "
    "baseline_stats top_alerts service_edges span_depth leaf_culprit trace_text rank_services confidence triangulation "
    "build_context score_cases aggregate_scores comparison_table check_trace_shape read_metrics_json read_trace_json stream_dedup"
).split()
NAMES = [q for q in ORACLES if q in OWN] if os.environ.get("FAULTLENS_ALL") else SPREAD

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    problem, rows = same(QUERIES[name](spark, SF), con, ORACLES[name])
    assert problem is None
    assert rows > 0


def test_every_query_is_known():
    assert set(ORACLES) <= set(QUERIES)
    assert OWN <= set(ORACLES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["case_id", "mode", "rank", "service", "score"]
    assert df.count() > 0
