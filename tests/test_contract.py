"""Driver contract and plan checks."""

import re

import __spark_entry__ as E
import pytest
from ctxloom.constants import WORDS
from ctxloom.plans.registry import QUERIES
from ctxloom.session import materialize
from tests.conftest import SF001


def test_registry_keys():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 30
    for name in QUERIES:
        assert not re.match(r"op\d+_", name) and "pipeline" not in name


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns == ["project_id", "chunk_no", "n_chunks", "n_bytes", "n_tokens", "n_fragments", "at_limit", "text"]
    for r in rows:
        assert r.text.startswith(WORDS.system_open) and r.text.endswith("</instruction>\n") and r.n_chunks == 1
        assert r.n_bytes == len(r.text.encode())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans_of(spark, monkeypatch):
    """Plans of a query and of every table that it writes on the way."""
    from ctxloom.operators import intervals

    def all_plans(name):
        written = []

        def noted(df, label):
            written.append(_plan(df))
            return materialize(df, label)

        monkeypatch.setattr(intervals, "materialize", noted)
        last = _plan(E.queries()[name](spark, SF001))
        return "\n".join([*written, last])
    return all_plans


def test_metadata_queries_do_not_read_text(spark):
    for name in ["scan_stats", "tree_nodes", "nearest_rules", "recent_commands"]:
        plan = _plan(E.queries()[name](spark, SF001))
        scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
        assert scans, name
        for cols in scans:
            assert "html" not in cols and not re.search(r"\btext#", cols) or name == "tree_nodes", (name, cols)


def test_no_python_udf_over_catalogue_rows(spark):
    for name in ["scan_stats", "context_fragments", "estimate_tokens", "html_text", "strip_comments"]:
        plan = _plan(E.queries()[name](spark, SF001))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_pushdown_and_pruning(spark):
    plan = _plan(E.queries()["recent_commands"](spark, SF001))
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))" in plan or \
           "EqualTo(event_type,error)" in plan
    assert "value" not in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)[0]


def test_group_limit_applies_at_the_default(plans_of):
    for name in ["loaded_files", "folder_select", "folder_tristate"]:
        assert "WindowGroupLimit" in plans_of(name), name


def test_latest_update_state_is_narrow(spark):
    assert "SortAggregate" not in _plan(E.queries()["latest_update"](spark, SF001))


def test_head_tail_lines_needs_no_shuffle(spark):
    plan = _plan(E.queries()["head_tail_lines"](spark, SF001))
    assert "Exchange" not in plan and "Join" not in plan


def test_estimate_shuffles(plans_of):
    plan = plans_of("estimate_tokens")
    assert plan.count("Exchange hashpartitioning") <= 6 and plan.count("Exchange rangepartitioning") == 1
    assert "explode" not in plan.lower() and "Generate" not in plan


def test_folders_are_intervals_not_spelled_out(plans_of):
    for name in ["folder_select", "selected_files"]:
        assert "Generate" not in plans_of(name), name
    assert plans_of("folder_tristate").count("Generate") == 1  # where folders begin and end
