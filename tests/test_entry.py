"""The entry points: schema, SQL twins, and independence from the training-data operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from meshwork.plans import analysis_queries, graph_queries, report_queries

FOLDER = "/root/testdata/sf0.001"
SOME = ["aggregate_edges", "input_threshold", "node_compartments", "cost_shares", "nearest_region", "region_atlas", "route_counts", "rich_club_coefficient", "lorenz_curve", "length_deciles", "cut_counts", "sign_flip_null", "mann_whitney_crossing", "clustering", "headline"]


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", SOME)
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    frame = __spark_entry__.queries()[name](spark, FOLDER)
    assert sorted(columns) == sorted(frame.columns)
    assert sorted((norm(tuple(r)) for r in frame.select(*columns).collect()), key=repr) == sorted(map(norm, found.fetchall()), key=repr)


def test_names_are_complete():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert len(graph_queries.QUERIES) + len(analysis_queries.QUERIES) + len(report_queries.QUERIES) >= 130


def test_flagship(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and frame.columns[0] == "edge_group"


def test_without_the_training_data_operators(tmp_path):
    """Everything else imports when that subpackage and the pipeline are gone."""
    repo = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
for gone in ("meshwork.llm", "corpus_pipeline"):
    sys.modules[gone] = None
import __spark_entry__ as e
assert len(e.queries()) >= 85 and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
