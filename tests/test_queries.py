"""Queries against their SQL on the smallest tables; the driver's contract."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from shardweave.plans import catalogue
from verify import _cell

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
#: One of each kind; verify.py runs them all.
NAMES = ["edges_removed_all", "node_weights", "part_balanced", "feature_gather", "agg_mean", "agg_div", "scatter_add", "gaussian_features", "choice_weighted", "send_list", "sddmm_mean", "gcn_norm_selfloop", "khop_2_noloop", "layer_norm", "comm_splits", "remote_renumber", "agg_plan_cover", "agg_plan_int4", "agg_plan_mixed", "cover_valid", "pack_row_mixed", "unpack_rows_2", "sage_layer", "fs_sum", "argmax_acc", "log_parse", "best_epoch"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    rel = con.sql(catalogue.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    ours = Counter(tuple(_cell(x) for x in r) for r in df.select(*[f"`{c}`" for c in order]).collect())
    assert ours == Counter(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())


def test_cover_is_the_least_volume(spark):
    rows = {r["plan"]: r["n_rows"] for r in catalogue.QUERIES["plan_cover_volume"](spark, str(SF)).collect()}
    assert rows == {"cover": 90, "degree": 90, "post": 96, "pre": 93}


def test_components_of_all_edges(spark, con):
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in con.sql("SELECT l_partkey % c, l_orderkey % c FROM lineitem, (SELECT count(*) AS c FROM embeddings)").fetchall():
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["node"]: r["component"] for r in catalogue.QUERIES["components"](spark, str(SF)).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_contract(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.QUERIES) > 110
