"""The catalogue: every query equals its oracle in DuckDB at the smallest size, and nothing outside imports the text operators."""

import os
import re
from pathlib import Path

import duckdb
import pytest

from voxlake.plans import catalog, more, stored

QUERIES = catalog.QUERIES | stored.QUERIES | more.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | stored.ORACLE_SQL | more.ORACLE_SQL

SF = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert plain(got, df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["block_labels", "stored_labels"])
@pytest.mark.parametrize("voxels", [64 * 64 * 32, 0])
def test_background_of_full_and_empty_volumes(spark, tmp_path, name, voxels):
    c, path = duckdb.connect(), f"{tmp_path}/lineitem.parquet"
    c.execute(f"COPY (SELECT i % 64 AS l_partkey, i // 64 % 64 AS l_orderkey, i // 4096 AS l_suppkey, i % 7 + 1 AS l_linenumber FROM range({voxels}) r(i)) TO '{path}' (FORMAT parquet)")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(tmp_path))
    want = c.execute(ORACLE_SQL[name]).fetchall()
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want, ["label"]) and (0,) in want


def test_text_operators_are_apart():
    root = Path(__file__).resolve().parent.parent
    for f in [*root.glob("voxlake/**/*.py"), root / "bench.py"]:
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"voxlake\.llm|corpus_pipeline", f.read_text()), f


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "pairwise_cloud" in e.queries()
