"""Every query with SQL against DuckDB on the smallest tables; the life cycle and a sample of others, or all with TRACEWELL_ALL=1."""

import math
import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
if not Path(SF).is_dir():
    pytest.skip("no tables here", allow_module_level=True)

from tracewell.plans import catalog

NAMES = sorted(catalog.oracle_sql())
CHOSEN = NAMES if os.environ.get("TRACEWELL_ALL") else [n for i, n in enumerate(NAMES) if i % 4 == 0 or n.startswith("A25")]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or str(v) in ("nan", "NaT", "<NA>"):
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    want = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_unseen_files_of_repeated_urls(spark, tmp_path):
    """Pages that share a URL count one by one; URLs, texts and ids may be missing, and ids come twice, with texts of nearly one length."""
    pages = [(i, f"u{i % 3}", "x" * (i % 5)) for i in range(40)] + [(i, None, "y") for i in range(100, 108)] + [(i, f"n{i}", None) for i in range(200, 208)] + [(-i, "m", "q") for i in range(1, 9)]
    pages += [(None, "u", "z"), (None, None, None), (2, "same", "aa"), (2, "same", "aaa"), (2, "same", "aa"), (4, "four", "b"), (4, "four", "b")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.queries()["S8_unseen_files"](spark, str(tmp_path))
    want = c.execute(catalog.oracle_sql()["S8_unseen_files"]).fetchall()
    assert got.columns == ["path"] and rows(["path"], map(tuple, got.collect())) == rows(["path"], want)
