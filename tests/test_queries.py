"""Every core query over the smallest tables, against its SQL in another engine."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

from pagewright.plans import core, documents  # noqa: F401  (registers its queries)

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, engine, name):
    df = core.QUERIES[name](spark, DATA)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in core.SQL:
        assert isinstance(rows, list)
        return
    result = engine.execute(core.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in rows) == Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def test_colors_of_high_page_numbers(spark, tmp_path):
    """Page 41,660 stands in a table of 100 times sf0.1; its product with 65,793 is beyond 32 bits."""
    rows = spark.read.parquet(f"{DATA}/elements.parquet").limit(1)
    rows.selectExpr("* EXCEPT (page_no, element_no)", "explode(array(1, 41660, 2147483647)) AS page_no", "2147483647 AS element_no").write.parquet(f"{tmp_path}/elements.parquet")
    got = {r.page_no: r.as_hex for r in core.QUERIES["colors"](spark, str(tmp_path)).collect()}
    assert got == {p: f"#{(p * 65793 + 2147483647) & 0xFFFFFF:06x}" for p in (1, 41660, 2147483647)}
