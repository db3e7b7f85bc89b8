import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def frame(spark, tables):
    """Rows of a given table from dicts; what a dict leaves out is null."""

    def make(name, rows):
        schema = tables(name).schema
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def element(frame):
    return lambda *texts, **more: frame("elements", [{"doc_id": "d", "page_no": 1, "element_no": i, "text": t, "x": 50.0, "y": 100.0 + 20 * i, "width": 300.0, "height": 12.0, "size": 10.0} | more for i, t in enumerate(texts)])


@pytest.fixture(scope="session")
def no_nodes(frame):
    return frame("nodes", [])


@pytest.fixture(scope="session")
def odd_tables(spark, tables, tmp_path_factory):
    """Two folders of all tables: without rows, and with nulls, repeats, long texts and clashing columns."""
    names = ["elements", "nodes", "extract_pages", "ocr_jobs", "sources", "diagnostics", "env_refs", "documents", "lang_codes", "given_names", "mix_targets"]
    empty, odd = (str(tmp_path_factory.mktemp(k)) for k in ("empty", "odd"))
    for n in names:
        t = tables(n)
        t.limit(0).write.parquet(f"{empty}/{n}.parquet")
        nulls = t.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema])
        rows = t.limit(40).unionByName(t.limit(5)).unionByName(nulls).unionByName(nulls)
        if "text" in t.columns:
            long = t.limit(3).withColumn("text", F.repeat(F.lit("Zażółć gęślą jaźń é 12/34 a@b "), 3000))
            rows = rows.unionByName(long).unionByName(t.limit(2).withColumn("text", F.lit(""))).unionByName(t.limit(2).withColumn("text", F.lit(" \t\n")))
        for clash in ("tbl", "item_no", "running", "key", "n", "word", "start", "fixed", "anchor", "rate", "valid", "language"):
            if clash not in t.columns:
                rows = rows.withColumn(clash, F.lit("clash"))
        rows.write.parquet(f"{odd}/{n}.parquet")
    return {"empty": empty, "odd": odd}
