"""Every problem's queries over empty tables, and over nulls, repeats, long texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

from pagewright.llm import common, shared_spans
from pagewright.llm.queries import QUERIES

NAMES = ["p1_found", "p1_consistent", "p2_found", "p2_dialects", "p2_rates", "p3_found", "p3_documents", "p4_found", "p4_redacted", "p5_found", "p5_redacted", "p6_found", "p7_found", "p7_restored", "p8_ids", "p9_mixture", "p9_shares", "p10_found", "p10_report", "p10_units", "p10_text"]
KEYS = {"p1_found": 4, "p2_found": 1, "p3_found": 4, "p4_found": 2, "p5_found": 5, "p6_found": 5, "p7_found": 3}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, odd_tables, name):
    assert QUERIES[name](spark, odd_tables["empty"]).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, odd_tables, name):
    df = QUERIES[name](spark, odd_tables["odd"])
    rows = df.collect()
    if name in KEYS:
        assert len(df.columns) in (KEYS[name], KEYS[name] + 1)
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("hot_keys", [1, 3, 10_000])
def test_hot_keys_are_joined_apart(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    rows = spark.createDataFrame([(i, "a" if i % 3 == 0 else f"k{i % 40}") for i in range(600)] + [(999, None)], "id int, k string")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("k <> 'k1'")
    got = common.semi_join(rows, keys, ["k"], ["first"]).collect()
    want = {r.id for r in rows.where("k IS NOT NULL AND k <> 'k1'").collect()}
    assert {r.id for r in got} == want and len(got) == len(want) and all(r.first <= r.id for r in got)


def test_shared_spans_with_hot_boilerplate(frame, monkeypatch):
    """A third of all texts hold the same paragraph, and some are wholly equal."""
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    plate = "This paragraph stands in every third text. It says what all of them say, and says it once more here. " * 3
    texts = {i: f"Text {i} begins in its own way number {i * 7919}. " + (plate if i % 3 == 0 else "Nothing that others share stands here. "[: i % 30]) + f" And ends as {i}." for i in range(90)}
    texts |= {200 + i: "Equal as a whole. " * 15 for i in range(5)}
    docs = frame("documents", [{"doc_id": i, "text": t} for i, t in texts.items()])
    got = {r.doc_id: texts[r.doc_id][r.span_start : r.span_end] for r in shared_spans.shared_spans(docs, 200).collect()}
    assert set(got) == {i for i in texts if i % 3 == 0 and i < 90 or i >= 200}
    assert all(plate.strip() in t if i < 90 else t == texts[i] for i, t in got.items())
