"""Paging: the bounded top-k and the distributed numbering agree."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from feedlens.operators import library
from feedlens.sources.feedback import feedback_from_tables


@pytest.fixture(scope="module")
def fb(spark):
    return feedback_from_tables(spark, SF_SMALL, with_text=False).cache()


@pytest.mark.parametrize("sort_key,size,page_no", [
    ("updated_desc", 10, 1), ("positive_desc", 20, 7), ("negative_desc", 5, 3),
    ("created_asc", 50, 2), ("", 10, 10_000),
])
def test_topk_and_numbered_pages_agree(fb, sort_key, size, page_no):
    topk = [r["id"] for r in library.page(fb, sort_key, size, page_no).collect()]
    numbered = [r["id"] for r in library.deep_page(fb, sort_key, size, page_no).collect()]
    assert topk == numbered and len(topk) > 0
    n = fb.count()
    if page_no * size > n:  # past the end: the last page
        assert len(topk) == n - (-(-n // size) - 1) * size


def test_shallow_page_plan_is_topk(fb):
    plan = library.page(fb, "updated_desc", 10, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_fetch_keeps_the_order(fb):
    ids = library.page(fb, "created_asc", 10, 2)
    rows = library.fetch(fb, ids, "created_asc").collect()
    assert [r["id"] for r in rows] == [r["id"] for r in ids.collect()] and "status" in rows[0].asDict()


SORTS = ["updated_desc", "updated_asc", "created_desc", "created_asc", "positive_desc", "negative_desc", "other"]


@pytest.mark.parametrize("sort_key", SORTS)
def test_every_page_from_either_end(spark, sort_key):
    """All pages together are the whole order, ties and nulls included, wherever a page is counted from."""
    rows = [(i, None if i % 5 == 0 else (i % 3) / 4, None if i % 7 == 0 else f"2026-01-0{1 + i % 4}", None if i % 4 == 0 else f"2026-01-1{i % 3}") for i in range(1, 24)]
    df = spark.createDataFrame(rows, "id long, sentiment double, c string, u string").select(
        "id", "sentiment", F.to_timestamp_ntz("c").alias("created_at"), F.to_timestamp_ntz("u").alias("updated_at"))
    whole = [r["id"] for r in library.sort_feedback(df, sort_key).collect()]
    paged = [r["id"] for p in range(1, 6) for r in library.page(df, sort_key, 5, p).collect()]
    assert paged == whole
    back = [r["id"] for r in df.orderBy(*library.sort_columns(sort_key, reverse=True)).collect()]
    assert back == whole[::-1]


@pytest.mark.parametrize("page_no", [1, 2, 10_000])
def test_the_last_page_keeps_as_few_rows_as_the_first(fb, page_no):
    size, n = 10, fb.count()
    plan = library.page(fb, "updated_desc", size, page_no)._jdf.queryExecution().executedPlan().toString()
    kept = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
    assert kept and max(kept) <= size * min(page_no, 2)
    last = -(-n // size)
    before = library.page(fb, "updated_desc", size, last - 1)._jdf.queryExecution().executedPlan().toString()
    assert max(int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", before)) <= 2 * size


def test_pages_of_an_empty_table(fb):
    none = fb.where("false")
    assert library.page(none, "updated_desc", 10, 1).collect() == [] and library.page(none, "updated_desc", 10, 7).collect() == []
