"""The paged metadata source: windows, pages, pushed dates, retried calls."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringContains

from conftest import plan
from paperloom.sources import paged, remote

DAY0 = dt.date(1970, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    """Window 1 holds two thirds of all rows; two rows are equal, one has no date."""
    path = str(tmp_path_factory.mktemp("service"))
    rows = [(f"p{i}", f"t{i}", None, ["x", None] if i % 2 else None, day(35 if i % 3 else i)) for i in range(300)]
    rows += [rows[0], ("undated", "t", "a", [], None)]
    paged.write_pages(spark.createDataFrame(rows, paged.SCHEMA), path, page_rows=10)
    return path, rows[:-1]


def test_every_dated_row_is_served_once(spark, service):
    path, rows = service
    got = paged.read_pages(spark, path, pages_per_task=3)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
    assert got.rdd.getNumPartitions() > 10  # the full window is many tasks


def test_dates_are_pushed_and_applied(spark, service):
    path, rows = service
    for condition in ("published = DATE'1970-02-05'", "published > DATE'1970-02-05' AND published <= DATE'1970-06-01'", "published < DATE'1970-01-01'",
                      "published >= DATE'1970-03-01' AND title LIKE 't1%'", "published IS NULL", "published <=> DATE'1970-01-01'", "published = DATE'1970-02-05' OR title = 't0'"):
        got = paged.read_pages(spark, path).where(condition)
        want = spark.createDataFrame(rows, paged.SCHEMA).where(condition)
        assert sorted(r["title"] for r in got.collect()) == sorted(r["title"] for r in want.collect()), condition
    held = paged.read_pages(spark, path).where("published > DATE'1970-06-01'")
    assert "Filter (" not in plan(held) and "(published" in plan(held)
    assert held.rdd.getNumPartitions() < 15
    titles = paged.read_pages(spark, path, schema="title string").groupBy().agg(F.count("title"))
    assert titles.first()[0] == len(rows)


def test_windows_that_cannot_hold_a_row_are_not_asked(service):
    reader = paged.PagedReader(paged.FolderPages(service[0]), None, 1, 1, 0.0)
    contains = StringContains(("title",), "t")
    assert list(reader.pushFilters([GreaterThan(("published",), day(29)), LessThanOrEqual(("published",), day(89)), contains])) == [contains]
    assert {p.window for p in reader.partitions()} == {1, 2}
    assert list(reader.pushFilters([EqualTo(("published",), day(61))])) == []
    assert {p.window for p in reader.partitions()} == {2}


def test_failed_calls_are_tried_again():
    calls = []

    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "page"

    assert remote.retried(shaky, 3, 0.0) == "page"
    calls.clear()
    with pytest.raises(OSError):
        remote.retried(shaky, 2, 0.0)


def test_a_service_without_rows(spark, tmp_path):
    paged.write_pages(spark.createDataFrame([], paged.SCHEMA), str(tmp_path))
    assert json.loads((tmp_path / "windows.json").read_text()) == []
    assert paged.read_pages(spark, str(tmp_path)).count() == 0
