"""Scans of some years or hosts read a part of the index table."""

import pytest

from broadsheet.operators import crawl
from broadsheet.sources import readers, writers


def scanned(df):
    """(files, rows) that the scan of a plan read."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    left = [plan]
    while left:
        node = left.pop()
        if "Scan" in node.nodeName():
            metrics = node.metrics()
            return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("crawl") / "index")
    names = ["CC-MAIN-2018-43", "CC-MAIN-2019-09", "CC-MAIN-2024-10", "CC-MAIN-2024-18"]
    rows = [(f"https://host{i % 50:02d}.com/{i}", f"f{i % 7}", i, 10, names[i % 4], i) for i in range(8000)]
    index = spark.createDataFrame(rows, "url string, filename string, offset bigint, length bigint, collection string, index_pos bigint")
    writers.write_crawl_index(index, path, 8, rows_per_group=100)
    return index, readers.read_crawl_table(spark, path)


def test_folders_of_other_years_are_not_read(spark, table):
    index, stored = table
    every, year = scanned(stored), scanned(crawl.of_years(stored, "2019"))
    assert every[1] == 8000 and year[1] == 2000 and year[0] < every[0]
    assert crawl.of_years(stored, "2021-2022").isEmpty() and crawl.of_years(stored, "2018-2024").count() == 8000
    plan = crawl.of_years(stored, "2019")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan and "CC-MAIN-2019-09" in plan


def test_row_groups_without_the_host_are_skipped(spark, table):
    index, stored = table
    found = crawl.of_hosts(crawl.of_years(stored, "2018"), ["host04.com"])
    assert found.count() == index.where("url LIKE 'https://host04.com/%' AND collection = 'CC-MAIN-2018-43'").count() > 0
    assert scanned(found)[1] < 1000  # of 2,000 in the folder


def test_candidates_are_the_same_from_the_table(spark, table):
    index, stored = table
    sources = spark.createDataFrame([(i, f"S{i}", "TX", "c", f"host{i:02d}.com") for i in range(5)],
                                    "source_id long, name string, state string, city string, URL string")
    targets = crawl.crawl_targets(sources, "2018-2019")
    columns = ["source", "year", "url", "collection", "variant_pos"]
    plain = crawl.crawl_candidates(targets, index).select(*columns)
    pruned = crawl.crawl_candidates(targets, crawl.of_years(stored, "2018-2019")).select(*columns)
    assert plain.exceptAll(pruned).isEmpty() and pruned.exceptAll(plain).isEmpty() and plain.count() > 100
