"""Collection as a stream against collection at once, also after a batch that dies."""

import json
import os

import pytest

from broadsheet.operators import crawl
from broadsheet.plans.collect import collect_articles
from broadsheet.sources.readers import crawl_index_stream, read_crawl_index
from broadsheet.streaming import collect as streaming

TEXT = "murder trial of the year " * 60


@pytest.fixture
def inputs(spark, tmp_path):
    sources = spark.createDataFrame([(i, f"S{i}", "TX", "c", f"s{i}.com") for i in range(3)],
                                    "source_id long, name string, state string, city string, URL string")
    pages = spark.createDataFrame([(f"f{f}", o, f"<body><p>{f} {o} {TEXT if o % 5 else 'short'}</p></body>") for f in range(3) for o in range(60)],
                                  "filename string, offset bigint, html string")
    files = []
    for n, collection in enumerate(["CC-MAIN-2018-43"] * 4 + ["CC-MAIN-2019-09"] * 2):
        lines = [{"url": f"https://s{i % 3}.com/{'murder' if i % 4 else 'x'}-{n}-{i}", "filename": f"f{i % 3}", "offset": str((7 * n + i) % 60), "length": "1"} for i in range(48)]
        files.append((collection, n, "".join(json.dumps(x) + "\n" for x in lines)))
    return sources, pages, files


def arrive(folder, files):
    for collection, n, text in files:
        (folder / f"collection={collection}").mkdir(parents=True, exist_ok=True)
        path = folder / f"collection={collection}" / f"{n}.json"
        path.write_text(text)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # in this order


def found(df):
    return sorted((r.source, r.year, r.url, tuple(r.matched_keywords), r.text) for r in df.collect())


def test_files_over_time_give_the_batch_result(spark, inputs, tmp_path, monkeypatch):
    sources, pages, files = inputs
    monkeypatch.setattr(crawl.cap_per_source_year, "__defaults__", (20,))
    incoming, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "done")
    run = lambda: streaming.collect_stream(crawl_index_stream(spark, str(incoming), 1), sources, pages, "2018-2024", out, checkpoint, k=20).awaitTermination()
    arrive(incoming, files[:2])
    run()
    arrive(incoming, files[2:4])

    real = streaming.url_netloc

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(streaming, "url_netloc", dies)  # articles and counts are written, the rest of the state is not
    with pytest.raises(Exception, match="lost"):
        run()
    before = found(streaming.collected(spark, out))
    monkeypatch.setattr(streaming, "url_netloc", real)
    run()
    assert len(found(streaming.collected(spark, out))) > len(before)
    arrive(incoming, files[4:])
    run()
    run()  # nothing new
    want = collect_articles(sources, read_crawl_index(spark, str(incoming)), pages, "2018-2024")
    assert found(streaming.collected(spark, out)) == found(want)
    taken = {(r.source_id, r.year): r.n for r in streaming.taken_per_source_year(spark, out).collect()}
    assert max(taken.values()) == 20 and sum(taken.values()) == want.count()
    last = {r.domain: r.last_year for r in streaming.collected_last_years(spark, out).collect()}
    assert last == {r.domain: r.last_year for r in crawl.last_year_per_domain(want).collect()} and set(last.values()) == {2019}


def test_state_is_empty_before_the_first_batch(spark, tmp_path):
    assert streaming.taken_per_source_year(spark, str(tmp_path)).count() == 0
    assert streaming.collected_last_years(spark, str(tmp_path)).columns == ["domain", "last_year"]
