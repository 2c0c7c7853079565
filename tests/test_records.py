"""Records of split CSV files against Python's reader."""

import csv
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from broadsheet.dims import SURVEY_QUESTIONS
from broadsheet.operators import ratings
from broadsheet.sources import readers, records


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


CELLS = ["a", "", "x y", 'say "hi"', "one\ntwo", "\n", "p,q", '"', '""', "end\n\nof", ",", "é\n\"日\",本", "line\r\nbreak", " lead", "5' pipe"]


def csv_text(rows, ends="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=ends, quoting=quoting).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed,ends", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_split_files_read_as_pythons_reader_does(spark, small_blocks, tmp_path, seed, ends):
    rng = random.Random(seed)
    want = []
    for name in ("b.csv", "a.csv", "c.csv"):
        rows = [[rng.choice(CELLS) or "-", *(rng.choice(CELLS) for _ in range(3))] for _ in range(120)]
        want.append((name, rows))
        text = csv_text([["k", "l", "m", "n"], *rows], ends, csv.QUOTE_ALL if seed == 3 else csv.QUOTE_MINIMAL)
        (tmp_path / name).write_bytes((("﻿" if name == "b.csv" else "") + text).encode())
    (tmp_path / "d.csv").write_text("k,l,m,n\n\n1,2,3,4\n  \n5,5\" x,6,7")
    expected = [r for _, rows in sorted(want) for r in rows] + [["1", "2", "3", "4"], ["5", '5" x', "6", "7"]]
    lines = records.records(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    parsed = [next(csv.reader([r.record])) for r in lines.where("NOT is_header").orderBy("row_pos").collect()]
    assert parsed == expected
    got = readers.read_csv(spark, str(tmp_path)).orderBy("row_pos").collect()
    assert [[x or "" for x in r[:4]] for r in got] == expected and len({r.row_pos for r in got}) == len(expected)
    spread = records.cells(lines).groupBy("row_pos").agg(F.array_sort(F.collect_list(F.struct("pos", "cell"))).alias("c")).orderBy("row_pos").collect()
    assert [[x.cell for x in r.c] for r in spread if [x.cell for x in r.c][1:] != ["l", "m", "n"]] == expected


def test_long_cells_over_many_blocks_and_one_open_quote(spark, small_blocks, tmp_path):
    long = "\n".join(f"line {i}, with \"\"quotes\"\"" for i in range(300))
    (tmp_path / "f.csv").write_text(f'a,b\n1,"{long}"\n2,x\n3,"{long}"\n')
    got = readers.read_csv(spark, str(tmp_path / "f.csv")).orderBy("row_pos").collect()
    assert [(r.a, r.b == (long.replace('""', '"') if r.a != "2" else "x"), r.row_pos) for r in got] == [("1", True, 1), ("2", True, 2), ("3", True, 3)]
    (tmp_path / "open.csv").write_text('a,b\n1,"never\n' + "x\n" * 500)
    with pytest.raises(Exception, match="a quote is never closed"):
        records.records(spark, str(tmp_path / "open.csv"), most=20).collect()
    assert records.records(spark, str(tmp_path / "open.csv"), quoted=False).count() == 502


def test_plan_reads_lines_and_groups_only_records_of_several(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,2\n")
    plan = readers.read_csv(spark, str(tmp_path / "f.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "Union" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_more_blocks_than_are_broadcast(spark, small_blocks, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "BROADCAST_BLOCKS", 0)
    (tmp_path / "f.csv").write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(200)))
    got = readers.read_csv(spark, str(tmp_path)).orderBy("row_pos").collect()
    assert [tuple(r) for r in got] == [(str(i), f"x\n{i}", i + 1) for i in range(200)]


def survey_csv(path, articles, raters=2):
    columns = [f"ART{a:04d}_{q}" for a in range(1, articles + 1) for q in SURVEY_QUESTIONS.values()]
    answers = lambda k: [["Yes", "No", "White", "Male", "Hispanic", "unknown", f"crime {(a + k) % 3}"][j] for a in range(articles) for j in range(7)]
    rows = [["Started", *columns], ["Start", *("What,\nthen?" for _ in columns)], ["{}", *('{"ImportId":"QID1"}' for _ in columns)]]
    rows += [[f"day {k}", *answers(k)] for k in range(raters)] + [["x", "", *("Yes" for _ in columns[1:])]]
    path.write_text(csv_text(rows))
    return str(path)


def test_cells_and_wide_sheet_give_the_same_ratings(spark, tmp_path):
    path = survey_csv(tmp_path / "s.csv", 3)
    wide = ratings.human_ratings(readers.read_survey(spark, path)).collect()
    long = ratings.human_ratings(readers.read_survey_cells(spark, path))
    assert sorted(map(str, long.select(*wide[0].__fields__).collect())) == sorted(map(str, wide)) and len(wide) == 3
    with pytest.raises(Exception, match="more survey rows than raters"):
        ratings.survey_answers(readers.read_survey_cells(spark, survey_csv(tmp_path / "t.csv", 2, 3))).collect()
    one = readers.read_survey_cells(spark, survey_csv(tmp_path / "u.csv", 2, 1))
    assert {r.rater for r in ratings.survey_answers(one).collect()} == {"Eleanor"} and ratings.human_ratings(one).count() == 0


def test_lines_are_scanned_once_for_records_and_exports_once_for_cells(spark, tmp_path):
    path = survey_csv(tmp_path / "s.csv", 3)
    plan = records.records(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # whole records, and the blocks that share one
    cells = readers.read_survey_cells(spark, path)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Join" not in plan and cells.count() == 4 * 22


def test_cells_without_a_name_and_names_without_a_cell(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\nq,q,q\n1\n1,2,3,4\n")
    (tmp_path / "b.csv").write_text("d\nq\n5,6\n")
    got = readers.read_survey_cells(spark, str(tmp_path)).orderBy("row_pos", "pos").collect()
    assert [tuple(r) for r in got] == [(0, 2, 0, "a", "1"), (0, 3, 0, "a", "1"), (0, 3, 1, "b", "2"), (0, 3, 2, "c", "3"), (4, 6, 0, "d", "5")]


def test_five_thousand_articles(spark, tmp_path):
    path = survey_csv(tmp_path / "s.csv", 5000)
    start = time.time()
    rows = ratings.human_ratings(readers.read_survey_cells(spark, path)).collect()
    assert len(rows) == 5000 and time.time() - start < 60
    by_article = {r.art_num: r for r in rows}
    assert by_article[7].eleanor_crime_label == "crime 0" and by_article[7].sarah_crime_label == "crime 1" and by_article[5000].sarah_victim_race == "other"


def test_wide_sheet_of_many_columns(spark):
    columns = [f"ART{a:04d}_{q}" for a in range(1, 201) for q in SURVEY_QUESTIONS.values()]
    frame = spark.createDataFrame([["R", *map(str, range(len(columns)))]], ", ".join(f"`{c}` string" for c in ["rater", *columns]))
    got = {r.col: r.value for r in ratings.survey_unpivot(frame).collect()}
    assert got == {c: str(i) for i, c in enumerate(columns)}
