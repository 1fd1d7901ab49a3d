from __future__ import annotations

import pytest

from checks import queries
from termlens import schemas
from termlens.sources import readers, workspace, writers


def test_quotes_and_line_breaks_survive(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", 'a "quoted", text'), ("2", "two\nlines"), ("3", None)],
        schemas.DESCRIPTIONS_TEXT,
    )
    path = str(tmp_path / "csv")
    writers.write_delimited(rows, path, escape='"')
    read = readers.read_delimited(spark, path, schemas.DESCRIPTIONS_TEXT, escape='"', multi_line=True)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))


def test_other_separator_and_single_file(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "id / 2 as prediction").repartition(4)
    path = str(tmp_path / "csv")
    writers.write_delimited(rows, path, separator=";", single_file=True)
    assert len(list((tmp_path / "csv").glob("part-*"))) == 1
    read = readers.read_delimited(spark, path, schemas.SCORES, separator=";")
    assert read.exceptAll(rows).count() == 0


def test_columns_are_found_by_name(spark, tmp_path):
    import pytest

    rows = spark.createDataFrame([("7", "12", "title", "term", "2.5")], "id string, product_uid string, product_title string, search_term string, relevance string")
    path = str(tmp_path / "csv")
    writers.write_delimited(rows, path)
    read = readers.read_delimited(spark, path, schemas.LABELLED_PAIRS_TEXT)
    assert [tuple(r) for r in read.collect()] == [("12", "title", "term", "2.5")]
    numbers = readers.read_delimited(spark, path, schemas.SCORES.__class__([schemas.SCORES["id"]]))
    assert [tuple(r) for r in numbers.collect()] == [(7,)]
    with pytest.raises(ValueError, match="prediction"):
        readers.read_delimited(spark, path, schemas.SCORES)


def test_json_keeps_integer_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, [1, 2], [], 2.5)], schemas.ENCODED)
    path = str(tmp_path / "json")
    writers.write_json_lines(rows, path)
    assert [tuple(r) for r in readers.read_json_lines(spark, path, schemas.ENCODED).collect()] == [
        (1, 5, [1, 2], [], 2.5)
    ]


def test_stored_tables_lie_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert workspace.shared_folder(spark) == shared
    assert workspace.new_folder(spark, "x") != workspace.new_folder(spark, "x")
    stored = workspace.materialize(spark.range(3), "x")
    assert stored.inputFiles()[0].startswith(f"file://{shared}/termlens/x-")


def test_stored_tables_can_be_removed(spark, monkeypatch):
    import os

    monkeypatch.setattr(workspace, "_made", [])
    folder = workspace.materialize(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(folder)
    workspace.remove_stored(spark)
    assert not os.path.exists(folder) and not workspace._made


def test_preview_is_ordered(spark):
    assert [r[0] for r in writers.preview(spark.range(100).repartition(3), "id", n=3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("name", ["scan_quoted_csv", "score_new_pairs"])
def test_whole_tables_are_not_written_by_one_task(spark, tiny, monkeypatch, name):
    calls, plain = [], queries.writers.write_delimited

    def kept(df, path, *args, **settings):
        calls.append(settings)
        plain(df, path, *args, **settings)

    monkeypatch.setattr(queries.writers, "write_delimited", kept)
    assert queries.QUERIES[name](spark, tiny).count() > 0
    assert calls and not any(settings.get("single_file") for settings in calls)
