from __future__ import annotations

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens import schemas
from termlens.sources import ranges, readers, writers

TEXTS = ["plain", "a,b", 'say "yes"', "two\nlines", '"', '""', "\n\n", "x\r\ny", "é漢", '","', "end\n", 'a"\n"b', " ", '5" pipe']


def _read(spark, path, names, **more):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return sorted(map(tuple, readers.read_quoted(spark, str(path), schema, **more).collect()), key=str)


@pytest.mark.parametrize("range_bytes", [1, 60, 700])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_text_by_ranges(spark, tmp_path, range_bytes, ending):
    chance = random.Random(range_bytes)
    rows = []
    for part in range(3):
        out = io.StringIO()
        written = csv.writer(out, lineterminator=ending)
        written.writerow(["id", "head,er", "text"])
        for n in range(40 if range_bytes > 1 else 4):
            row = [str(100 * part + n), chance.choice(TEXTS), "".join(chance.choices(TEXTS, k=chance.randrange(1, 6)))]
            rows.append(tuple(row))
            written.writerow(row)
            if chance.random() < 0.1:
                out.write(ending)
        (tmp_path / f"{part}.csv").write_bytes(out.getvalue().encode())
    got = _read(spark, tmp_path, ["id", "head,er", "text"], range_bytes=range_bytes)
    assert got == sorted(rows, key=str)


def test_quotes_inside_unquoted_values_and_no_last_line_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,size\nnail,5"\npipe,3" x 4"\n"cap, small","1\n2"\nlast,"x"')
    assert _read(spark, tmp_path, ["size", "name"], range_bytes=7) == [('1\n2', "cap, small"), ('3" x 4"', "pipe"), ('5"', "nail"), ("x", "last")]
    with pytest.raises(ValueError, match="other"):
        _read(spark, tmp_path, ["other"])


def test_header_only_and_other_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\tb\n")
    (tmp_path / "b.csv").write_text('a\tb\n"1\t\n2"\t,\n')
    assert _read(spark, tmp_path, ["a", "b"], separator="\t", range_bytes=3) == [("1\t\n2", ",")]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rows = "".join(f'{n},"text\n{n}"\n' for n in range(2_000))
    (tmp_path / "a.csv").write_text("id,text\n" + rows)
    pieces = ranges._pieces(ranges._twin(spark, 4_000), str(tmp_path), "\n")
    assert pieces.rdd.getNumPartitions() >= 8
    records = ranges.read_records(spark, str(tmp_path), "\n", ranges.CsvQuoting(), 4_000)
    assert records.count() == 2_001 and records.select("block").distinct().count() >= 8
    assert readers.read_quoted(spark, str(tmp_path), T.StructType([T.StructField("id", T.IntegerType())]), range_bytes=4_000).agg(F.sum("id")).first()[0] == 1_999_000


def test_session_is_left_as_it_is(spark, tmp_path):
    before = dict(spark.conf.getAll)
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    frame = readers.read_quoted(spark, str(tmp_path), T.StructType([T.StructField("a", T.StringType())]), range_bytes=5)
    assert dict(spark.conf.getAll) == before
    assert frame.sparkSession is spark


ODD = ["a", "a,b", '"', '", "', "\\", '\\"', "{x}", "}", ": 5", "é", "\n", "tab\t", "", " ", ",", '",', "1"]


@pytest.mark.parametrize("range_bytes", [3, 50, None])
def test_json_dictionary(spark, tmp_path, range_bytes):
    words = {word: n + 1 for n, word in enumerate([*ODD, *(f"w{n}" for n in range(20 if range_bytes == 3 else 200))])}
    (tmp_path / "word_index.json").write_text(json.dumps(words))
    got = readers.read_json_dictionary(spark, str(tmp_path / "word_index.json"), range_bytes)
    assert dict(map(tuple, got.collect())) == words
    if range_bytes == 50:
        path = str(tmp_path / "parts")
        writers.write_json_dictionary(got.repartition(4), path)
        assert dict(map(tuple, readers.read_json_dictionary(spark, path, 70).collect())) == words
        files = sorted((tmp_path / "parts").glob("part-*"))
        joined = json.loads("".join(f.read_text() for f in files))
        assert list(joined.items()) == list(words.items())
        writers.write_json_dictionary(got, path, single_file=True)
        (only,) = (tmp_path / "parts").glob("part-*")
        assert json.loads(only.read_text()) == words


def test_json_dictionary_of_several_files(spark, tmp_path):
    for part, text in enumerate(['{"a":1\n', ', "b, ":2\n, "c":3\n', ', "d":4}\n']):
        (tmp_path / f"part-{part}.txt").write_text(text)
    read = readers.read_json_dictionary(spark, str(tmp_path), 5)
    assert dict(map(tuple, read.collect())) == {"a": 1, "b, ": 2, "c": 3, "d": 4}


def test_empty_json_dictionary(spark, tmp_path):
    path = str(tmp_path / "none")
    writers.write_json_dictionary(spark.createDataFrame([], schemas.VOCABULARY), path)
    assert readers.read_json_dictionary(spark, path).count() == 0
