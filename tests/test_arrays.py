"""One JSON array read by many tasks against a plain parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from faultweave.sources.arrays import read_array, scan
from faultweave.sources.tickets import read_tickets


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    yield
    spark.conf.set(name, before)


def items(seed, n):
    pick = random.Random(seed)
    text = lambda: "".join(pick.choices('ab{}[],":\\ \n\té😀', k=pick.randint(0, 30)))
    deep = lambda d: {text(): deep(d - 1) if d else text(), "l": [text(), {}, [1, {"x": text()}], None]}
    return [deep(pick.randint(0, 3)) for _ in range(n)]


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_objects_across_splits(spark, tmp_path, small_splits, style):
    files = {f"{k}.json": items(k, n) for k, n in enumerate((40, 0, 1, 25))}
    for name, values in files.items():
        (tmp_path / name).write_text("\n " + json.dumps(values, **style) + "\n")
    (tmp_path / "empty.json").write_text("")
    rows = read_array(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.element] = json.loads(r.text)
    assert got == {name: dict(enumerate(values)) for name, values in files.items() if values}


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    tickets = [{"key": f"T-{i}", "summary": "} , {\"" * 5, "labels": ["a", "b"], "comments": [{"author": "x", "body": "{"}]} for i in range(60)]
    (tmp_path / "t.json").write_text(json.dumps(tickets))
    tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).select(F.spark_partition_id()).distinct().count()
    assert tasks > 10
    rows = read_tickets(spark, str(tmp_path), "array").orderBy("seq").collect()
    assert [(r.seq, r.key, r.summary, r.labels) for r in rows] == [(i, t["key"], t["summary"], t["labels"]) for i, t in enumerate(tickets)]


@pytest.mark.parametrize("text", ['[{"a": 1}, 2]', '[{"a": 1} {"b": 2}]', '[{"a": 1},]', '[,{"a": 1}]', '[{"a": 1}]x', '[{"a": "}]', '[[{"a": 1}]]', "[1]", '[{"a": 1}][]'])
def test_other_files_are_errors(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Exception, match="no JSON array"):
        read_array(spark, str(tmp_path)).collect()


def test_scan_of_a_piece():
    assert scan('{"a": "x', False) == (True, 1)
    assert scan('", "b": 1', True) == (False, -1)
    assert scan('\\" { still', True) == (True, 0)
    assert scan('[{"}": {"x": 1', False) == (False, 2)
