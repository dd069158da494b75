"""Arrays cut at any byte read like the whole text."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from quilt.sources import adjacency, json_array


@pytest.fixture
def cut_small(spark):
    """Byte ranges of a few dozen bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def hostile(r, n):
    text = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "語", "a", " ", "}]"]) for _ in range(r.randint(0, 25)))
    return [{"id": i, "s": text(), "l": [{"t": text(), "n": [i, [i]]} for _ in range(r.randint(0, 3))]} for i in range(n)]


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_equal_those_of_the_whole_text(spark, tmp_path, cut_small, indent):
    values = hostile(random.Random(indent or 0), 60)
    text = " \n" + json.dumps(values, indent=indent, ensure_ascii=indent is None) + "\n\n"
    found = json_array.read_elements(spark, put(tmp_path, "a.json", text))
    rows = found.collect()
    assert sorted((json.loads(x.value) for x in rows), key=lambda x: x["id"]) == values
    # lines count from one
    lines = text.split("\n")
    assert all(x.value[: x.value.index(",")].split("\n")[0] in lines[x.line - 1] for x in rows)


def test_many_tasks_read_one_file(spark, tmp_path, cut_small):
    values = hostile(random.Random(7), 300)
    path = put(tmp_path, "a.json", json.dumps(values))
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 100
    assert json_array.read_elements(spark, path).count() == 300


def test_an_element_longer_than_its_ranges_and_several_files(spark, tmp_path, cut_small):
    values = [{"id": 1}, {"id": 2, "s": "}" * 2000}, {"id": 3, "l": [{}] * 400}]
    folder = tmp_path / "f"
    folder.mkdir()
    put(folder, "a.json", json.dumps(values))
    put(folder, "b.json", json.dumps(values[::-1]))
    put(folder, "c.json", " [ ]\n")
    got = [json.loads(x.value) for x in json_array.read_elements(spark, str(folder)).collect()]
    assert sorted(x["id"] for x in got) == [1, 1, 2, 2, 3, 3] and all(x in values for x in got)


BAD = {
    "no array": '{"id": 1}',
    "no comma": '[{"id": 1} {"id": 2}]',
    "two commas": '[{"id": 1},, {"id": 2}]',
    "trailing comma": '[{"id": 1},]',
    "a number": '[{"id": 1}, 7, {"id": 2}]',
    "only numbers": "[1, 2]",
    "not closed": '[{"id": 1}, {"id": 2}',
    "closed twice": '[{"id": 1}]]',
    "brace after the end": '[{"id": 1}]}',
    "open string": '[{"id": "1}]',
    "text after the end": '[{"id": 1}] x',
    "wrong type": '[{"id": "one"}]',
    "bad element": '[{"id": 1}, {"id" 2}]',
    "two arrays": '[{"id": 1}][{"id": 2}]',
}


@pytest.mark.parametrize("name", sorted(BAD))
@pytest.mark.parametrize("small", [False, True])
def test_malformed_arrays_are_errors(spark, tmp_path, name, small, request):
    if small:
        request.getfixturevalue("cut_small")
    with pytest.raises((PySparkException, json_array.MalformedArray), match="line"):
        json_array.read_array(spark, put(tmp_path, "a.json", "\n\n" + BAD[name]), "id bigint").collect()


def test_the_line_of_a_bad_element_is_named(spark, tmp_path, cut_small):
    text = json.dumps([{"id": i} for i in range(40)], indent=0).replace('"id": 33', '"id": "x"')
    with pytest.raises(PySparkException, match=f"line {text[: text.index(chr(34) + 'x')].count(chr(10))}\\b"):
        json_array.read_array(spark, put(tmp_path, "a.json", text), "id bigint").collect()


def test_neighbourhoods_read_alike(spark, tmp_path, cut_small):
    r = random.Random(2)
    names = ["Artist", "Track", "Label", "", "Url"]
    rows = [{"id": i, "label": r.choice(names), "in": [{"rel": r.choice(names), "id": r.randrange(50)} for _ in range(r.randint(0, 5))] + r.choice([[], [None]]), "out": []} for i in range(50)]
    path = put(tmp_path, "a.json", json.dumps(rows))
    lines = put(tmp_path, "b.json", "\n".join(map(json.dumps, rows)))
    whole = sorted(map(str, adjacency.read_neighbourhoods(spark, path, "music").collect()))
    assert sorted(map(str, adjacency.read_neighbourhoods(spark, path, "music", split=True).collect())) == whole
    assert sorted(map(str, adjacency.read_neighbourhoods(spark, lines, "music", lines=True).collect())) == whole
    with pytest.raises(PySparkException):
        adjacency.read_neighbourhoods(spark, put(tmp_path, "c.json", '[{"id": 1, "label": "Nope"}]'), "music", split=True).collect()


def test_only_pieces_are_written(spark, tmp_path, monkeypatch):
    """Elements that lie in one range are cut where they are read, not stored once more."""
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"id":{i}}}' for i in range(50)) + "]")
    kept = []
    monkeypatch.setattr(json_array, "materialise", lambda df: kept.append(df) or df)
    assert json_array.read_elements(spark, str(tmp_path)).count() == 50
    assert [sorted({r.kind for r in df.collect()}) for df in kept] == [[0, 2]]
