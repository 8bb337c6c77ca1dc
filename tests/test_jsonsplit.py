"""The split reader against Spark's whole-file reader."""

import json
import random

import pytest
from pyspark.errors import PythonException
from twinledger.sources.files import scan_json
from twinledger.sources.jsonsplit import json_records, moves, scan_json_split

SCHEMA = "id long, name string, more struct<a: array<struct<b: string, c: double>>, d: string>"


def plain_moves(piece, inside):
    """Character by character; a backslash, which stands in strings only, takes the next one with it."""
    depth, at = 0, 0
    while at < len(piece):
        c = piece[at]
        if c == "\\":
            at += 1
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += (c in "{[") - (c in "}]")
        at += 1
    return inside, depth


def test_moves_of_pieces():
    rng = random.Random(1)
    for _ in range(20_000):
        piece = "".join(rng.choice(['"', "{", "[", "]", ":", "a", '\\"', "\\\\"]) for _ in range(rng.randrange(10)))
        flip, *moved = moves(piece)
        for inside in (False, True):
            assert plain_moves(piece, inside) == (inside ^ flip, moved[inside]), piece


@pytest.fixture
def small_parts(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def record(rng, i):
    text = lambda: "".join(rng.choice(["}", "{", "]", '"', "\\", "\n", "é", "word ", "},{", "漢", '"}']) for _ in range(rng.randrange(9)))
    made = {"id": i, "name": text()}
    if rng.random() < 0.7:
        made["more"] = {"a": [{"b": text(), "c": rng.random()} for _ in range(rng.randrange(4))], "d": "long } " * rng.randrange(40)}
    return made


def told(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("count", [0, 1, 90])
def test_one_array_read_in_small_parts(spark, small_parts, tmp_path, indent, count):
    rng = random.Random(count)
    rows = [record(rng, i) for i in range(count)]
    path = str(tmp_path / "a.json")
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False) + "\n" * rng.randrange(3), encoding="utf-8")
    want = told(scan_json(spark, path, SCHEMA))
    assert len(want) == count and told(scan_json_split(spark, path, SCHEMA)) == want
    if count > 1:
        assert json_records(spark, path).rdd.getNumPartitions() > 30
        got, plain = scan_json_split(spark, path), scan_json(spark, path)
        assert got.schema == plain.schema and told(got) == told(plain)


def test_many_files_of_all_kinds(spark, small_parts, tmp_path):
    rng = random.Random(7)
    rows = [record(rng, i) for i in range(60)]
    (tmp_path / "array.json").write_text(" \n" + json.dumps(rows[:20]))
    (tmp_path / "marked.json").write_text("﻿" + json.dumps(rows[20:30], indent=1), encoding="utf-8")
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows[30:58]))
    (tmp_path / "object.json").write_text(json.dumps(rows[58], indent=4) + "\n\n")
    (tmp_path / "last.json").write_text(json.dumps([rows[59]]))
    for name, text in (("empty", ""), ("blank", " \n"), ("none", " [ ] \n")):
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "all.txt").mkdir()
    (tmp_path / "all.txt" / "x.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = scan_json_split(spark, [str(p) for p in tmp_path.glob("*.json")], SCHEMA)
    assert told(got) == told(scan_json(spark, str(tmp_path / "all.txt"), SCHEMA, json_lines=True))


@pytest.mark.parametrize("text", ['[{"a":1},{"a":2', '[{"a":1}', '[{"a":"x}', '[1,{"a":1}]', '[{"a":1},2]', '[{"a":1},', '"a"', '[{"a":{"b":1}'])
def test_broken_files_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(PythonException, match="JSON"):
        json_records(spark, str(tmp_path / "a.json")).collect()


def test_a_large_batch_is_taken_in_few_rows_at_a_time():
    """A batch of Arrow rows, however large, becomes Python values slice by slice."""
    import tracemalloc

    import pyarrow as pa
    from twinledger.sources import jsonsplit

    pieces = pa.array([("[" if i == 0 else ",") + '{"a":"' + "é" * 1000 + '"' for i in range(10_000)] + ["]"])
    whole = pa.RecordBatch.from_arrays([pa.array(["f"] * 10_001), pa.array([0] * 10_001), pieces], names=["file", "part", "piece"])
    records = pa.RecordBatch.from_arrays([pa.array([p + "}" for p in pieces.to_pylist()[:-1]])], names=["record"])
    for work, batch, count in ((jsonsplit._told, whole, 1), (jsonsplit._checked, records, 10_000)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in work(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 4 << 20 and rows == count
        tracemalloc.stop()
