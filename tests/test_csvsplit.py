"""The split reader against Spark's whole-file reader."""

import random

import pytest
from twinledger.sources.csvsplit import ends_inside, scan_csv_split
from twinledger.sources.files import scan_csv


def plain_state(line, inside):
    """Character by character."""
    start, at = not inside, 0
    while at < len(line):
        c = line[at]
        if inside:
            if c == '"':
                if line[at + 1 : at + 2] == '"':
                    at += 1
                else:
                    inside = False
        elif c == ",":
            start = True
            at += 1
            continue
        elif c == '"' and start:
            inside = True
        start = False
        at += 1
    return inside


def test_states_of_lines():
    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choice('",ab"') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            assert ends_inside(line, inside) == plain_state(line, inside), (line, inside)


def field(rng):
    kind = rng.randrange(7)
    text = "".join(rng.choice(["x", "y ", "é", "\n", ",", '""', " 1"]) for _ in range(rng.randrange(9)))
    return [f'"{text}"', '""', "", "plain", '5 inch"', "a b", '"\n\n\n' + "long " * rng.randrange(60) + '\n"'][kind]


@pytest.fixture
def small_parts(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same(spark, path, header, parts=2):
    got, want = scan_csv_split(spark, path, header), scan_csv(spark, path, header)
    assert got.columns == want.columns
    told = lambda df: sorted(map(str, df.collect()))
    assert told(got) == told(want)
    assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() >= parts


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("header", [True, False])
def test_one_file_read_in_small_parts(spark, small_parts, tmp_path, end, header):
    rng = random.Random(3)
    rows = ['id,"the\nname",c'] + [f"{i},{field(rng)},{field(rng)}" for i in range(120)] + ["", "short", 'a,b,c,d,e', "last,one,"]
    (tmp_path / "a.csv").write_bytes(end.join(r.replace("\n", end) for r in rows).encode())
    same(spark, str(tmp_path / "a.csv"), header, 30)


def test_many_files_long_headers_and_open_quotes(spark, small_parts, tmp_path):
    rng = random.Random(4)
    head = 'id,"' + "very\nlong " * 40 + '"\n'
    for name in "abc":
        (tmp_path / f"{name}.csv").write_text(head + "".join(f"{name}{i},{field(rng)}\n" for i in range(30)))
    same(spark, str(tmp_path), True, 6)


def test_marks_empty_files_and_no_rows(spark, tmp_path):
    for name, text in (("mark", "﻿id,n\n1,2\n"), ("only", "id,n\n"), ("one", "id,n")):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
        same(spark, str(tmp_path / f"{name}.csv"), True, 1)
