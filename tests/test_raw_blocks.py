"""S2 in blocks: quoted line breaks across block borders, against the whole-file read."""

import csv
import io
import random

import pytest

from tableops.sources.raw import read_raw, read_raw_blocks


def cell(r, breaks):
    text = "".join(r.choice(["a", "b ", "é", ",", '"', *breaks, "", "x" * 30]) for _ in range(r.randint(0, 6)))
    return '"' + text.replace('"', '""') + '"' if r.random() < 0.3 or any(c in text for c in ',"\r\n') else text


@pytest.fixture()
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("seed, end, breaks", [(1, "\n", ["\n", "\n\n"]), (2, "\r\n", ["\r\n"]), (3, "\n", ["\n", "\r\n", "\n\n"])])
def test_blocks_equal_the_whole_file(spark, scratch, small_blocks, seed, end, breaks):
    r = random.Random(seed)
    want = []
    for f in range(3):
        rows = [[f"{f}-{k}", *(cell(r, breaks) for _ in range(3))] for k in range(120)]
        rows.insert(60, ["long", '"' + ("line" + end * 2) * 500 + '"', "", '""'])
        lines = [",".join(x) for x in rows]
        lines[5:5] = ["", ""]
        text = end.join(lines) + (end if f else "")
        want += [x for x in csv.reader(io.StringIO(text, newline="")) if x]
        with open(f"{scratch}/{f}.csv", "w", encoding="utf-8", newline="") as out:
            out.write(text)
    got = sorted(map(tuple, read_raw_blocks(spark, f"{scratch}/*.csv").collect()), key=lambda x: x[-1])
    assert [[c or "" for c in x[:-1]] for x in got] == want and [x[-1] for x in got] == list(range(len(want)))
    assert spark.read.text(f"{scratch}/*.csv").rdd.getNumPartitions() > 12
    if breaks[0] == end and "\r\n" not in breaks:  # Spark's reader guesses the line end from the file's beginning
        whole = read_raw(spark, f"{scratch}/*.csv", escape='"')
        assert whole.columns == ["_c0", "_c1", "_c2", "_c3", "row_ix"]
        assert sorted(map(tuple, whole.collect()), key=lambda x: x[-1]) == got


def test_positions_of_a_split_file_without_line_breaks_in_cells(spark, scratch, small_blocks):
    for f in range(2):
        with open(f"{scratch}/{f}.csv", "w") as out:
            out.write("".join(f"{f},{k}\n" for k in range(2000)))
    rows = read_raw(spark, f"{scratch}/*.csv", multiLine="false").collect()
    assert {(x._c0, x._c1, x.row_ix) for x in rows} == {(str(f), str(k), 2000 * f + k) for f in range(2) for k in range(2000)}
    rows = read_raw_blocks(spark, f"{scratch}/*.csv").collect()
    assert {(x._c0, x._c1, x.row_ix) for x in rows} == {(str(f), str(k), 2000 * f + k) for f in range(2) for k in range(2000)}


def test_open_quote_and_empty_files(spark, scratch):
    with open(f"{scratch}/a.csv", "w") as out:
        out.write("")
    assert read_raw_blocks(spark, f"{scratch}/a.csv").collect() == []
    with open(f"{scratch}/b.csv", "w") as out:
        out.write('1,2\n3,"open\nstill')
    rows = read_raw_blocks(spark, f"{scratch}/b.csv").collect()
    assert sorted((x.row_ix, x._c0) for x in rows) == [(0, "1"), (1, "3")]
