"""CSV records and cells: brute force by a plain reader, blocks of any size, wide rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from chronoforge.sources import delimited, dynamic, imports, l2t


def plain_reader(text, trim):
    """Records of cells, by one pass over the characters."""
    out, lines = [], text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    lines = [x[:-1] if x.endswith("\r") else x for x in lines]
    k = 0
    while k < len(lines):
        line, cells, at = lines[k], [], 0
        k += 1
        if line == "":
            continue
        while True:
            while trim and at < len(line) and line[at] in " \t":
                at += 1
            if at < len(line) and line[at] == '"':
                at, cell, closed = at + 1, "", False
                while True:
                    if at >= len(line):
                        if k >= len(lines):
                            break
                        line, at, cell, k = lines[k], 0, cell + "\n", k + 1
                    elif line[at] != '"':
                        cell, at = cell + line[at], at + 1
                    elif line[at + 1 : at + 2] == '"':
                        cell, at = cell + '"', at + 2
                    elif at + 1 == len(line) or line[at + 1] == ",":
                        at, closed = at + 1, True
                        break
                    else:
                        cell, at = cell + '"', at + 1
                cells.append(cell)
                if not closed:
                    break
            else:
                end = line.find(",", at)
                end = len(line) if end < 0 else end
                cells.append(line[at:end])
                at = end
            if at >= len(line):
                break
            at += 1
        out.append(cells)
    return out


def made(rng, n):
    """Lines of quotes, commas, blanks and breaks in any order."""
    return "".join(rng.choice(['"', '""', ",", "a", "b c", " ", "\n", "\r\n", '",', ',"', '"\n']) for _ in range(n))


def read(spark, folder, breaks, trim):
    rows = delimited.records(spark, [folder], breaks, trim).select("file", delimited.cells(F.col("record"), trim).alias("c")).collect()
    out = {}
    for r in rows:
        out.setdefault(r.file.rsplit("/", 1)[1], []).append(r.c)
    return out


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_records_equal_a_plain_reader(spark, tmp_path, trim, block):
    rng, want = random.Random(block + trim), {}
    for k in range(12):
        text = "head,\n" + made(rng, 60 if k else 0)
        (tmp_path / f"f{k}").write_bytes(text.encode())
        if rows := plain_reader(text, trim)[1:]:
            want[f"f{k}"] = sorted(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        assert {k: sorted(v) for k, v in read(spark, str(tmp_path), True, trim).items()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_without_line_breaks_need_no_second_look(spark, tmp_path):
    text = "head,b\n\nhead,b\n1,\"x, y\"\r\n\n \n\"\",''\n"
    (tmp_path / "f").write_bytes(text.encode())
    assert not delimited.breaks_lines(spark, [str(tmp_path)])
    for breaks in (True, False):
        assert sorted(read(spark, str(tmp_path), breaks, False)["f"]) == sorted(plain_reader(text, False)[1:]) == [["", "''"], [" "], ["1", "x, y"], ["head", "b"]]


def test_line_breaks_in_quotes_are_read_by_all_tasks(spark, tmp_path):
    with (tmp_path / "f.csv").open("w") as f:
        f.write("datetime,message\n")
        for k in range(60_000):
            f.write(f'2020-01-02T03:04:05Z,"line {k}\nand ""more"" of it,\n"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        got = dynamic.read(spark, [str(tmp_path)], ["datetime", "message"])
        assert delimited._lines(spark, [str(tmp_path)]).rdd.getNumPartitions() >= 20
        one = got.agg(F.count(F.lit(1)), F.count_distinct("desc"), F.min("desc")).first()
        assert tuple(one) == (60_000, 60_000, 'line 0\nand "more" of it,')
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("multiline", [True, False])
def test_wide_rows(spark, tmp_path, multiline):
    wide = ",".join(["x"] * 200_000)
    (tmp_path / "f.csv").write_text(f'datetime,message\n2020-01-02T03:04:05Z,m,{wide}\n2020-01-02T03:04:06Z,"{"," * 20_000}"\n,\n')
    began = time.time()
    got = dynamic.read(spark, [str(tmp_path)], ["datetime", "message"], multiline)
    assert sorted(n for (n,) in got.select(F.length("extra")).collect()) == [0, 0, 200_000 * len("unknown: x; ") - 2]
    assert time.time() - began < 30
    assert got.filter("desc = ''").count() == 1


def test_l2t_cells_keep_their_blanks(spark, tmp_path):
    (tmp_path / "f.csv").write_text(",".join(l2t.COLUMNS) + '\n01/15/2025,10:30:00,UTC,M...,EVT, st,"a ""b"" c",us,"h\no", "sh",de,2,fi,in,no,fo,ex\n')
    r = imports.read_all(spark, [str(tmp_path / "f.csv")]).first()
    assert (r.sourcetype, r.type, r.host, r.desc, r.extra) == (" st", 'a "b" c', "h\no", "de", "ex")
