"""Parsers, predicates, edits and stores on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from chronoforge.functions.schema import EVENT_COLUMNS, EVENT_SCHEMA, as_events
from chronoforge.functions.times import bucket_range, expand_date, l2t_date, l2t_time
from chronoforge.operators import aggregates, edits, pages, predicates
from chronoforge.operators.predicates import Request
from chronoforge.sources import dynamic, imports, jsonl, push, store, tln
from chronoforge.streaming import imports as live


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def events(spark, *rows):
    """Events of dicts, ids from 1."""
    data = [(k + 1, *(r.get(c, 0 if c in ("offset", "store_number", "store_index", "vss_store_number", "bookmark") else "") for c in EVENT_COLUMNS)) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, EVENT_SCHEMA)


def one(df, *cols):
    return tuple(df.select(*cols).first())


@pytest.mark.parametrize(
    ("value", "end", "want"),
    [
        ("2025", False, "2025-01-01 00:00:00"), ("2025", True, "2025-12-31 23:59:59"), ("2024-02", True, "2024-02-29 23:59:59"), (" 2025-02 ", False, "2025-02-01 00:00:00"),
        ("2025-02-15", True, "2025-02-15 23:59:59"), ("2025-13", True, "2025-13"), ("2025-01-01 10:00:00", True, "2025-01-01 10:00:00"), ("x", False, "x"), ("", True, ""),
    ],
)
def test_partial_dates(value, end, want):
    assert expand_date(value, end) == want


def test_bucket_ranges():
    assert bucket_range("2023-02") == ("2023-02-01 00:00:00", "2023-02-28 23:59:59")
    assert bucket_range("2023-02-03 04:00:00") == ("2023-02-03 04:00:00", "2023-02-03 04:59:59")


def test_l2t_dates_and_times(spark):
    df = spark.createDataFrame([("12/31/2024", "23:59:59"), ("2025-01-15", "garbage"), ("garbage", ""), ("13/01/2024", "7:00:00")], "d string, t string")
    assert [tuple(r) for r in df.select(l2t_date(F.col("d")), l2t_time(F.col("t"))).collect()] == [
        ("2024-12-31", "23:59:59"), ("2025-01-15", "00:00:00"), ("0000-00-00", "00:00:00"), ("0000-00-00", "7:00:00"),
    ]


def test_tln_fields(spark):
    text = "1539100800|FILE|H|u|2018-10-09T16:00:00; Content Modification Time; /a|b"
    out = tln.lines_to_events(lines(spark, text, "0|S|H|U|plain", "abc|S|H|U|D", "", "Time|Source|Host|User|Description"), 5).collect()
    assert [(r.ok, r.datetime, r.MACB, r.desc, r.type) for r in out] == [
        (True, "2018-10-09 16:00:00", "M...", "/a|b", "Content Modification Time"), (True, "Not a time", "", "plain", ""), (False, "Not a time", "", "D", ""),
    ]
    seven = tln.lines_to_events(lines(spark, "1|S|H|U|d|America/New_York|File: /var/log/syslog inode: 12345", "1|S|H|U|d|-|-", "1|S"), 7).collect()
    assert [(r.timezone, r.filename, r.inode, r.notes) for r in seven] == [("America/New_York", "/var/log/syslog", "12345", "File: /var/log/syslog inode: 12345"), ("UTC", "", "", ""), ("UTC", "", "", "")]


@pytest.mark.parametrize(
    ("obj", "want"),
    [
        ('{"__class_name__": "Filetime", "timestamp": 132500000000000000}', "2020-11-16 11:33:20"), ('{"__class_name__": "Filetime", "timestamp": 0}', "Not a time"),
        ('{"__class_name__": "Filetime", "timestamp": 2959780}', "1601-01-01 00:00:00"), ('{"__class_name__": "NotSet"}', "Not a time"),
        ('{"__class_name__": "PosixTime", "timestamp": 1705312200}', "2024-01-15 09:50:00"), ('{"__class_name__": "PosixTimeInMicroseconds", "timestamp": 1705312200000000}', "2024-01-15 09:50:00"),
        ('{"__class_name__": "JavaTime", "timestamp": 1705312200000}', "2024-01-15 09:50:00"), ('{"__class_name__": "CocoaTime", "timestamp": 727005000}', "2024-01-15 09:50:00"),
        ('{"__class_name__": "WebKitTime", "timestamp": 13349785800000000}', "2024-01-15 09:50:00"), ('{"__class_name__": "Odd", "timestamp": 1705312200}', "2024-01-15 09:50:00"),
        ('{"__class_name__": "Odd", "timestamp": -3}', ""), ('"text"', ""), ("{}", ""),
    ],
)
def test_json_time_objects(spark, obj, want):
    row = f'{{"data_type": "fs:stat", "date_time": {obj}, "timestamp_desc": "Metadata Modification Time", "pathspec": {{"a": 1}}}}'
    assert one(jsonl.lines_to_events(lines(spark, row)), "datetime", "source", "MACB", "extra") == (want, "FILE", "M.C.", "")


def test_json_rows(spark):
    out = jsonl.lines_to_events(
        lines(
            spark, '{"timestamp": 1705312200000000, "message": "m", "data_type": "a:b:c", "x": 1.5, "n": null, "b": false, "big": 4624.0, "store_number": "7", "offset": 2.9}',
            '{"timestamp": "2024-01-15T10:30:00Z", "source": "S", "tag_list": ["malware", 3, "suspicious"]}', "[1]", "oops", " ", '{"message": "first", "message": "last"}',
        )
    ).collect()
    assert [r.ok for r in out] == [True, True, False, False, True]
    assert (out[0].datetime, out[0].source, out[0].sourcetype, out[0].extra, out[0].store_number, out[0].offset) == ("2024-01-15 09:50:00", "A", "a:b:c", "b: false; big: 4624; x: 1.5", 7, 2)
    assert (out[1].datetime, out[1].source, out[1].tag) == ("2024-01-15 10:30:00", "S", "malware, suspicious")
    assert out[4].desc == "last"


def test_dynamic_headers(spark):
    header = ["datetime", "hostname", "custom_field", "host"]
    rows = spark.createDataFrame([("2018-10-09T16:00:00.5Z", " h ", "v", "second", "more"), ("-", None, "-", None, None)], "_c0 string, _c1 string, _c2 string, _c3 string, _o0 string")
    out = dynamic.cells_to_events(rows, header).select("datetime", "host", "extra", "timezone").collect()
    assert [tuple(r) for r in out] == [("2018-10-09 16:00:00", "h", "custom_field: v; host: second; unknown: more", "UTC"), ("", "", "", "UTC")]
    with pytest.raises(ValueError, match="header"):
        dynamic.cells_to_events(rows, ["a", "b"])


@pytest.mark.parametrize("multiline", [True, False])
def test_every_cell_beyond_the_header_is_kept(spark, tmp_path, multiline):
    many = [f"s{k}" for k in range(40)]
    lines = ["datetime,message", "2020-01-02T03:04:05Z,none", "2020-01-02T03:04:06Z,nine" + "".join(f",{x}" for x in many[:9]), "2020-01-02T03:04:07Z", '2020-01-02T03:04:08Z,"a,b"' + ",,-" * 6 + "," + ",".join(many) + ',"x,y"']
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("datetime,message\n2020-01-02T03:04:09Z,even\n")
    got = dynamic.read(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")], ["datetime", "message"], multiline)
    extra = {r.desc: r.extra for r in got.collect()}
    unknown = lambda cells: "; ".join(f"unknown: {x}" for x in cells)
    assert extra == {"none": "", "nine": unknown(many[:9]), "": "", "a,b": unknown([*many, "x,y"]), "even": ""}


def test_every_entry_of_the_source_mapping(spark):
    from chronoforge.functions.data_types import SOURCES, source_of

    kinds = spark.createDataFrame([(k,) for k in SOURCES], "d string").withColumn("s", source_of(F.col("d"))).select("d", "s.source", "s.sourcetype")
    assert {r.d: (r.source, r.sourcetype) for r in kinds.collect()} == {k: tuple(v) for k, v in SOURCES.items()}


def test_detection():
    assert imports.detect("a.csv", "date,time,timezone,MACB,source,sourcetype,type,user,host,short,desc,version,filename,inode,notes,format,extra") == "l2t"
    assert imports.detect("a.jsonl", '{"timestamp": 1, "message": "x"}') == "jsonl"
    assert imports.detect("a.txt", "12|S|H|U|D|T|N") == "l2ttln"
    assert imports.detect("a.csv", "when,Message") == "dynamic"
    assert imports.detect("a.csv", "x,y") is None
    assert imports.detect("a.json", "[]") is None


def test_import_of_files_store_and_export(spark, tmp_path):
    (tmp_path / "a.tln").write_text("Time|Source|Host|User|Description\n1539100800|FILE|H|U|one\nbad|FILE|H|U|two\n")
    (tmp_path / "b.csv").write_text('datetime,message,source\n2020-01-02T03:04:05Z,"x, ""y""",LOG\n')
    (tmp_path / "c.jsonl").write_text('{"timestamp": 1705312200000000, "message": "m", "source_short": "REG"}\nnope\n')
    l2t_header = "date,time,timezone,MACB,source,sourcetype,type,user,host,short,desc,version,filename,inode,notes,format,extra"
    (tmp_path / "d.csv").write_text(f"{l2t_header}\n01/15/2025,10:30:00,UTC,M...,EVT,st,ty,us,ho,sh,de,2,fi,in,no,fo,ex\n01/16/2025,10:30:00,UTC\n")
    got = imports.read_all(spark, [str(tmp_path / n) for n in ("a.tln", "b.csv", "c.jsonl", "d.csv")])
    assert {(r.import_format, r.events, r.excluded) for r in imports.summary(got).collect()} == {("tln", 1, 1), ("dynamic", 1, 0), ("jsonl", 1, 1), ("l2t", 2, 0)}
    out = str(tmp_path / "store")
    for _ in range(2):
        store.append(imports.kept(got), out)
    again = store.open_parquet(spark, out)
    assert again.count() == 10 and again.select("id").distinct().count() == 10 and again.agg(F.min("id")).first()[0] > 0
    assert again.filter("source = 'LOG'").first().desc == 'x, "y"'
    store.export_csv(again, str(tmp_path / "csv"), one_file=True)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns[0] == "datetime" and len(back.columns) == 23 and back.count() == 10


def test_stream_imports_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tln").write_text("1539100800|FILE|H|U|one\nbad|FILE|H|U|two\n")
    for _ in range(2):
        live.import_lines(spark, str(tmp_path / "in"), "tln", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert store.open_parquet(spark, str(tmp_path / "out")).count() == 1


def test_jdbc_round_trip(spark):
    url, driver = "jdbc:derby:memory:t;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = events(spark, {"datetime": "2024-01-01 00:00:00", "desc": "a\0b"}, {"datetime": "Not a time"})
    notes = spark.createDataFrame([(1, "2024-01-01 00:00:00", "n", "", "", 0)], "id long, datetime string, description string, tag string, color string, bookmark long")
    push.push_jdbc(rows, notes, url, driver=driver)
    back = spark.read.format("jdbc").options(url=url, dbtable="log2timeline", driver=driver).load()
    assert sorted((str(r["datetime"]), r["desc"]) for r in back.collect()) == [("2024-01-01 00:00:00", "ab"), ("None", "")]
    with pytest.raises(ValueError, match="empty"):
        push.push_jdbc(rows.limit(0), notes, url, driver=driver)


def test_small_csv_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("type,colorcode\na,RED\nb,\na,BLUE\n")
    assert {(r.key, r.color) for r in store.read_color_template(spark, str(tmp_path / "t.csv")).collect()} == {("a", "BLUE"), ("b", "WHITE")}
    (tmp_path / "q.csv").write_text("Name,SQL,Description,EID,OS,IP\nn,\"source = 'X'\",d\n")
    assert tuple(store.read_saved_queries(spark, str(tmp_path / "q.csv")).first()) == ("n", "source = 'X'", "d", "", "", "")
    with pytest.raises(ValueError, match="header"):
        store.read_saved_queries(spark, str(tmp_path / "t.csv"))


def test_predicates_skip_what_they_do_not_know():
    assert predicates.simple("nosuch", "=", "x") is None
    assert predicates.simple("host", "~", "x") is None
    assert predicates.predicate(Request()) is None
    assert predicates.asks_for_notes("source = 'examiner'") and predicates.asks_for_notes("host = 'x'") and not predicates.asks_for_notes("source = 'FILE'")
    with pytest.raises(ValueError, match="unknown"):
        predicates.simple("nosuch", "=", "x", strict=True)


def test_pages_do_not_overlap(spark):
    rows = events(spark, *({"datetime": f"2024-01-01 00:00:{k % 3:02d}"} for k in range(25)))
    got = [[r.id for r in pages.page(rows, n, 10).collect()] for n in (0, 1, 2, 3)]
    assert [len(g) for g in got] == [10, 10, 10, 5] and got[0] == got[1] and len({*got[1], *got[2], *got[3]}) == 25


def test_tags_dates_and_empty_tables(spark):
    rows = events(spark, {"tag": "malware"}, {"tag": "suspicious, lateral_movement"}, {"tag": "Malware", "datetime": "2024-01-01 00:00:00"}, {"datetime": "0000-00-00 00:00:00"})
    assert {r.tag for r in aggregates.distinct_tags(rows).collect()} == {"malware", "suspicious", "lateral_movement", "Malware"}
    assert one(aggregates.summary(rows), "events", "min_date", "max_date") == (4, "2024-01-01 00:00:00", "2024-01-01 00:00:00")
    empty = rows.limit(0)
    assert one(aggregates.min_max_date(empty), "min_date", "max_date") == ("", "") and aggregates.histogram(empty).count() == 0


def test_edits_guard_their_input(spark):
    rows, ids = events(spark, {"tag": "a, MAL"}, {"tag": ""}), spark.createDataFrame([(1,), (2,), (0,)], "id long")
    assert {r.id: r.tag for r in edits.add_tag(rows, ids, "mal").collect()} == {1: "a, MAL", 2: "mal"}
    with pytest.raises(ValueError, match="no event"):
        edits.add_tag(rows, ids.union(spark.createDataFrame([(9,)], "id long")), "x")
    bad = spark.createDataFrame([(1, "nosuch", "x", 1)], "id long, field string, value string, seq long")
    with pytest.raises(Exception, match="no such edit"):
        edits.update_fields(rows, bad).collect()


def test_blank_events(spark):
    r = as_events(spark.range(1), {}).first()
    assert r.datetime == "" and r.offset == 0 and list(r.asDict()) == EVENT_COLUMNS


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_stores_are_pruned_by_day_and_filtered_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [{"datetime": f"2024-01-{d:02d} 0{h}:00:00", "source": "S"} for d in range(1, 21) for h in range(3)] + [{"datetime": t} for t in ("Not a time", "", "0000-00-00 00:00:00", "2024-01-99 00:00:00")]
    store.append(events(spark, *rows), path)
    all_rows = store.open_parquet(spark, path)
    plain = all_rows.drop("event_date")
    for request in (
        Request(date_from="2024-01-05", date_to="2024-01-07"), Request([("datetime", ">=", "2024-01-18")]), Request([("datetime", "<=", "2024-01-02"), ("source", "=", "S")]),
        Request([("datetime", "=", "2024-01-03")]), Request([("datetime", ">=", "2024-01-19")], "OR", date_from="2024-01-05", date_to="2024-01-06"),
        Request([("source", "=", "S")], "OR", date_from="2024-01-05", date_to="2024-01-06", and_scopes=True), Request([("datetime", ">=", "2024-02-31 00:00:00")]), Request(),
    ):
        pruned = pages.found(all_rows, request)
        assert sorted(pruned.collect()) == sorted(pages.found(plain, request).collect())
        assert total_of(aggregates.histogram(all_rows, request)) == total_of(aggregates.histogram(plain, request))
    text = plan_of(pages.found(all_rows, Request(date_from="2024-01-05", date_to="2024-01-07")))
    assert "PartitionFilters: [(isnull(event_date" in text and "2024-01-05" in text.split("PartitionFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(datetime,2024-01-05" in text
    assert plan_of(aggregates.histogram(all_rows, Request())).split("== Physical Plan ==")[1].count("FileScan parquet") == 1
    assert pages.between(all_rows, "2024-01-05 01:00:00", "2024-01-06 00:00:00").count() == 3


def total_of(histogram):
    return sorted(map(tuple, histogram.collect()))


def test_json_lines_are_parsed_once(spark):
    rows = jsonl.lines_to_events(lines(spark, "{}").filter("value != 'x'")).filter("ok").select("datetime", "source", "extra", "offset")
    assert plan_of(rows).split("== Physical Plan ==")[1].count("parseJson") + plan_of(rows).split("== Physical Plan ==")[1].count("try_parse_json") == 1


@pytest.mark.parametrize("kind", ["Filetime", "PosixTimeInMicroseconds", "PosixTime", "FATDateTime", "WebKitTime", "CocoaTime", "JavaTime", "Odd"])
def test_hostile_times_are_blank_or_text(spark, kind):
    numbers = [9223372036854775807, -9223372036854775808, 10**30, -(10**30), 1e300, -1e300, 253402300800, 0.5]
    made = [f'{{"data_type": "x:y", "date_time": {{"__class_name__": "{kind}", "timestamp": {n}}}}}' for n in numbers] + [f'{{"timestamp": {n}, "message": "m"}}' for n in numbers]
    got = [r.datetime for r in jsonl.lines_to_events(lines(spark, *made)).collect()]
    import re

    assert len(got) == len(made) and all(g in ("", "Not a time") or re.fullmatch(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", g) for g in got)
    tln_rows = tln.lines_to_events(lines(spark, "9223372036854775807|S|H|U|d", "253402300800|S|H|U|d"), 5).collect()
    assert [r.datetime for r in tln_rows] == ["", ""]


def test_keys_that_stand_twice_take_their_last_value(spark):
    got = jsonl.lines_to_events(lines(spark, '{"a": 1, "message": "x", "a": {"n": 1}, "b": 2, "a": "z", "message": "y"}')).first()
    assert (got.desc, got.extra) == ("y", "a: z; b: 2")


def test_first_lines_of_small_and_large_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a b.tln").write_text("\n \n1|S|H|U|d\n2|S|H|U|e\n")
    (tmp_path / "large.tln").write_text("\n3|S|H|U|d\n" + "4|S|H|U|e\n" * 200)
    (tmp_path / "empty.tln").write_text("")
    monkeypatch.setattr(imports, "SMALL_FILE", 1000)
    got = imports.first_lines(spark, [str(tmp_path)])
    assert sorted((k.rsplit("/", 1)[1], v) for k, v in got.items()) == [("a b.tln", "1|S|H|U|d"), ("large.tln", "3|S|H|U|d")]
    assert imports.read_all(spark, [str(tmp_path)]).count() == 203


@pytest.mark.parametrize(
    ("text", "breaks"),
    [("a,b\n1,2\n", False), ('a,"b, c"\n"x ""y""",2\n', False), ('a,"b\nc"\n', True), ('a b"c,d\n', False), ('a "b",c\n', False), ('x"y,"abc\nd",e\n', True), ('"",""\r\n', False), ('"' + "a" * 50000 + '",b\n', False)],
)
def test_line_breaks_within_quotes(spark, tmp_path, text, breaks):
    (tmp_path / "f.csv").write_bytes(text.encode())
    assert imports.breaks_lines(spark, [str(tmp_path / "f.csv")]) == breaks


def test_csv_with_and_without_line_breaks_reads_alike(spark, tmp_path):
    (tmp_path / "a.csv").write_text('datetime,message,source\n2020-01-02T03:04:05Z,"x\ny",LOG\n2020-01-02T03:04:06Z,z,LOG\n')
    (tmp_path / "b.csv").write_text('datetime,message,source,host\n2020-01-02T03:04:05Z,"x, y",LOG,h\n')
    got = imports.read_all(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")])
    assert sorted(r.desc for r in got.collect()) == ["x\ny", "x, y", "z"]


def test_rows_out_of_an_l2t_window_are_counted(spark, tmp_path):
    header = "date,time,timezone,MACB,source,sourcetype,type,user,host,short,desc,version,filename,inode,notes,format,extra"
    days = "".join(f"01/{d:02d}/2025,10:30:00,UTC,M...,EVT,st,ty,us,ho,sh,de,2,fi,in,no,fo,ex\n" for d in range(1, 11))
    (tmp_path / "d.csv").write_text(f"{header}\n{days}")
    r = store.import_files(spark, [str(tmp_path / "d.csv")], str(tmp_path / "store"), "2025-01-03", "2025-01-07").first()
    assert (r.import_format, r.events, r.excluded) == ("l2t", 3, 7) and store.open_parquet(spark, str(tmp_path / "store")).count() == 3


def test_a_batch_run_again_is_not_added_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tln").write_text("1539100800|FILE|H|U|one\n")
    run = lambda: live.import_lines(spark, str(tmp_path / "in"), "tln", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    run()
    for f in (tmp_path / "ck" / "commits").iterdir():  # as if the driver was lost before the commit
        f.unlink()
    run()
    assert store.open_parquet(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "in" / "b.tln").write_text("1539100801|FILE|H|U|two\n")
    run()
    assert store.open_parquet(spark, str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("order_by", ["datetime", "host", "offset", "desc"])
def test_deep_pages_equal_plain_ones(spark, order_by):
    values = ["", "a", "ab", "abc", "b\u00e9", "日本", "\U0001f600", "Z"]
    rows = events(spark, *({"datetime": ["Not a time", "", "0000-00-00 00:00:00"][k % 3] if k % 9 == 0 else f"2024-0{k % 3 + 1}-1{k % 7} 00:00:{k % 50:02d}", "host": values[k * k % 8], "offset": k % 5 - 2, "desc": "d" * (k % 6)} for k in range(300))).cache()
    for number in (1, 2, 7, 15, 30, 31, 99):
        assert pages.page(rows, number, 10, order_by, deep=13).collect() == pages.page(rows, number, 10, order_by).collect()
    assert pages.last_page(rows, 70, order_by, deep=13).collect() == pages.page(rows, 5, 70, order_by).collect()
    assert pages.last_page(rows.limit(0), 70, order_by).count() == 0
    rows.unpersist()


@pytest.mark.parametrize("order_by", ["desc", "host", "offset"])
def test_deep_pages_take_few_scans_whatever_the_texts(spark, monkeypatch, order_by):
    monkeypatch.setattr(pages, "SAMPLED", 512)
    prefix = "HKEY_LOCAL_MACHINE\\" * 8
    rows = events(spark, *({"desc": f"{prefix}{k * 7919 % 3000:05d}", "host": f"{prefix[:147]}{k % 2}", "offset": k % 3} for k in range(3000))).repartition(3).cache()
    plain = [r.id for r in pages.ordered(rows, order_by).collect()]
    for number in (4, 30, 59, 60):
        spark.sparkContext.setJobGroup(f"page-{order_by}-{number}", "")
        near, k = pages._near(rows, order_by, 50 * (number - 1), 50, 100)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"page-{order_by}-{number}")) <= 10  # two rounds of two scans at most
        spark.sparkContext.setJobGroup("rest", "")
        assert near.count() < 1500 and k < 1000
        assert [r.id for r in pages.page(rows, number, 50, order_by, deep=100).collect()] == plain[50 * (number - 1) : 50 * number]
    rows.unpersist()


def test_deep_pages_of_nulls(spark):
    rows = spark.createDataFrame([(k, None if k % 3 else f"v{k}") for k in range(600)], "id long, host string")
    plain = [r.id for r in rows.orderBy("host", "id").collect()]
    for number in (2, 15, 40, 60):
        assert [r.id for r in pages.page(rows, number, 10, "host", deep=5).collect()] == plain[10 * (number - 1) : 10 * number]


def test_raw_searches_take_or_leave_notes(spark):
    rows = events(spark, {"source": "FILE", "desc": "x"}, {"source": "LOG", "desc": "x"})
    notes = spark.createDataFrame([(1, "2024-01-01 00:00:00", "n", "", "", 0)], "id long, datetime string, description string, tag string, color string, bookmark long")
    ids = lambda where: sorted(r.id for r in pages.raw_query(rows, where, notes).collect())
    assert ids("source = 'FILE'") == [1] and ids("desc = 'x'") == [-1, 1, 2] and ids("source = 'Examiner' OR source = 'LOG'") == [-1, 2]
    assert one(pages.raw_total(rows, "desc = 'x'", notes, 2), "total", "pages") == (3, 2)


def test_edits_of_a_store_rewrite_its_days(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(events(spark, {"datetime": "2024-01-01 00:00:00", "desc": "a"}, {"datetime": "2024-01-02 00:00:00", "desc": "b"}, {"datetime": "2024-01-03 00:00:00", "desc": "c"}, {"desc": "none"}, {"datetime": "2024-01-05 00:00:00", "desc": "e"}), path)
    untouched = {p.name for p in (tmp_path / "store" / "event_date=2024-01-05").iterdir()}
    ids = {r.desc: r.id for r in store.open_parquet(spark, path).collect()}
    changes = [(ids["a"], "datetime", "2024-01-02 05:00:00", 1), (ids["none"], "datetime", "2024-01-09 00:00:00", 1), (ids["c"], "datetime", "Not a time", 1), (ids["b"], "color", "RED", 1), (10**9, "color", "X", 1)]
    store.apply_edits(spark, path, spark.createDataFrame(changes, "id long, field string, value string, seq long"))
    got = {r.desc: (r.datetime, r.color, str(r.event_date)) for r in store.open_parquet(spark, path).collect()}
    assert got == {"a": ("2024-01-02 05:00:00", "", "2024-01-02"), "b": ("2024-01-02 00:00:00", "RED", "2024-01-02"), "c": ("Not a time", "", "None"), "none": ("2024-01-09 00:00:00", "", "2024-01-09"), "e": ("2024-01-05 00:00:00", "", "2024-01-05")}
    assert {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()} == {f"event_date={d}" for d in ("2024-01-02", "2024-01-05", "2024-01-09", "__HIVE_DEFAULT_PARTITION__")}
    assert {p.name for p in (tmp_path / "store" / "event_date=2024-01-05").iterdir()} == untouched
    store.apply_edits(spark, path, spark.createDataFrame([], "id long, field string, value string, seq long"))


def test_pushes_clean_notes_and_count_values(spark):
    url, driver = "jdbc:derby:memory:p;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = events(spark, {"datetime": "2024-01-01 00:00:00", "source": "FILE", "tag": "a, b"}, {"source": "FILE"}, {"source": "LOG"})
    notes = spark.createDataFrame([(1, "2024-01-01 00:00:00", "n\0ote", "t\0", "", 0), (2, "soon", "x", "", "", 0)], "id long, datetime string, description string, tag string, color string, bookmark long")
    push.push_jdbc(rows, notes, url, driver=driver)
    table = lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, driver=driver).load()
    assert sorted((r["description"], r["tag"], r["datetime"] is None) for r in table("examiner_notes").collect()) == [("note", "t", False), ("x", "", True)]
    assert {(r["source"], r["frequency"]) for r in table("l2t_sources").collect()} == {("FILE", 2), ("LOG", 1)}
    assert {r["tag"] for r in table("l2t_tags").collect()} == {"a", "b"}


def test_a_store_on_a_sql_server_is_opened(spark):
    url, driver = "jdbc:derby:memory:o;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = events(spark, *({"datetime": "2024-01-01 00:00:00", "desc": f"d{k}", "offset": k} for k in range(40)))
    rows.withColumn("host", F.lit(None).cast("string")).withColumn("offset", F.when(F.col("offset") > 0, F.col("offset"))).write.jdbc(url, "log2timeline", properties={"driver": driver})
    back = store.open_jdbc(spark, url, partitions=4, driver=driver)
    assert back.rdd.getNumPartitions() == 4
    assert {(r["id"], r["desc"], r["host"], r["offset"]) for r in back.collect()} == {(k + 1, f"d{k}", "", k) for k in range(40)}


def test_saved_queries_over_several_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Name,SQL,Description,EID,OS,IP\nn,"source = \'X\'\nOR host = ""H""",d,,,\n')
    assert store.read_saved_queries(spark, str(tmp_path / "q.csv")).first().SQL == "source = 'X'\nOR host = \"H\""


def test_bucket_bounds_equal_bucket_ranges(spark):
    from chronoforge.functions.times import bucket_bounds

    buckets = ["2023-02", "2024-02", "2024-12", "2023-02-03", "2023-02-03 04:00:00"]
    first, last = bucket_bounds(F.col("b"))
    got = spark.createDataFrame([(b,) for b in buckets], "b string").select("b", first, last).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {b: bucket_range(b) for b in buckets}
