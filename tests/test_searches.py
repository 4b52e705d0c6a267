"""Searches with an index of texts, many saved queries at once, pushes that are run again, live counts with late events."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoforge.functions.schema import EVENT_COLUMNS, EVENT_SCHEMA, INT_COLUMNS
from chronoforge.operators import pages, predicates, saved
from chronoforge.operators.predicates import Request, texts_held
from chronoforge.sources import files, imports, push, store, trigrams
from chronoforge.streaming import imports as live

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def events(spark, *rows):
    return spark.createDataFrame([(k + 1, *(r.get(c, 0 if c in INT_COLUMNS else "") for c in EVENT_COLUMNS)) for k, r in enumerate(rows)], EVENT_SCHEMA)


def jobs(spark, action):
    sc, group = spark.sparkContext, f"g{random.random()}"
    sc.setJobGroup(group, "counted")
    try:
        out = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


# -- the index of texts


def test_a_search_reads_only_files_that_may_hold_its_text(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [{"datetime": f"2024-01-{d:02} 00:00:00", "desc": f"plain words of day {d}", "host": "HOST"} for d in range(1, 21)]
    rows[6]["desc"] = "a line\nwith NEEDLE_seven 100%"
    rows[11]["filename"] = "C:\\Users\\Zoë ΟΔΟΣ"
    store.append(events(spark, *rows, {"datetime": "Not a time", "tag": "needle"}), path)
    n = len(files.tables(spark, path, 1))
    assert len(store.files_for(spark, path, Request(search="needle"))) == n  # nothing is indexed yet
    assert store.index_texts(spark, path) == n and store.index_texts(spark, path) == 0
    for request, most, found in (
        (Request(search="nEEDle"), 2, 2),
        (Request(search="needle_SEVEN"), 1, 1),
        (Request(search="dle%100"), 1, 1),
        (Request(search="Users\\zoË οδος"), 1, 1),
        (Request([("desc", "LIKE", "needle")]), 2, 1),
        (Request([("tag", "=", "needle")]), 2, 1),
        (Request([("tag", "=", "NEEDLE")]), 2, 0),
        (Request(search="no such text"), 0, 0),
        (Request(search="ne"), n, 2),
        (Request([("desc", "NOT LIKE", "needle")]), n, 20),
        (Request([("host", "=", "HOST"), ("desc", "LIKE", "needle")], "OR"), n, 20),
        (Request([("desc", "LIKE", "needle")], "OR", search="seven", and_scopes=True), 1, 1),
        (Request([("desc", "LIKE", "needle")], "OR"), 2, 1),
        (Request(search="needle", date_from="2024-01-01", date_to="2024-01-31"), 2, 1),
    ):
        some = store.files_for(spark, path, request)
        rows_found = pages.found(store.open_for(spark, path, request), request)
        assert len(some) <= most and rows_found.count() == found, request
        assert sorted(rows_found.collect()) == sorted(pages.found(store.open_parquet(spark, path), request).collect())
    request = Request(search="needle_seven")
    assert len(store.open_for(spark, path, request).inputFiles()) == 1


def test_files_of_later_changes_are_searched_until_they_are_indexed(spark, tmp_path, monkeypatch):
    path, request = str(tmp_path / "store"), Request(search="needle")
    find = lambda: sorted(r.desc for r in pages.found(store.open_for(spark, path, request), request).collect())
    store.append(events(spark, *({"datetime": f"2024-01-0{d} 00:00:00", "desc": f"d{d}"} for d in range(1, 6))), path)
    store.index_texts(spark, path)
    assert find() == []
    (third,) = [r.id for r in store.open_parquet(spark, path).collect() if r.desc == "d3"]
    store.apply_edits(spark, path, spark.createDataFrame([(third, "desc", "a Needle", 1)], "id long, field string, value string, seq long"))
    store.append(events(spark, {"datetime": "2024-01-09 00:00:00", "desc": "needle too"}), path)
    assert find() == ["a Needle", "needle too"]
    assert store.index_texts(spark, path) == 2 and find() == ["a Needle", "needle too"] and len(store.files_for(spark, path, request)) == 2
    monkeypatch.setattr(store, "COUNT_FILES", 1)
    store.index_texts(spark, path)  # into one file, without the file that the edit replaced
    index = store._beside(spark, path, "index", trigrams.SCHEMA)
    assert {r.file for r in index.select("file").distinct().collect()} == set(files.tables(spark, path, 1))
    assert find() == ["a Needle", "needle too"] and len(store.files_for(spark, path, request)) == 2


def test_random_texts_are_never_left_out(spark, tmp_path):
    rnd, path = random.Random(5), str(tmp_path / "store")
    texts = ["".join(rnd.choices("abÄßİ語𝕏 _%\\\n\0", k=rnd.choice([0, 1, 2, 3, 8, 40, 3000]))) for _ in range(120)]
    store.append(events(spark, *({"datetime": f"2024-01-{1 + k % 28:02} 00:00:00", rnd.choice(["desc", "extra", "URL"]): t} for k, t in enumerate(texts))), path)
    store.index_texts(spark, path)
    fewer, all_files = 0, len(files.tables(spark, path, 1))
    for _ in range(12):
        t = rnd.choice([t for t in texts if len(t) > 7])
        at = rnd.randrange(len(t) - 6)
        request = Request(search=t[at : at + rnd.choice([3, 5, 200])])
        got = pages.found(store.open_for(spark, path, request), request).select("id").collect()
        assert got and sorted(got) == sorted(pages.found(store.open_parquet(spark, path), request).select("id").collect())
        fewer += len(store.files_for(spark, path, request)) < all_files
    assert fewer > 3


def test_sketches_of_chunks_equal_those_of_whole_texts(spark, monkeypatch):
    text = "".join(random.Random(1).choices("abcdefgh", k=5000))
    whole = np.unique(trigrams.places(np.frombuffer(text.encode(), np.uint8)))
    monkeypatch.setattr(trigrams, "_CHUNK", 64)
    import pyarrow as pa

    (out,) = list(trigrams._sketches([pa.RecordBatch.from_arrays([pa.array(["f"] * 2), pa.array([text, None])], names=["file", "text"])]))
    bits = [p * trigrams.PIECE_BITS + np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) for p, b in zip(out["piece"].to_pylist(), out["bits"].to_pylist(), strict=True)]
    assert np.concatenate(bits).tolist() == whole.tolist()


def test_texts_that_each_event_holds():
    assert texts_held(Request([("desc", "LIKE", "a"), ("host", "=", "b"), ("host", "!=", "c"), ("offset", "=", "1")], search="k")) == ["k", "a", "b"]
    assert texts_held(Request([("desc", "LIKE", "a")], "OR", search="k")) == []
    assert texts_held(Request([("desc", "LIKE", "a"), ("desc", "LIKE", "b")], "OR", search="k", and_scopes=True)) == ["k"]
    assert texts_held(Request([], "OR", search="k", bookmarked=True)) == []


# -- many saved queries


def test_a_thousand_saved_queries_in_one_scan(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choices("abcÄ", k=n))
    rows = [
        {"desc": word(30), "host": word(2), "user": word(3), "datetime": rnd.choice(["2024-01-05 00:00:00", "Not a time", ""]), "offset": rnd.randrange(5), "bookmark": rnd.randrange(2)}
        for _ in range(400)
    ]
    df = events(spark, *rows).withColumn("user", F.when(F.col("user") != "aaa", F.col("user")))  # with nulls
    queries = {f"q{k}": Request([("desc", "LIKE", word(4)), (rnd.choice(["host", "user"]), rnd.choice(["=", "!=", "NOT LIKE", ">=", "<="]), word(2).upper())], rnd.choice(["AND", "OR"])) for k in range(1000)}
    got, n = jobs(spark, lambda: {r["name"]: r.events for r in saved.counts(df, queries).collect()})
    _, fewer = jobs(spark, lambda: saved.counts(df, dict(list(queries.items())[:10])).collect())
    assert n == fewer <= 3 and set(got) == set(queries)  # values in lower case, the scan, its sums
    for name in rnd.sample(sorted(queries), 25):
        assert got[name] == df.filter(predicates.predicate(queries[name])).count(), queries[name]


def test_counts_of_all_kinds_of_saved_queries(spark):
    rows = [{"desc": "Click\nhere 50%", "offset": 3, "host": "B", "bookmark": 1}, {"desc": "a_b\\c", "offset": -1, "datetime": "2024-01-05 10:00:00"}, {"tag": "click", "offset": 10, "datetime": "2024-02-01 00:00:00"}]
    df = events(spark, *rows).withColumn("host", F.when(F.col("host") != "", F.col("host"))).withColumn("store_number", F.lit(None).cast("long"))
    panels = [
        Request(), Request([("nosuch", "=", "x")]), Request([("desc", "~", "x")]), Request([("desc", "=", "")]),
        Request([("desc", "LIKE", "CLICK_here")]), Request([("desc", "LIKE", "c%5")]), Request([("desc", "LIKE", "b\\C")]), Request([("desc", "NOT LIKE", "a_b")]),
        Request([("offset", ">=", "3")]), Request([("offset", ">=", "3x")]), Request([("offset", "LIKE", "1")]), Request([("offset", "!=", " +3 ")]),
        Request([("host", "!=", "A")]), Request([("host", "NOT LIKE", "a")]), Request([("host", "=", "B"), ("desc", "LIKE", "a_b")], "OR"),
        Request([("store_number", "!=", "1")]), Request([("DateTime", "<=", "2024-01")]), Request([("datetime", "=", "2024-01-05 10:00:00")]),
        Request(search="click"), Request([("offset", "=", "10")], "OR", search="a_b", bookmarked=True), Request([("offset", ">=", "0"), ("host", "=", "Z")], "OR", search="click", and_scopes=True, bookmarked=True),
        Request([], date_from="2024-01", date_to="2024-01"), Request([("desc", "LIKE", "%")]), Request([("offset", "<=", str(1 << 70))]), Request([("offset", "=", str(-1 << 70))]), Request([("offset", ">=", str(-1 << 70))]),
    ]
    queries = {f"p{k}": p for k, p in enumerate(panels)} | {"none": None, "raw": predicates.raw_where("desc LIKE 'click%' OR host = 'B'"), "null": predicates.raw_where("store_number = 1")}
    got = {r["name"]: r.events for r in saved.counts(df, queries).collect()}
    for name, q in queries.items():
        condition = predicates.predicate(q) if isinstance(q, Request) else q
        assert got[name] == (df if condition is None else df.filter(condition)).count(), (name, q)
    assert saved.counts(df, {}).collect() == []
    assert {r["name"]: r.events for r in saved.counts(df.limit(0), {"a": None, "b": Request(search="x")}).collect()} in ({}, {"a": 0, "b": 0})
    text = '{"filters": [{"field": "host", "operator": "=", "value": "B"}], "logic": "AND"}'
    assert predicates.saved_request(text) == Request([("host", "=", "B")])


# -- pushes


def pushed(spark, url, table="log2timeline"):
    return sorted(r[0] for r in spark.read.format("jdbc").options(url=url, dbtable=table, driver=DERBY).load().select("desc" if table == "log2timeline" else "description").collect())


def notes(spark, *texts):
    return spark.createDataFrame([(k, "2024-01-01 00:00:00", t, "", "", 0) for k, t in enumerate(texts)], "id long, datetime string, description string, tag string, color string, bookmark long")


def test_a_push_that_fails_half_way_and_runs_again(spark, monkeypatch):
    url = "jdbc:derby:memory:again;create=true"
    rows = events(spark, *({"desc": f"d{k}", "source": "S"} for k in range(60)))
    want = sorted(f"d{k}" for k in range(60))
    few = lambda: push.push_jdbc(rows, notes(spark, "n", "n"), url, push="p1", driver=DERBY)
    stage, run, said = push._stage, push._run, []
    # a job that ended when some parts were staged, one of them by halves
    half = push._dealt(store.sanitised(rows)).filter("push_part < 12 AND NOT (push_part = 3 AND desc < 'd4')")
    half.write.mode("append").jdbc(url, "log2timeline_p1", properties={"driver": DERBY})
    store.sanitised(rows).limit(0).drop("id").write.mode("append").jdbc(url, "log2timeline", properties={"driver": DERBY})
    assert 0 < half.count() < 50 and pushed(spark, url) == []
    monkeypatch.setattr(push, "_run", lambda con, sql, *v: (said.append(sql), run(con, sql, *v))[1])
    written = []
    monkeypatch.setattr(push, "_stage", lambda spark, made, staging, *a: (written.append(staging), stage(spark, made, staging, *a))[1])
    monkeypatch.setattr(push, "_move", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped before it moved")))
    with pytest.raises(RuntimeError, match="stopped"):
        few()
    monkeypatch.undo()
    assert pushed(spark, url) == [] and written == ["log2timeline_p1", "examiner_notes_p1"]
    assert [q for q in said if q.startswith("DELETE")] in ([], ['DELETE FROM log2timeline_p1 WHERE "push_part" IN (3)'])
    drop = push._drop
    monkeypatch.setattr(push, "_drop", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped after it moved")))
    with pytest.raises(RuntimeError, match="after"):
        few()
    monkeypatch.setattr(push, "_drop", drop)
    for _ in range(2):
        few()
        assert pushed(spark, url) == want and pushed(spark, url, "examiner_notes") == ["n", "n"]
    assert push.has_push(spark, url, "p1", driver=DERBY) and not push.has_push(spark, url, "p2", driver=DERBY)
    assert not push._there(spark, url, "log2timeline_p1", {"driver": DERBY})
    sources = spark.read.format("jdbc").options(url=url, dbtable="l2t_sources", driver=DERBY).load().collect()
    assert [tuple(r) for r in sources] == [("S", 60)]
    push.push_jdbc(rows, notes(spark), url, push="p2", driver=DERBY)  # another push, without notes
    assert len(pushed(spark, url)) == 120 and len(pushed(spark, url, "examiner_notes")) == 2


def test_parts_that_were_staged_twice_are_staged_anew_and_a_wrong_number_is_undone(spark, monkeypatch):
    url, options = "jdbc:derby:memory:twice;create=true", {"driver": DERBY}
    rows = events(spark, *({"desc": "same"} for _ in range(20)))
    push.push_jdbc(rows, notes(spark), url, **options)
    dealt = push._dealt(store.sanitised(rows))
    assert push._stage(spark, dealt, "log2timeline_x", url, options) == 20
    dealt.filter("push_part % 2 = 0").write.mode("append").options(**options).jdbc(url, "log2timeline_x")
    assert push._stage(spark, dealt, "log2timeline_x", url, options) == 20
    with pytest.raises(RuntimeError, match="in place of 19"):
        push._move(spark, url, "x", [("log2timeline_x", "log2timeline", dealt.drop("push_part").columns, 19)], options)
    assert len(pushed(spark, url)) == 20 and not push.has_push(spark, url, "x", **options)
    with pytest.raises(ValueError, match="named"):
        push.push_jdbc(rows, notes(spark), url, push="x; DROP", **options)


# -- live counts


def test_late_events_are_dropped_and_no_bucket_is_written_twice(spark, tmp_path):
    def come(*times):
        spark.createDataFrame([(t,) for t in times], "datetime string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("datetime string").parquet(str(tmp_path / "in"))
        live.write_histogram(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema("bucket string, cnt long").parquet(str(tmp_path / "out")).collect())

    assert come("2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 02:30:00", "Not a time") == [("2024-01-01 00:00:00", 2)]
    # the watermark stands at 01:30: hour 0 is closed, hours 1 and 2 are open
    assert come("2024-01-01 00:20:00", "2024-01-01 01:40:00", "2024-01-01 02:40:00") == [("2024-01-01 00:00:00", 2)]
    assert come("2024-01-01 04:05:00") == [("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 2)]
    assert come("2024-01-01 02:59:00") == [("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 2)]


# -- heads of files


def test_heads_of_large_files_are_read_without_a_job_each(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(imports, "SMALL_FILE", 0)
    (tmp_path / "a.tln").write_bytes(b"\r\n  \r\n1539100800|FILE|H|U|one\r\nx")
    (tmp_path / "b c.csv").write_text("\n" * 70000 + "datetime,message," + "x" * 200000 + "\n1,2\n")
    (tmp_path / "d.jsonl").write_text('{"timestamp": 1, "message": "ä"}')  # no line end
    (tmp_path / "e.csv").write_text(" \n\n")
    with gzip.open(tmp_path / "f.tln.gz", "wt") as f:
        f.write("1539100800|FILE|H|U|packed\n")
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    got, n = jobs(spark, lambda: imports.first_lines(spark, paths))
    assert n <= 2
    lines = {k.rsplit("/", 1)[1]: v for k, v in got.items()}
    assert lines.pop("b c.csv" if "b c.csv" in lines else "b%20c.csv") == "datetime,message," + "x" * 200000
    assert lines == {"a.tln": "1539100800|FILE|H|U|one", "d.jsonl": '{"timestamp": 1, "message": "ä"}', "f.tln.gz": "1539100800|FILE|H|U|packed"}
