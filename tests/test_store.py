"""Stores: changes that stop anywhere and are run again, imports, ids, counts."""

import json

import pytest
from pyspark.sql import functions as F

from chronoforge.functions.schema import EVENT_COLUMNS, EVENT_SCHEMA
from chronoforge.operators import aggregates
from chronoforge.sources import files, store

EDITS = "id long, field string, value string, seq long"


def events(spark, *rows):
    data = [(k + 1, *(r.get(c, 0 if c in ("offset", "store_number", "store_index", "vss_store_number", "bookmark") else "") for c in EVENT_COLUMNS)) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, EVENT_SCHEMA)


def days(n=3):
    return [{"datetime": f"2024-01-0{d} 00:00:00", "desc": f"d{d}", "source": "S", "tag": "a, b" if d == 1 else ""} for d in range(1, n + 1)]


def held(spark, path):
    rows = store.open_parquet(spark, path).collect()
    assert len({r.id for r in rows}) == len(rows)
    return sorted((r.desc, r.datetime, r.color) for r in rows)


def counted(spark, path):
    """The kept counts, equal to a full count."""
    kept, tags = store.metadata(spark, path)
    rows = store.open_parquet(spark, path)
    assert sorted(kept.collect()) == sorted(aggregates.frequencies(rows).collect())
    assert sorted(tags.collect()) == sorted(aggregates.distinct_tags(rows).collect())
    return kept.count()


class Stop(Exception):
    pass


def stopping(monkeypatch, after):
    """Lets so many changes of files through, then stops."""
    left = [after]

    def guard(f):
        def g(*a):
            if left[0] == 0:
                raise Stop
            left[0] -= 1
            return f(*a)

        return g

    for name in ("move", "delete", "delete_if_empty", "write_text", "create"):
        monkeypatch.setattr(files, name, guard(getattr(files, name)))


def test_edits_that_stop_anywhere_and_run_again(spark, tmp_path):
    first = str(tmp_path / "first")
    store.append(events(spark, *days()), first)
    at, stopped = 0, 0
    want = [("d1", "2024-01-02 00:00:00", "RED"), ("d2", "2024-01-02 00:00:00", ""), ("d3", "2024-01-03 00:00:00", "")]
    before = [(d, t, "") for d, t in (("d1", "2024-01-01 00:00:00"), ("d2", "2024-01-02 00:00:00"), ("d3", "2024-01-03 00:00:00"))]
    while True:
        path = str(tmp_path / f"store{at}")
        store.append(events(spark, *days()), path)
        ids = {r.desc: r.id for r in store.open_parquet(spark, path).collect()}
        changes = spark.createDataFrame([(ids["d1"], "datetime", "2024-01-02 00:00:00", 1), (ids["d1"], "color", "RED", 1)], EDITS)
        done = True
        with pytest.MonkeyPatch.context() as m:
            stopping(m, at)
            try:
                store.apply_edits(spark, path, changes)
            except Stop:
                done, stopped = False, stopped + 1
        assert held(spark, path) in (want, before)
        store.apply_edits(spark, path, changes)
        assert held(spark, path) == want
        if at % 3 == 0:
            counted(spark, path)
        if done:
            break
        at += 1
    assert stopped >= 5
    store.discard(spark, path)
    assert files.names(spark, f"{path}.journal/pending") == []


def test_imports_that_stop_anywhere_and_run_again(spark, tmp_path):
    (tmp_path / "a b.tln").write_text("1539100800|FILE|H|U|one\nbad|FILE|H|U|two\n")
    (tmp_path / "c.jsonl").write_text('{"timestamp": 1705312200000000, "message": "m", "source_short": "REG"}\n')
    paths, at = [str(tmp_path / "a b.tln"), str(tmp_path / "c.jsonl")], 0
    while True:
        path, done = str(tmp_path / f"store{at}"), True
        with pytest.MonkeyPatch.context() as m:
            stopping(m, at)
            try:
                store.import_files(spark, paths, path)
            except Stop:
                done = False
        again = store.import_files(spark, paths, path).collect()
        assert sorted(d for d, *_ in held(spark, path)) == ["m", "one"]
        if done:
            assert again == []
            break
        at += 2
    assert at >= 4 and counted(spark, path)
    (tmp_path / "c.jsonl").write_text('{"timestamp": 1705312200000000, "message": "changed", "source_short": "REG"}\n')
    got = store.import_files(spark, paths, path).collect()
    assert [(r.import_format, r.events, r.excluded) for r in got] == [("jsonl", 1, 0)] and len(held(spark, path)) == 3
    assert store.ledger(spark, path).count() == 3


def test_appends_side_by_side_share_no_id(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "store")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: store.append(events(spark, *days()), path, batch=f"b{k % 3}" if k < 3 else ""), range(5)))
    store.append(events(spark, *days()), path, batch="b1")
    assert len(held(spark, path)) == 15 and counted(spark, path) == 1
    assert store.has_batch(spark, path, "b2") and not store.has_batch(spark, path, "b3")


def test_ids_go_on_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BLOCK", 4)
    path = str(tmp_path / "store")
    for _ in range(2):
        store.append(events(spark, *days() * 3).repartition(3), path)
    rows = store.open_parquet(spark, path).collect()
    assert len({r.id for r in rows}) == len(rows) == 18 and min(r.id for r in rows) == 1 and max(r.id for r in rows) < 40


def test_the_later_of_two_edits_of_a_file_fails(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(events(spark, *days(1)), path)
    changes = spark.createDataFrame([(1, "color", "RED", 1)], EDITS)
    commit = store._commit
    with pytest.MonkeyPatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (m.setattr(store, "_commit", commit), store.apply_edits(spark, path, changes), commit(*a)))
        with pytest.raises(RuntimeError, match="came first"):
            store.apply_edits(spark, path, changes)
    assert held(spark, path) == [("d1", "2024-01-01 00:00:00", "RED")]


def test_counts_are_summed_into_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COUNT_FILES", 2)
    path = str(tmp_path / "store")
    for _ in range(3):
        store.append(events(spark, *days()), path)
    n = counted(spark, path)
    assert len(files.tables(spark, f"{path}.journal/counts")) <= 5
    store.refresh_metadata(spark, path)
    assert counted(spark, path) == n


def test_a_store_without_rows_and_a_commit_read_back(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(events(spark), path)
    assert held(spark, path) == [] and store.metadata(spark, path)[0].count() == 0
    store.append(events(spark, *days(1)), path)
    store.prepare_edits(spark, path, spark.createDataFrame([(store.last_id(spark, path), "color", "RED", 1)], EDITS))
    (name,) = files.names(spark, f"{path}.journal/pending")
    todo = json.loads(files.read_text(spark, f"{path}.journal/pending/{name}/COMMIT"))
    assert len(todo["remove"]) == 1 and todo["add"]
    assert store.open_parquet(spark, path).filter(F.col("color") == "RED").count() == 1
