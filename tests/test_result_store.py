from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faultlens.sources import result_store as S
from faultlens.sources.result_store import ResultStore, WriteConflict

SCHEMA = "case_id string, mode string, created_at long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("case_id", "mode", "created_at", "v").collect())


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_latest_row_wins_and_other_parts_keep_their_files(spark, tmp_path):
    store, rng, want = ResultStore(spark, str(tmp_path), 8), random.Random(2), {}
    assert store.read() is None
    for k in range(4):
        cases = range(40) if k == 0 else rng.sample(range(60), 3)
        new = [(f"c{i}", m, 10 * k + 1, f"{k}") for i in cases for m in (("fusion", "a/b=c d") if k < 3 else ("fusion",))]
        before, old = files(tmp_path / "data"), store.commit()
        assert store.upsert(frame(spark, new)) == k + 1
        want |= {(c, m): (c, m, t, v) for c, m, t, v in new}
        assert rows_of(store.read()) == sorted(want.values())
        now = store.commit()
        same = [p for p in old.parts if old.parts[p] == now.parts.get(p)]
        if k:
            assert files(tmp_path / "data").items() >= before.items() and len(same) >= len(old.parts) - len(new)
        assert sum(n for _, n in now.parts.values()) == len(want)
    assert rows_of(store.read(1)) == sorted((f"c{i}", m, 1, "0") for i in range(40) for m in ("fusion", "a/b=c d"))


def test_earlier_rows_do_not_replace_later_ones(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path), 4)
    store.upsert(frame(spark, [("c", "m", 5, "late"), ("c", "m", 4, "early"), (None, "m", 1, "x"), ("d", None, 1, "y")]))
    store.upsert(frame(spark, [("c", "m", 3, "older")]))
    assert {r[3] for r in rows_of(store.read().fillna("?"))} == {"late", "x", "y"}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store, new = ResultStore(spark, str(tmp_path), 4), frame(spark, [("c", "m", 1, "a"), ("d", "m", 1, "b")])
    assert store.append(new, "batch-0") == 1
    before = files(tmp_path / "data")
    assert store.append(new, "batch-0") == 1 and store.upsert(new, "batch-0") == 1
    assert files(tmp_path / "data") == before and len(rows_of(store.read())) == 2
    assert store.append(new, "batch-1") == 2 and len(rows_of(store.read())) == 4


def test_insert_missing(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path), 4)
    store.insert_missing(frame(spark, [("c", "m", 1, "first")]))
    store.insert_missing(frame(spark, [("c", "m", 9, "again"), ("c", "n", 9, "new")]))
    assert rows_of(store.read()) == [("c", "m", 1, "first"), ("c", "n", 9, "new")]


def test_a_write_that_stops_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    store = ResultStore(spark, str(tmp_path), 4)
    store.upsert(frame(spark, [("c", "m", 1, "a")]))
    monkeypatch.setattr(ResultStore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert(frame(spark, [("c", "m", 2, "b"), ("d", "m", 2, "b")]))
    monkeypatch.undo()
    assert rows_of(store.read()) == [("c", "m", 1, "a")] and store.versions() == [1]
    store.upsert(frame(spark, [("d", "m", 2, "b")]))
    assert rows_of(store.read()) == [("c", "m", 1, "a"), ("d", "m", 2, "b")]
    assert store.vacuum() == [2] and rows_of(store.read()) == [("c", "m", 1, "a"), ("d", "m", 2, "b")]
    used = {f.split("/")[0] for folders, _ in store.commit().parts.values() for f in folders}
    assert {p.name for p in (tmp_path / "data").iterdir()} == used


def test_the_slower_of_two_writes_is_told(spark, tmp_path, monkeypatch):
    store, other = ResultStore(spark, str(tmp_path), 4), ResultStore(spark, str(tmp_path), 4)
    own = ResultStore._write

    def overtaken(self, rows):
        monkeypatch.undo()
        other.upsert(frame(spark, [("x", "m", 1, "other")]))
        return own(self, rows)

    monkeypatch.setattr(ResultStore, "_write", overtaken)
    with pytest.raises(WriteConflict):
        store.upsert(frame(spark, [("c", "m", 1, "a")]))
    store.upsert(frame(spark, [("c", "m", 1, "a")]))
    assert rows_of(store.read()) == [("c", "m", 1, "a"), ("x", "m", 1, "other")]


def test_columns_that_came_later(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path), 1)
    store.append(frame(spark, [("c", "m", 1, "a")]))
    store.append(frame(spark, [("d", "m", 1, "b")]).withColumn("tokens", F.lit(3)))
    store.upsert(frame(spark, [("e", "m", 1, "c")]))
    assert {(r.case_id, r.tokens) for r in store.read().collect()} == {("c", None), ("d", 3), ("e", None)}
    assert S.Commit.of(store.commit().to_json()) == store.commit()


def test_no_new_rows(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path), 4)
    store.upsert(frame(spark, []))
    assert rows_of(store.read()) == []
    store.upsert(frame(spark, [("c", "m", 1, "a")]))
    store.upsert(frame(spark, []))
    assert rows_of(store.read()) == [("c", "m", 1, "a")]
