"""The store of versions: crashes, repeated batches, two writers, bound readers."""

import pytest

from passwatch.sources import versioned
from passwatch.sources.versioned import Change

SCHEMA = "scene_id string, v int, date string"


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)



def put(spark, path, writer, batch, *values, keys=None):
    return versioned.apply(spark, path, {"t": Change(rows(spark, *values), keys=keys)}, writer, batch)


@pytest.fixture
def path(spark, tmp_path):
    out = f"file://{tmp_path}/store"
    put(spark, out, "a", 0, ("x", 1, "d1"), ("y", 2, "d1"), ("z", 3, "d 2/%"), ("n", 4, None))
    return out


def test_replaces_by_key(spark, path):
    assert put(spark, path, "a", 1, ("x", 7, "d3"), ("q", 8, "d1")) == 2
    want = {("x", 7, "d3"), ("q", 8, "d1"), ("y", 2, "d1"), ("z", 3, "d 2/%"), ("n", 4, None)}
    assert {(r.scene_id, r.v, r.date) for r in versioned.read(spark, path, "t").collect()} == want
    put(spark, path, "a", 2, keys=rows(spark, ("n", 0, None), ("z", 0, None)))  # keys without rows go
    assert {(r.scene_id, r.v, r.date) for r in versioned.read(spark, path, "t").collect()} == {("x", 7, "d3"), ("q", 8, "d1"), ("y", 2, "d1")}
    assert {r.scene_id for r in versioned.read(spark, path, "t", parts={"d3"}).collect()} == {"x"}


def test_a_batch_is_applied_once(spark, path):
    first = put(spark, path, "a", 1, ("x", 5, "d1"))
    assert put(spark, path, "a", 1, ("x", 99, "d1")) == first
    assert ("x", 5, "d1") in {tuple(r) for r in versioned.read(spark, path, "t").collect()}


def test_readers_stay_with_their_version(spark, path):
    before = versioned.read(spark, path, "t", 1)
    put(spark, path, "a", 1, ("x", 5, "d1"), ("y", 6, "d9"))
    assert {(r.scene_id, r.v) for r in before.collect()} == {("x", 1), ("y", 2), ("z", 3), ("n", 4)}
    assert {(r.scene_id, r.v) for r in versioned.read(spark, path, "t").collect()} == {("x", 5), ("y", 6), ("z", 3), ("n", 4)}


@pytest.mark.parametrize("where", ["before the files", "amid the files", "before the manifest", "after the manifest"])
def test_a_crash_loses_nothing(spark, path, monkeypatch, where):
    """Two tables change together; the batch crashes at a step, a stream with a new checkpoint brings its own batch, then the first is run again."""
    staged, commit, calls = versioned._staged, versioned.commit, []

    def failing_staged(*a):
        calls.append(a)
        if where == "before the files" or where == "amid the files" and len(calls) == 2:
            raise RuntimeError(where)
        return staged(*a)

    def failing_commit(*a):
        if where == "after the manifest":
            commit(*a)
        raise RuntimeError(where)

    def change(v):
        return {"t": Change(rows(spark, ("x", v, "d1"))), "u": Change(rows(spark, ("x", v, "d1")))}

    before = {tuple(r) for r in versioned.read(spark, path, "t").collect()}
    with monkeypatch.context() as m:
        m.setattr(versioned, "_staged", failing_staged)
        if "manifest" in where:
            m.setattr(versioned, "commit", failing_commit)
        with pytest.raises(RuntimeError):
            versioned.apply(spark, path, change(10), "a", 1)
    if where != "after the manifest":
        assert {tuple(r) for r in versioned.read(spark, path, "t").collect()} == before
        assert "u" not in versioned.manifest(spark, path)["tables"]
    put(spark, path, "b", 1, ("w", 11, "d1"))
    versioned.apply(spark, path, change(10), "a", 1)
    now = {(r.scene_id, r.v) for r in versioned.read(spark, path, "t").collect()}
    assert now == {("x", 10), ("w", 11), ("y", 2), ("z", 3), ("n", 4)}
    assert [r.v for r in versioned.read(spark, path, "u").collect()] == [10]


def test_an_overtaken_writer_begins_anew(spark, path, monkeypatch):
    commit, others = versioned.commit, []

    def late(*a):
        if not others:
            others.append(1)
            put(spark, path, "b", 0, ("y", 20, "d1"), ("w", 21, "d1"))
        commit(*a)

    monkeypatch.setattr(versioned, "commit", late)
    assert put(spark, path, "a", 1, ("x", 10, "d1")) == 3
    assert {(r.scene_id, r.v) for r in versioned.read(spark, path, "t").collect()} == {("x", 10), ("y", 20), ("w", 21), ("z", 3), ("n", 4)}
    assert versioned.manifest(spark, path)["batches"] == {"a": 1, "b": 0}


def test_vacuum(spark, path):
    for k in range(4):
        put(spark, path, "a", k + 1, ("x", k, "d1"), ("y", k, "d1"))
    assert versioned.vacuum(spark, path, keep=2) == []  # all younger than a day
    assert len(versioned.vacuum(spark, path, keep=2, hours=-1)) == 2
    assert versioned.versions(spark, path) == [4, 5]
    assert {(r.scene_id, r.v) for r in versioned.read(spark, path, "t").collect()} == {("x", 3), ("y", 3), ("z", 3), ("n", 4)}
