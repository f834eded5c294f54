"""B13 stored: snapshots, one pointer, writers side by side."""

import pytest

from marketflow.sources import cache as S


def writes(spark, *rows):
    return spark.createDataFrame(list(rows), S.CACHE_SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_last_write_wins_over_rounds(spark, scratch):
    assert rows(S.read_cache(spark, scratch)) == []
    assert S.store_cache(writes(spark, ("a", "1", 1), ("b", "1", 5), ("a", "2", 2), (None, "x", 9), ("a", "2", 2)), scratch) == 1
    assert S.store_cache(writes(spark, ("a", "3", 3), ("b", "late", 4), ("c", None, 1)), scratch) == 2
    assert rows(S.read_cache(spark, scratch)) == [("a", "3", 3), ("b", "1", 5), ("c", None, 1)]
    assert rows(S.read_cache(spark, scratch, 1)) == [("a", "2", 2), ("b", "1", 5)]


def test_ties_take_the_largest_value_and_empty_batches_make_a_version(spark, scratch):
    S.store_cache(writes(spark, ("a", "1", 1), ("a", "2", 1), ("a", None, 1)), scratch)
    assert S.store_cache(writes(spark), scratch) == 2
    assert rows(S.read_cache(spark, scratch)) == [("a", "2", 1)]


def test_a_reader_keeps_its_snapshot(spark, scratch):
    S.store_cache(writes(spark, ("a", "1", 1)), scratch)
    held = S.read_cache(spark, scratch)
    S.store_cache(writes(spark, ("a", "2", 2), ("b", "1", 2)), scratch)
    assert rows(held) == [("a", "1", 1)]
    assert rows(S.read_cache(spark, scratch)) == [("a", "2", 2), ("b", "1", 2)]


def test_a_crash_before_the_pointer_changes_nothing(spark, scratch, monkeypatch):
    S.store_cache(writes(spark, ("a", "1", 1)), scratch)

    def lost(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(S, "put_new", lost)
        with pytest.raises(OSError):
            S.store_cache(writes(spark, ("a", "2", 2)), scratch)
    assert S.cache_version(spark, scratch) == 1
    assert rows(S.read_cache(spark, scratch)) == [("a", "1", 1)]
    assert S.store_cache(writes(spark, ("b", "1", 2)), scratch) == 2
    assert rows(S.read_cache(spark, scratch)) == [("a", "1", 1), ("b", "1", 2)]
    assert S.expire_cache(spark, scratch, keep=2) == []          # too young
    gone = S.expire_cache(spark, scratch, keep=2, min_age_seconds=0)
    assert len(gone) == 1 and rows(S.read_cache(spark, scratch, 1)) == [("a", "1", 1)]
    assert len(S.expire_cache(spark, scratch, keep=1, min_age_seconds=0)) == 1
    assert rows(S.read_cache(spark, scratch)) == [("a", "1", 1), ("b", "1", 2)]


def test_the_slower_of_two_writers_merges_again(spark, scratch, monkeypatch):
    put, raced = S.put_new, []

    def late(session, path, text):
        if not raced:
            raced.append(1)
            assert S.store_cache(writes(spark, ("other", "1", 1)), scratch) == 1
        return put(session, path, text)

    monkeypatch.setattr(S, "put_new", late)
    assert S.store_cache(writes(spark, ("mine", "1", 1)), scratch) == 2
    assert rows(S.read_cache(spark, scratch)) == [("mine", "1", 1), ("other", "1", 1)]


def test_fill_generates_each_missing_key_once(spark, scratch):
    def made(missing):
        assert missing.columns == ["cache_key"]
        return missing.selectExpr("cache_key", "'made ' || cache_key AS url")

    S.store_cache(writes(spark, ("a", "old", 1)), scratch)
    req = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "cache_key string, row int")
    got = S.fill_cache(req, scratch, made)
    assert rows(got.select("row", "url", "hit")) == [(1, "old", True), (2, "made b", False), (3, "made b", False), (4, None, False)]
    again = S.fill_cache(req, scratch, made)
    assert rows(again.select("row", "hit")) == [(1, True), (2, True), (3, True), (4, False)]
    assert rows(got.select("row", "hit")) == [(1, True), (2, False), (3, False), (4, False)]
