"""Stored tables, digests, frozen splits and the log."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import audits, splits
from tideline.roles import Roles
from tideline.sources import sinks, stored


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_write_refuse_replace_and_read(spark, tmp_path, form):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, None if i == 2 else f'a "quote",\nline {i}', i / 3) for i in range(50)], "id long, text string, x double")
    known = stored.write(df, path, form=form, order=["id"])
    assert known["rows"] == 50 and rows_of(stored.read(spark, path)) == rows_of(df)
    with pytest.raises(FileExistsError):
        stored.write(df.limit(1), path, form=form)
    assert stored.read(spark, path).count() == 50
    stored.write(df.limit(7), path, overwrite=True, form=form)
    assert stored.read(spark, path).count() == 7
    with pytest.raises(FileNotFoundError):
        stored.read(spark, str(tmp_path / "none"))


def test_two_writers_of_one_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    stored.write(spark.range(3), path)
    monkeypatch.setattr(stored, "exists", lambda *_: False)  # the second writer looked before the first was done
    with pytest.raises(FileExistsError):
        stored.write(spark.range(5), path)
    assert stored.read(spark, path).count() == 3


def test_a_changed_table_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    known = stored.write(spark.range(10), path)
    spark.range(9).unionByName(spark.range(1)).write.mode("overwrite").parquet(f"{path}/{known['version']}")
    with pytest.raises(ValueError, match="not the 10 rows"):
        stored.read(spark, path)
    assert stored.read(spark, path, check=False).count() == 10


def test_digest_depends_on_rows_alone(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "", "a", "a|1:b", "-"])) for _ in range(200)]
    make = lambda r, parts=1: stored.digest(spark.createDataFrame(r, "a int, b string").repartition(parts)).first()
    base = make(rows)
    assert make(rows[::-1], 7) == base and base["n"] == 200
    assert make(rows[1:]) != base and make([*rows, rows[0]]) != base and make([(9, "z"), *rows[1:]]) != base
    assert make([(None, "")]) != make([(None, None)]) and make([(1, "2")]) != make([(12, "")])
    assert make([])["n"] == 0


def test_splits_by_position_and_by_key(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(0, 9), rng.randint(0, 5), i) for i in range(300)]
    roles = Roles("u", "t", "id")
    df = spark.createDataFrame(rows, "u int, t int, id long").repartition(6)
    order = sorted(rows)
    parts = {r[2]: "val" if n % 4 == 0 else "train" for n, r in enumerate(order)}
    given = spark.createDataFrame([(n, parts[r[2]]) for n, r in enumerate(order)], "place long, part string")
    splits.save_split(given, str(tmp_path / "places"), "place", per_document=40)
    split = splits.load_split(spark, str(tmp_path / "places"), lines=True)
    got = {r["id"]: r["part"] for r in splits.apply_split(df, split, roles).collect()}
    assert got == parts
    named = spark.createDataFrame([(i, p) for i, p in parts.items() if i % 2], "id long, part string")
    splits.save_split(named, str(tmp_path / "ids"), "id", "text_id")
    split = splits.load_split(spark, str(tmp_path / "ids"), lines=True)
    got = {r["id"]: r["part"] for r in splits.apply_split(df, split, roles).collect()}
    assert got == {i: p for i, p in parts.items() if i % 2}
    with pytest.raises(ValueError, match="not there"):
        splits.apply_split(df.where("id <> 1"), split, roles)
    with pytest.raises(ValueError, match="duplicate"):
        splits.apply_split(df, split.unionByName(split.limit(1)), roles)
    assert splits.apply_split(df.where("id <> 1"), split, roles, check=False).count() == 149


def test_a_run_written_again_adds_no_row(spark, tmp_path):
    path = str(tmp_path / "log")
    row = spark.createDataFrame([(0.5, "all"), (0.7, "words")], "mae_valence double, slice string")
    for run, seed in (("r1", 42), ("r2", 42), ("r1", 43), ("r1", 42)):
        sinks.append_log(row, path, run_id=run, task="levels", seed=seed)
    log = sinks.read_log(spark, path)
    assert log.count() == 6 and log.columns[:3] == ["run_id", "git_commit", "seed"]
    sinks.append_log(row.limit(1), path, run_id="r2", task="levels", seed=42)
    assert sinks.read_log(spark, path).groupBy("run_id", "seed").count().where("run_id = 'r2'").first()["count"] == 1


def test_samples_of_bad_keys_do_not_depend_on_partitions(spark):
    bad = spark.createDataFrame([(i, None if i == 3 else "x") for i in range(500)], "a int, b string")
    one, two = (audits.with_sample("c", bad.repartition(n), ["a", "b"]).first() for n in (1, 9))
    assert one == two and one["n_bad"] == 500 and len(one["sample"].split(" ")) == 16
    none = audits.with_sample("c", bad.where("false"), ["a"]).first()
    assert (none["status"], none["n_bad"], none["sample"]) == ("PASS", 0, None)
    assert audits.with_sample("c", bad.where("a = 3"), ["a", "b"]).select(F.col("sample")).first()[0] == "3,"


def test_positions_are_checked_without_numbering_and_keys_take_no_numbers(spark, monkeypatch):
    rows = [(i % 7, i * 10, i) for i in range(60)]
    df = spark.createDataFrame(rows, "user int, at int, id long")
    roles = Roles("user", "at", "id", ("at", "at"), ("dv", "da"), "flag")
    calls = []
    real = splits.row_numbers
    monkeypatch.setattr(splits, "row_numbers", lambda *a: calls.append(1) or real(*a))
    keys = spark.createDataFrame([(i, "train", "id") for i in range(0, 60, 2)], "key long, part string, id_type string")
    assert {r["id"] for r in splits.apply_split(df, keys, roles).collect()} == set(range(0, 60, 2))
    assert not calls
    both = keys.unionByName(spark.createDataFrame([(0, "val", "row_index"), (59, "val", "row_index")], keys.schema))
    order = sorted(rows)
    want = sorted([(i, "train") for i in range(0, 60, 2)] + [(order[0][2], "val"), (order[59][2], "val")])
    assert sorted((r["id"], r["part"]) for r in splits.apply_split(df, both, roles).collect()) == want
    assert len(calls) == 1
    for lost in (60, -1, None):
        bad = spark.createDataFrame([(lost, "val", "row_index")], keys.schema)
        with pytest.raises(Exception, match="not there"):
            splits.apply_split(df, bad, roles)
    assert splits.apply_split(df, keys.limit(0), roles).count() == 0
