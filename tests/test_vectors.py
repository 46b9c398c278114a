"""Vectors in NPZ files: ranges of rows, layouts, files of bounded size, refusals."""

import json

import numpy as np
import pytest

from tideline.sources import npz, vectors


def arrays(n=1000, width=3):
    rng = np.random.default_rng(3)
    return rng.normal(size=(n, width)).astype("float32"), np.arange(n)


def collected(df):
    return {r["id"]: r["vec"] for r in df.collect()}


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("by_columns", [False, True])
def test_ranges_of_a_file_are_its_rows(spark, tmp_path, packed, by_columns, monkeypatch):
    matrix, keys = arrays()
    given = np.asfortranarray(matrix) if by_columns else matrix
    (np.savez_compressed if packed else np.savez)(tmp_path / "a.npz", embeddings=given, id=keys)
    rows = vectors.import_npz(spark, str(tmp_path / "a.npz"), ["id"], rows=64)
    assert rows.rdd.getNumPartitions() == (1 if packed else 16)
    got = collected(rows)
    assert sorted(got) == keys.tolist()
    np.testing.assert_array_equal(np.array([got[k] for k in keys], "float32"), matrix)


def test_written_files_are_bounded_and_listed(spark, tmp_path):
    matrix, keys = arrays(4000, 8)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, matrix, strict=True)], "id long, vec array<float>").repartition(3)
    path = tmp_path / "store"
    vectors.export_npz(df, str(path), ["id"], "vec", file_bytes=1 << 14)
    listed = json.loads((path / npz.LISTED).read_text())
    assert len(listed) >= 3
    # what a failed task left behind is in no list
    np.savez(path / "left-over.npz", embeddings=matrix[:1], id=[99999])
    back = lambda: vectors.import_npz(spark, "file:" + str(path), ["id"])
    got = collected(back())
    np.testing.assert_array_equal(np.array([got[k] for k in keys], "float32"), matrix)
    assert back().count() == 4000
    vectors.export_npz(df.limit(5), str(path), ["id"], "vec")
    assert back().count() == 4005
    vectors.export_npz(df.limit(5), str(path), ["id"], "vec", overwrite=True)
    assert back().count() == 5


def test_empty_tables_and_text_keys(spark, tmp_path):
    none = spark.createDataFrame([], "id string, vec array<float>")
    vectors.export_npz(none, str(tmp_path / "none"), ["id"], "vec")
    assert vectors.import_npz(spark, str(tmp_path / "none"), ["id"], key_type="string").count() == 0
    one = spark.createDataFrame([("ä", [1.0])], none.schema)
    vectors.export_npz(one, str(tmp_path / "one"), ["id"], "vec")
    assert collected(vectors.import_npz(spark, str(tmp_path / "one"), ["id"], key_type="string")) == {"ä": [1.0]}


@pytest.mark.parametrize("rows", [[(1, [1.0]), (2, [1.0, 2.0])], [(None, [1.0])], [(1, None)], [(1, [None, 1.0])]])
def test_unusable_rows_are_refused(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "id long, vec array<float>").coalesce(1)
    with pytest.raises(Exception, match="null|uneven"):
        vectors.export_npz(df, str(tmp_path / "bad"), ["id"], "vec")


def test_files_that_do_not_fit_together_are_refused(spark, tmp_path):
    matrix, keys = arrays(10)
    np.savez(tmp_path / "a.npz", embeddings=matrix, id=keys[:9])
    with pytest.raises(Exception, match="differ in number"):
        vectors.import_npz(spark, str(tmp_path / "a.npz"), ["id"]).count()
