import numpy as np
import pytest

from plumbline.sources.blocks import BlockReader, BlockSource, read_blocks, read_parts, write_blocks


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    at, r = tmp_path_factory.mktemp("blocks"), np.random.default_rng(0)
    blocks = {"C": r.normal(size=(9000, 5)).astype(np.float32), "K": r.normal(size=(9000, 3)), "y": r.integers(0, 9, 9000)}
    np.savez(at / "plain.npz", **blocks)
    np.savez_compressed(at / "packed.npz", **blocks)
    (at / "files").mkdir()
    for k, v in blocks.items():
        np.save(at / "files" / f"{k}.npy", v)
    return at, blocks


@pytest.mark.parametrize("name", ["plain.npz", "packed.npz", "files"])
def test_reads_what_was_written(spark, made, name):
    at, blocks = made
    df = read_blocks(spark, str(at / name), rows=2500)
    assert df.rdd.getNumPartitions() == 4
    assert df.dtypes == [("row_id", "bigint"), ("C", "array<float>"), ("K", "array<double>"), ("y", "bigint")]
    rows = df.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(9000))
    for k, v in blocks.items():
        assert np.array_equal(np.array([r[k] for r in rows], v.dtype), v)


def test_opens_only_the_keys_asked_for(spark, made, tmp_path):
    at, blocks = made
    np.save(tmp_path / "C.npy", blocks["C"])
    (tmp_path / "K.npy").write_bytes(b"not an array")
    assert read_blocks(spark, str(tmp_path), ["C"]).columns == ["row_id", "C"] and read_blocks(spark, str(tmp_path), ["C"]).count() == 9000
    with pytest.raises(Exception, match="no block"):
        read_blocks(spark, str(at / "plain.npz"), ["E"]).count()


def test_objects_and_odd_shapes_are_refused(tmp_path):
    np.savez(tmp_path / "o.npz", o=np.array([{"a": 1}], object))
    np.savez(tmp_path / "d.npz", d=np.zeros((2, 2, 2)))
    np.savez(tmp_path / "n.npz", a=np.zeros(2), b=np.zeros(3))
    np.savez(tmp_path / "e.npz", a=np.zeros((0, 2)))
    np.savez(tmp_path / "c.npz", a=np.zeros(2, complex))
    for name, what in (("o", "objects"), ("d", "dimensions"), ("c", "not numbers")):
        with pytest.raises(ValueError, match=what):
            BlockSource({"path": str(tmp_path / f"{name}.npz")}).schema()
    source = BlockSource({"path": str(tmp_path / "n.npz")})
    class Named:  # the reader only needs names and kinds
        fields = []

    with pytest.raises(ValueError, match="different lengths"):
        BlockReader(str(tmp_path / "n.npz"), source._keys(), 10, Named).partitions()
    assert [p.count for p in BlockReader(str(tmp_path / "e.npz"), {"a": "a.npy"}, 10, Named).partitions()] == [0]


def test_tasks_write_parts_that_are_read_back(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, values array<float>").repartition(3)
    files = {f["file"]: f["ids"] for f in write_blocks(df, f"file://{tmp_path}/parts").collect()}
    got = read_parts(spark, f"file://{tmp_path}/parts", rows=100)
    assert got.columns == ["file", "row_id", "values"] and got.rdd.getNumPartitions() >= 5
    rows = got.collect()
    assert len(rows) == 500 and all(np.array_equal(np.array(q["values"], np.float32), x[files[q["file"]][q["row_id"]]]) for q in rows)
