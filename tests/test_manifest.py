import hashlib
from pathlib import Path

from plumbline.plans.features import manifest_check
from plumbline.sources.tables import file_hashes


def test_tables_of_several_files_are_one_entry_each(spark, tmp_path):
    d = tmp_path / "d"
    for name, parts in (("region", None), ("orders", 3), ("events", 2)):
        if parts is None:
            d.mkdir(exist_ok=True)
            (d / f"{name}.parquet").write_bytes(b"one file")
        for k in range(parts or 0):
            (d / f"{name}.parquet").mkdir(parents=True, exist_ok=True)
            (d / f"{name}.parquet" / f"part-{k}.parquet").write_bytes(f"{name} {k}".encode() * (k + 1))  # the same names in each folder
    got = {r["name"]: (r["size"], r["sha256"]) for r in file_hashes(spark, f"{d}/*.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "\n".join(f"{p.name} {sha(p.read_bytes())}" for p in sorted(Path(d / "events.parquet").iterdir()))
    assert set(got) == {"region.parquet", "orders.parquet", "events.parquet"}
    assert got["region.parquet"] == (8, sha(b"one file")) and got["events.parquet"] == (24, sha(lines.encode()))
    want = {("absent.parquet", "missing"), ("region.parquet", "size")}
    assert {tuple(r) for r in manifest_check(spark, str(d)).collect()} == want
    moved = d / "region.parquet"
    moved.unlink()
    moved.mkdir()
    (moved / "part-0.parquet").write_bytes(b"a folder")
    rows = manifest_check(spark, str(d)).collect()
    assert len(rows) == 2 and {tuple(r) for r in rows} == want


def test_files_are_hashed_piece_by_piece(spark, tmp_path):
    """A file of over 2 GB doesn't fit a binaryFile row."""
    d = tmp_path / "a folder, 50%"
    (d / "big.parquet").mkdir(parents=True)
    size, digest, zeros = (1 << 31) + 5, hashlib.sha256(), bytes(1 << 20)
    with open(d / "big.parquet" / "part #1.parquet", "wb") as f:
        f.truncate(size)  # without blocks on the disk
    for at in range(0, size, len(zeros)):
        digest.update(zeros[: size - at])
    (d / "region.parquet").write_bytes(b"r" * 9_000_000)
    got = {r["name"]: (r["size"], r["sha256"]) for r in file_hashes(spark, f"{d}/*.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {"big.parquet": (size, sha(f"part #1.parquet {digest.hexdigest()}".encode())), "region.parquet": (9_000_000, sha(b"r" * 9_000_000))}
    assert got == want
    assert {tuple(r) for r in manifest_check(spark, str(d)).collect()} == {("absent.parquet", "missing"), ("region.parquet", "size")}
