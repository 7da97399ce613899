"""The folder source and archives that are read in place."""

import io
import os
import random
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import archives, foldertree


def make(root, files, folders=()):
    for f in files:
        p = root / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (len(f) % 7))
    for f in folders:
        (root / f).mkdir(parents=True, exist_ok=True)


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_folder_tree(spark, tmp_path, partitions):
    files = ["top.txt", ".hidden", "a/one.mp3", "a/.dot/two.txt", "a/b/c/d/deep.txt", "a/x.tmp", "shut/.noindex", "shut/in.txt", "shut/sub/in.txt", "c/@eaDir/thumb.jpg", "c/keep.log", "c/logs/no.log", "c/logs/yes.log"]
    make(tmp_path / "r", files, ["empty/inner", "c/void"])
    foldertree.register(spark)
    read = spark.read.format("folder_tree").option("partitions", partitions).option("ignore", "*.log\n!yes.log")
    for root in (f"{tmp_path}/r", f"file:{tmp_path}/r", f"file://{tmp_path}/r/"):
        rows = {r.path.removeprefix(f"{tmp_path}/r/"): r for r in read.load(root).collect()}
        folders = {"a", "a/.dot", "a/b", "a/b/c", "a/b/c/d", "c", "c/void", "c/logs", "empty", "empty/inner"}
        kept = {"top.txt", ".hidden", "a/one.mp3", "a/.dot/two.txt", "a/b/c/d/deep.txt", "c/logs/yes.log"}
        assert set(rows) == folders | kept and {p for p, r in rows.items() if r.is_dir} == folders
    assert all(rows[f].size == len(f) % 7 and rows[f].modified for f in kept)
    assert rows["empty/inner"].n_entries == 0 and rows["a"].n_entries == 3 and rows["empty"].size is None
    assert spark.read.format("folder_tree").load(f"{tmp_path}/none").count() == 0


def zipped(path, entries, lead=b"", **more):
    with open(path, "wb") as f:
        f.write(lead)
        with zipfile.ZipFile(f, "a" if lead else "w", **more) as z:
            for name, data in entries:
                z.writestr(name, data)


def contents(spark, found):
    parts = archives.entry_parts(found).collect()
    whole = {}
    for r in sorted(parts, key=lambda r: (r.internal, r.part)):
        text, error = whole.get(r.internal, (b"", None))
        whole[r.internal] = (text + bytes(r.content or b""), r.error or error)
    return whole


def test_archives_are_read_in_place(spark, tmp_path):
    rnd = random.Random(3)
    big = bytes(rnd.randrange(256) for _ in range(1 << 16)) * 40
    entries = [("Dir/a.txt", b"hello"), ("dir/A.txt", b"other"), ("é漢.txt", "ü".encode()), ("sub/", b""), ("back\\slash.txt", b"y"), ("/lead.txt", b"z"), ("big.bin", big), ("none", b"")]
    zipped(tmp_path / "deflated.zip", entries, compression=zipfile.ZIP_DEFLATED)
    zipped(tmp_path / "stored.cbz", entries, b"#!something in front\n")
    (tmp_path / "no.zip").write_bytes(b"PK\x05\x06 no archive at all")
    (tmp_path / "short.zip").write_bytes((tmp_path / "deflated.zip").read_bytes()[:-30])
    (tmp_path / "void.zip").write_bytes(b"")
    bad = bytearray((tmp_path / "stored.cbz").read_bytes())
    bad[bad.index(b"hello")] = ord("j")
    (tmp_path / "bad.zip").write_bytes(bad)
    paths = [f"file://{tmp_path}/{n}" for n in ("deflated.zip", "stored.cbz", "no.zip", "short.zip", "void.zip", "absent.zip", "bad.zip")] + [None]
    listed = archives.archive_entries(spark.createDataFrame([(p,) for p in paths], "archive string")).cache()
    want = {"Dir/a.txt", "dir/A.txt", "é漢.txt", "back/slash.txt", "lead.txt", "big.bin", "none"}
    for p in (paths[0], paths[1], paths[6]):
        assert {r.internal for r in listed.where(F.col("archive") == p).collect()} == want
    assert listed.count() == 3 * len(want) and listed.where("size = 5 and modified > '2020-01-01'").count() == 6
    by_name = {n.replace("\\", "/").lstrip("/"): d for n, d in entries if not n.endswith("/")}
    for p in paths[:2]:
        assert contents(spark, listed.where(F.col("archive") == p)) == {n: (d, None) for n, d in by_name.items()}
    assert contents(spark, listed.where((F.col("archive") == paths[6]) & (F.col("internal") == "Dir/a.txt"))) == {"Dir/a.txt": (b"jello", "checksum differs")}
    asked = spark.createDataFrame([(paths[0], "dir/A.txt"), (paths[0], "DIR/a.TXT"), (paths[0], "BIG.bin"), (paths[0], "no"), ("x", "big.bin")], "archive string, internal string")
    assert {(r.asked, r.internal) for r in archives.found_entries(listed, asked).collect()} == {("dir/A.txt", "dir/A.txt"), ("DIR/a.TXT", "Dir/a.txt"), ("BIG.bin", "big.bin")}
    few = archives.archive_entries(spark.createDataFrame([(paths[0],)], "archive string"), max_entries=7)
    assert few.count() == 0


def test_archive_of_over_two_gigabytes(spark, tmp_path):
    """A sparse archive of 5 GB with long offsets: listing and one entry at its end take little memory."""
    path, gap = tmp_path / "huge.zip", 5 << 30
    small = io.BytesIO()
    with zipfile.ZipFile(small, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("late.txt", "late " * 1000)
    with open(path, "wb") as f:
        z = zipfile.ZipFile(f, "w", allowZip64=True)
        z.writestr("first.txt", b"first")
        hole = zipfile.ZipInfo("hole.bin")
        hole.compress_size = hole.file_size = gap
        hole.header_offset, hole.CRC = f.tell(), 0
        f.write(hole.FileHeader(zip64=True))
        f.seek(gap, os.SEEK_CUR)
        z.filelist.append(hole)
        z.NameToInfo["hole.bin"] = hole
        z.start_dir = f.tell()
        z.writestr("late.txt", b"late " * 1000, zipfile.ZIP_DEFLATED)
        z.close()
    assert path.stat().st_size > gap and path.stat().st_blocks * 512 < 10 << 20
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with open(path, "rb") as f:
        found = {e[0]: e for e in archives.entries(f, path.stat().st_size)}
        assert found["hole.bin"][1] == gap and found["late.txt"][4] > gap
        _, _, packed, method, at, crc, _ = found["late.txt"]
        assert b"".join(archives.unpacked(f, at, packed, method, crc)) == b"late " * 1000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50 << 10
    listed = archives.archive_entries(spark.createDataFrame([(str(path),)], "archive string"))
    assert contents(spark, listed.where("internal = 'late.txt'")) == {"late.txt": (b"late " * 1000, None)}
