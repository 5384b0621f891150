"""Key files, streaming writers, look-up table places, attributes of Linux and chunk callbacks."""

import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from vaultframe.functions import keys
from vaultframe.functions import scalars as S
from vaultframe.operators import catalog, chunking, goodbye, manifest
from vaultframe.sources import archive

STAT = {"flags": 0, "uid": 0, "gid": 0, "mtime_secs": 1, "mtime_nanos": 0}
ROOT = {"path": "/", "kind": "directory", "mode": 0o040755, **STAT}
FILES = [{"path": f"/f{k}", "kind": "file", "mode": 0o100644, "content": bytes(range(k)) * 3, **STAT} for k in (0, 1, 90)]


@pytest.mark.parametrize("split", [False, True])
def test_file_written_in_parts(split):
    out, pay = io.BytesIO(), io.BytesIO() if split else None
    w = archive.Writer(out, pay)
    w.add(ROOT)
    for e in FILES:
        f = w.file(e, len(e["content"]))
        with pytest.raises(ValueError, match="still being written"):
            w.add(FILES[0])
        for at in range(0, len(e["content"]), 7):
            f.write(e["content"][at : at + 7])
        f.close()
    w.close()
    assert (out.getvalue(), pay.getvalue() if split else None) == archive.encode([ROOT, *FILES], split)


def test_file_of_another_size():
    w = archive.Writer(io.BytesIO())
    w.add(ROOT)
    f = w.file(FILES[0], 4)
    with pytest.raises(ValueError, match="1 bytes more"):
        f.write(b"12345")
    f.write(b"123")
    for end in (f.close, w.close):
        with pytest.raises(ValueError, match="missing|still"):
            end()
    f.write(b"4")
    f.close()
    w.close()
    assert archive.item_name(archive.XATTR).startswith("XATTR header (") and archive.item_name(1) == "UNKNOWN header (1)"


def test_places_are_the_layout_turned_round(spark):
    pairs = [(n, r) for n in range(1, 131) for r in range(n)]
    got = spark.createDataFrame(pairs, "n long, r long").select("n", "r", goodbye.place(F.col("r"), F.col("n")).alias("p")).collect()
    assert {(x.n, x.p): x.r for x in got} == {(n, p): r for n in range(1, 131) for p, r in enumerate(goodbye.layout(n))}


def test_key_files(spark):
    key, salt = keys.random_key(), b"s" * 32
    content = keys.key_file(spark, key, "päss", salt)
    assert keys.load_key(spark, content, "päss", salt) == key and len(set(content.split('"fingerprint": "')[1].split('"')[0].split(":"))) > 1
    assert keys.load_key(spark, keys.key_file(spark, key, None)) == key and "..." in repr(key)
    changed = lambda **kw: json.dumps(json.loads(content) | kw)
    bad = [(content, "pass", None, "wrong password"), (content, None, None, "needs"), (keys.key_file(spark, key, None), "x", None, "no password"), (content, "päss", b"t", "fingerprint")]
    bad += [(changed(kdf={"type": "scrypt"}), "päss", None, "scrypt"), (changed(data="AAAA"), "päss", None, "no encrypted key")]
    for text, password, of, why in bad:
        with pytest.raises(ValueError, match=why):
            keys.load_key(spark, text, password, of)
    with pytest.raises(ValueError, match="32 bytes"):
        keys.Key(b"short")


def test_signature_status(spark):
    files = [("vm", "1", 5, f"{n}", mode, 9, "c") for n, mode in (("b", None), ("a", "none"))]
    m = manifest.assembled(spark.createDataFrame(files, "backup_type string, backup_id string, backup_time long, filename string, crypt_mode string, size long, csum string"))
    signed = manifest.signed(m, b"k", "AB")
    status = lambda df, key=b"k": df.select(manifest.signature_status("manifest", key).alias("s")).first().s
    assert (status(m), status(signed), status(signed, b"l")) == ("missing", "ok", "mismatch")
    assert status(signed.withColumn("manifest", F.replace("manifest", F.lit('"size":9'), F.lit('"size":8')))) == "mismatch"
    assert len(manifest.parsed(signed).collect()) == 2


def acl(*entries, version=2):
    return struct.pack("<I", version) + b"".join(struct.pack("<HHI", *e) for e in entries)


def test_posix_acl(spark):
    rows = [(0, acl((1, 7, 0), (2, 6, 4_000_000_000), (2, 1, 5), (4, 4, 0), (8, 3, 9), (16, 7, 0), (32, 0, 0)), acl((1, 7, 0), (4, 5, 0), (8, 2, 11), (32, 1, 0))), (1, None, None), (2, acl(), acl())]
    df = spark.createDataFrame(rows, "k int, a binary, d binary")
    got = [r.acl.asDict(True) for r in df.orderBy("k").select(S.posix_acl("a", "d").alias("acl")).collect()]
    one = lambda who, may: {"id": who, "permissions": may}
    assert got[0] == {"users": [one(4_000_000_000, 6), one(5, 1)], "groups": [one(9, 3)], "group_obj": 4, "default": {"user_obj": 7, "group_obj": 5, "other": 1, "mask": None}, "default_users": [], "default_groups": [one(11, 2)]}
    assert got[1] == got[2] == {"users": [], "groups": [], "group_obj": None, "default": None, "default_users": [], "default_groups": []}
    for bad, why in ((b"ab", "too short"), (acl(version=3), "unknown version")):
        with pytest.raises(Exception, match=why):
            spark.createDataFrame([(bad, None)], "a binary, d binary").select(S.posix_acl("a", "d")).collect()


def test_names_and_inodes(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="unknown name: disk"):
        one.select(S.numbered(F.lit("disk"), S.BACKUP_TYPES)).collect()
    assert one.select(S.numbered(F.lit(None).cast("string"), S.BACKUP_TYPES).alias("n")).first().n is None
    with pytest.raises(ValueError, match="not metadata"):
        S.metadata(F.lit(0), size=F.lit(1))
    asked = spark.createDataFrame([(1, 4), (2, 4)], "inode long, mask int")
    assert sorted((r.inode, r.accessible) for r in catalog.accessible(spark.createDataFrame([(1,), (1,)], "inode long"), asked).collect()) == [(1, True), (2, False)]


def test_chunk_callback_and_table(tmp_path):
    data, c, seen = bytes(range(256)) * 40, chunking.Config(256), []
    every = chunking.each_chunk(data, c, lambda end, chunk: seen.append((end, chunk)))
    assert b"".join(x for _, x in seen) == data and [e for e, _ in seen] == chunking.boundaries(data, c) and every == len(seen) > 3
    seen.clear()
    assert chunking.each_chunk(data, c, lambda end, chunk: bool(seen.append(end)) or len(seen) < 2) == 2
    assert chunking.each_chunk(b"", c, lambda *_: None) == 0
    (tmp_path / "t").write_text(",\n".join(hex(int(x)) for x in chunking.TABLE))
    assert (chunking.read_table(str(tmp_path / "t")) == chunking.TABLE).all()
    (tmp_path / "t").write_text("1 2")
    with pytest.raises(ValueError, match="2 numbers"):
        chunking.read_table(str(tmp_path / "t"))
