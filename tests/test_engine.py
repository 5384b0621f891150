"""Known answers, round trips and invariants of the engine."""

import hashlib
import hmac
import io
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultframe.functions import codecs
from vaultframe.functions import scalars as S
from vaultframe.operators import catalog, chunking, dedup, diff, goodbye, index, manifest, snapshots, transfer
from vaultframe.plans import backup
from vaultframe.sources import archive, browse, folders, indexes
from vaultframe.streaming import arrivals


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def ends(spark, *values, stream="s"):
    return spark.createDataFrame([(stream, k, e, f"{k:064x}") for k, e in enumerate(values)], "stream string, pos long, end_offset long, digest string")


def scanned(bounds, offset):
    """The first chunk whose end is above an offset, by looking at each."""
    return next((k for k, e in enumerate(bounds) if e > offset), None)


def test_chunk_of_dynamic(spark):
    rnd = random.Random(3)
    bounds = list(itertools.accumulate(rnd.randint(1, 5000) for _ in range(40)))
    probes = sorted({p for e in bounds for p in (e - 1, e, e + 1)} | {0, bounds[-1] + 99})
    points = spark.createDataFrame([("s", o) for o in probes], "stream string, offset long")
    for bucket in (700, 1 << 22):
        got = {r.offset: r.pos for r in index.chunk_of(points, ends(spark, *bounds), bucket).collect()}
        assert got == {o: scanned(bounds, o) for o in probes}


def test_chunk_of_fixed(spark):
    size, chunk = 3_000_007, 48_611
    bounds = index.fixed_bounds(spark.createDataFrame([("s", size)], "stream string, total long"), chunk)
    probes = [*range(0, size, 9973), chunk - 1, chunk, size - 1, size]
    points = spark.createDataFrame([("s", o) for o in probes], "stream string, offset long")
    assert {r.offset: r.pos for r in index.chunk_of(points, bounds).collect()} == {o: o // chunk if o < size else None for o in probes}
    tail = index.fixed_bounds(spark.createDataFrame([("a", 70), ("b", 0), ("c", 60)], "stream string, total long"), 30)
    assert rows(tail, "stream", "start_offset", "end_offset") == [("a", 0, 30), ("a", 30, 60), ("a", 60, 70), ("c", 0, 30), ("c", 30, 60)]


def test_file_ranges(spark):
    rnd = random.Random(5)
    bounds = list(itertools.accumulate(rnd.randint(1, 900) for _ in range(30)))
    files, at = [], 0
    while at + 16 < bounds[-1]:
        size = min(rnd.choice([0, 1, 40, 900, 2500]), bounds[-1] - at - 16)
        files.append(("s", at, size))
        at += 16 + size
    want = []
    for _, place, size in files:
        for k, (a, b) in enumerate(zip([0, *bounds], bounds, strict=False)):
            low, high = max(a, place + 16), min(b, place + 16 + size)
            if low < high:
                want.append((place, k, low, high, low == a and high == b))
    got = index.file_ranges(spark.createDataFrame(files, "stream string, payload_offset long, size long"), ends(spark, *bounds), 512)
    assert rows(got, "payload_offset", "chunk_index", "content_start", "content_end", "is_full_chunk") == sorted(want)


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(index, "RANGE", 7)
    rnd = random.Random(9)
    data = [(s, p, rnd.randint(0, 50)) for s in ("a", "b") for p in rnd.sample(range(200), 60)]
    chunks = spark.createDataFrame(data, "stream string, pos long, size long")
    want = []
    for s in ("a", "b"):
        at = 0
        for _, p, n in sorted(x for x in data if x[0] == s):
            want.append((s, p, at, at + n))
            at += n
    assert rows(index.with_ends(chunks), "stream", "pos", "start_offset", "end_offset") == want
    back = index.with_starts(index.with_ends(chunks).drop("start_offset"))
    assert rows(back, "stream", "pos", "start_offset", "end_offset") == want


def test_long_index_checksum(spark):
    n = 200_000
    entries = spark.range(n).select(F.lit("s").alias("stream"), F.col("id").alias("pos"), (F.col("id") + 1).alias("end_offset"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    body = b"".join((k + 1).to_bytes(8, "little") + hashlib.sha256(str(k).encode()).digest() for k in range(n))
    assert index.checksum(entries).first().csum == hashlib.sha256(body).hexdigest()


def test_look_ups_that_fail(spark):
    entries = spark.createDataFrame([("/a/b", 5, 100)], "path string, size long, file_offset long")
    asked = spark.createDataFrame([(1, "/a/b"), (2, "/a/c")], "pos long, path string")
    assert catalog.found(entries, asked.filter("pos = 1")).first()["size"] == 5
    with pytest.raises(Exception, match="no such entry: /a/c"):
        catalog.found(entries, asked).collect()
    assert rows(catalog.at_offset(entries, spark.createDataFrame([(100,), (101,)], "file_offset long")).fillna(-1), "file_offset", "size") == [(100, 5), (101, -1)]


def test_restore(spark):
    blobs = [b"0123456789", b"abcdefghij", b"ABCDEFGHIJ"]
    digest = [hashlib.sha256(b).hexdigest() for b in blobs]
    idx = spark.createDataFrame([("s", k, 10 * (k + 1), d) for k, d in enumerate(digest)], "stream string, pos long, end_offset long, digest string")
    chunks = spark.createDataFrame([(d, 10, b) for d, b in zip(digest, blobs, strict=True)], "digest string, size long, blob binary")
    want = {(0, 5): b"01234", (8, 4): b"89ab", (12, 3): b"cde", (8, 8): b"89abcdef", (25, 5): b"FGHIJ", (0, 30): b"".join(blobs), (25, 99): b"FGHIJ", (3, 0): b""}
    asked = spark.createDataFrame([("s", *k) for k in want], "stream string, offset long, length long")
    assert {(r.offset, r.length): bytes(r.data) for r in index.restored_ranges(asked, idx, chunks).collect()} == want
    assert bytes(index.restored(idx, chunks).first().data) == b"".join(blobs)
    with pytest.raises(Exception, match="beyond the end"):
        index.restored_ranges(spark.createDataFrame([("s", 30, 1)], "stream string, offset long, length long"), idx, chunks).collect()
    with pytest.raises(Exception, match="missing chunk"):
        index.restored(idx, chunks.limit(2)).collect()
    body = b"".join((10 * (k + 1)).to_bytes(8, "little") + bytes.fromhex(d) for k, d in enumerate(digest))
    assert index.checksum(idx).first().csum == hashlib.sha256(body).hexdigest()
    assert index.checksum(idx, fixed=True).first().csum == hashlib.sha256(b"".join(map(bytes.fromhex, digest))).hexdigest()


def test_search_tree_layout():
    want = {0: [], 1: [0], 2: [1, 0], 3: [1, 0, 2], 4: [2, 1, 3, 0], 5: [3, 1, 4, 0, 2], 6: [3, 1, 5, 0, 2, 4], 7: [3, 1, 5, 0, 2, 4, 6], 8: [4, 2, 6, 1, 3, 5, 7, 0]}
    assert {n: goodbye.layout(n) for n in want} == want
    for n in range(200):
        tree = goodbye.layout(n)
        for k in range(1, n):
            assert (tree[k] < tree[(k - 1) // 2]) == bool(k % 2)


def test_chunk_config():
    c = chunking.Config(4 << 20)
    assert (c.least, c.most, c.mask, c.threshold) == (1 << 20, 16 << 20, (8 << 20) - 1, (8 << 20) - 3)
    for bad in (0, 3, 32, 100):
        with pytest.raises(ValueError):
            chunking.Config(bad)


def scalar_boundaries(data, c):
    """One byte after the other, with a window."""
    turn = lambda v, k: (v << k % 32 | v >> (32 - k % 32)) & 0xFFFFFFFF if k % 32 else v
    table, out, start = [int(v) for v in chunking.TABLE], [], 0
    h = 0
    for i, b in enumerate(data):
        h = turn(h, 1) ^ table[b] ^ (table[data[i - 64]] if i >= 64 else 0)
        size = i + 1 - start
        if i >= 64 and (size >= c.most or size >= c.least and h & c.mask >= c.threshold):
            out.append(i + 1)
            start = i + 1
    return out + ([len(data)] if start < len(data) else [])


def test_content_defined_chunks(spark):
    rnd = random.Random(7)
    for average, n in ((64, 5000), (256, 20000), (1024, 60000)):
        c, data = chunking.Config(average), rnd.randbytes(n)
        got = chunking.boundaries(data, c)
        assert got == scalar_boundaries(data, c)
        sizes = np.diff([0, *got])
        assert got[-1] == n and sizes.max() <= c.most and (sizes[:-1] >= c.least).all()
    assert chunking.boundaries(b"", c) == [] and chunking.boundaries(b"x" * 64, c) == [64]
    edited = chunking.boundaries(rnd.randbytes(300) + data, c)  # later cuts stay where they were
    assert len({e - 300 for e in edited} & set(got)) > len(got) // 2
    df = spark.createDataFrame([("a", data), ("b", b""), ("c", None)], "stream string, data binary")
    chunks = chunking.content_defined(df, c)
    assert bytes(index.restored(chunks.select("stream", "pos", "end_offset", "digest"), chunks.select("digest", "blob").dropDuplicates(["digest"])).first().data) == data


def test_siphash():
    key = tuple(int.from_bytes(bytes(range(8 * k, 8 * k + 8)), "little") for k in range(2))
    got = codecs.siphash([bytes(range(n)) for n in (0, 1, 8, 15)], key)
    assert [int(v) for v in got] == [0x726FDB47DD0E0E31, 0x74F839C593DC67FD, 0x93F5F5799A932462, 0xA129CA6149BE45E5]  # of the published vectors


def test_blobs(spark):
    data = [b"", b"short", b"a" * 1000, os.urandom(1000)]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(data)], "k int, d binary")
    key = bytes(range(32))
    nonce = F.unhex(F.lpad(F.hex("k"), 24, "0"))
    got = df.select("k", codecs.blob_encode(F.col("d")).alias("p"), codecs.blob_encode(F.col("d"), True).alias("c"), codecs.blob_encrypt(F.col("d"), key, nonce, True).alias("e")).collect()
    for r in got:
        assert bytes(r.p)[:8] == codecs.PLAIN and len(r.p) == 12 + len(data[r.k])
        assert bytes(r.c)[:8] == (codecs.COMPRESSED if r.k == 2 else codecs.PLAIN)
        assert bytes(r.e)[:8] == (codecs.ENCRYPTED_COMPRESSED if r.k == 2 else codecs.ENCRYPTED)
    back = spark.createDataFrame(got)
    for c in ("p", "c", "e"):
        assert [bytes(r.d) for r in back.orderBy("k").select(codecs.blob_decode(F.col(c), key).alias("d")).collect()] == data
    with pytest.raises(Exception, match="CRC"):
        spark.createDataFrame([(codecs.PLAIN + b"\0\0\0\0abc",)], "b binary").select(codecs.blob_decode(F.col("b"))).collect()
    for k in (b"k", b"long" * 30):
        assert df.select(codecs.hmac_sha256(F.col("d"), k).alias("h")).collect()[2].h == hmac.new(k, data[2], "sha256").hexdigest()


def test_keys_and_signatures():
    m = {"backup-type": "vm", "backup-id": "100", "backup-time": 1700000000, "files": [{"filename": "a", "size": 1, "csum": "x"}]}
    m["signature"] = codecs.sign_manifest(m, b"id")
    assert codecs.manifest_signature_ok(m, b"id") and not codecs.manifest_signature_ok(m | {"backup-id": "101"}, b"id")
    assert codecs.derive_id_key(b"p", b"s", 2) == hmac.new(b"p", hmac.new(b"p", b"s", "sha256").digest(), "sha256").digest()


def stat(mode, **more):
    return {"mode": mode, "flags": 0, "uid": 1000, "gid": 1000, "mtime_secs": -5, "mtime_nanos": 7} | more


def tree():
    acl = {"users": [{"id": 1, "permissions": 7}], "groups": [], "group_obj": 5, "default": {"user_obj": 7, "group_obj": 5, "other": 0, "mask": -1}, "default_users": [], "default_groups": [{"id": 3, "permissions": 4}]}
    return [
        {"path": "/", "kind": "directory", **stat(0o040755)},
        {"path": "/dev", "kind": "device", "dev_major": 8, "dev_minor": 1, **stat(0o060600)},
        {"path": "/hello.txt", "kind": "file", "content": b"hello world", **stat(0o100644, xattrs=[{"name": b"user.a", "value": b"1\x002"}], acl=acl, fcaps=b"cap", quota_project_id=9)},
        {"path": "/link", "kind": "symlink", "link_target": "/target", **stat(0o120777)},
        {"path": "/pipe", "kind": "fifo", **stat(0o010644)},
        {"path": "/sock", "kind": "socket", **stat(0o140644)},
        {"path": "/subdir", "kind": "directory", **stat(0o040700)},
        {"path": "/subdir/hard", "kind": "hardlink", "link_target": "/hello.txt", "mode": None},
        {"path": "/subdir/nested.txt", "kind": "file", "content": b"nested content", **stat(0o100600)},
        {"path": "/subdir/ünïcode", "kind": "file", "content": b"", **stat(0o100600)},
    ]


@pytest.mark.parametrize("split", [False, True])
def test_archive_round_trip(spark, tmp_path, split):
    main, pay = archive.encode(tree(), split, b"note" if split else None)
    got = list(archive.read(io.BytesIO(main), io.BytesIO(pay) if pay else None))
    assert [e["path"] for e in got] == [e["path"] for e in tree()]
    for a, b in zip(tree(), got, strict=True):
        assert all(b[k] == v for k, v in a.items() if k != "acl")
    assert got[2]["acl"] == tree()[2]["acl"] and got[7]["link_offset"] == got[2]["file_offset"]
    (tmp_path / "a").write_bytes(main)
    (tmp_path / "b").write_bytes(pay or b"")
    archive.register(spark)
    reader = spark.read.format("archive").option("path", str(tmp_path / "a"))
    df = (reader.option("payload_path", str(tmp_path / "b")) if split else reader).load()
    assert rows(df.filter("kind = 'file'"), "path", "size") == [("/hello.txt", 11), ("/subdir/nested.txt", 14), ("/subdir/ünïcode", 0)]
    assert bytes(df.filter("path = '/subdir/nested.txt'").first().content) == b"nested content"
    assert rows(catalog.walk(df.select("path", "kind", "size"), "/subdir", ("file",)), "path") == [("/subdir/nested.txt",), ("/subdir/ünïcode",)]
    assert rows(catalog.hard_links(df), "path", "target", "size") == [("/subdir/hard", "/hello.txt", 11)]
    with pytest.raises(ValueError):
        list(archive.read(io.BytesIO(main[:-60])))


def test_archive_negative():
    for bad in ({"path": "/a/b", "kind": "file", **stat(0o100644)}, {"path": "/a", "kind": "fifo", **stat(0o100644)}, {"path": "/..", "kind": "file", **stat(0o100644)}):
        with pytest.raises(ValueError):
            archive.encode([tree()[0], bad])


def test_binary_indexes(spark):
    entries = [(1000, "aa" * 32), (2500, "bb" * 32)]
    files = spark.createDataFrame([("s", indexes.encode_dynamic(entries, 5)), ("e", indexes.encode_dynamic([], 5))], "stream string, content binary")
    assert rows(indexes.dynamic(files), "pos", "end_offset", "digest") == [(0, *entries[0]), (1, *entries[1])]
    h = indexes.headers(files).filter("stream = 's'").first()
    assert h.created == 5 and h.csum == hashlib.sha256(b"".join(e.to_bytes(8, "little") + bytes.fromhex(d) for e, d in entries)).hexdigest()
    one = spark.createDataFrame([("f", indexes.encode_fixed(["aa" * 32, "bb" * 32], 64, 100, 5))], "stream string, content binary")
    assert rows(indexes.fixed(one), "pos", "end_offset", "chunk_size", "total_size") == [(0, 64, 64, 100), (1, 100, 64, 100)]
    with pytest.raises(Exception, match="not an index"):
        indexes.fixed(files).collect()


def test_browse_catalog(spark):
    for v in (0, 1, 127, 128, 2**32, 2**63, -1, -127, -128, -100000):
        assert browse.parse_number(browse.number(v) + b"x", 0, True) == (v, len(browse.number(v)))
    data = [{"path": f"/d/{n}", "kind": "file", "size": s, "mtime": m} for n, s, m in (("file1.txt", 100, 1700000000), ("file2.txt", 2**32, -1), ("z", 0, -100000), ("y", 1, 0))]
    data += [{"path": "/l", "kind": "symlink"}, {"path": "/d/e/f", "kind": "fifo"}, {"path": "/empty", "kind": "directory"}]
    df = browse.rows(spark.createDataFrame([(browse.encode(data),)], "content binary"))
    assert rows(df, "path", "kind", "depth") == sorted([("/", "directory", 0), ("/d", "directory", 1), ("/d/e", "directory", 2), ("/d/e/f", "fifo", 3), ("/empty", "directory", 1), ("/l", "symlink", 1)] + [(r["path"], "file", 2) for r in data[:4]])
    assert rows(df.filter("kind = 'file'"), "path", "size", "mtime") == sorted((r["path"], r["size"], r["mtime"]) for r in data[:4])


def test_diff(spark):
    base = {"kind": "file", "size": 100, **stat(0o100644), "xattrs": [("a", "1"), ("b", "2")], "quota_project_id": None}
    cases = {"same": {}, "size": {"size": 1}, "mtime": {"mtime_secs": 0}, "type": {"kind": "symlink"}, "mode": {"mode": 0o100600}, "xattr": {"xattrs": [("b", "2"), ("a", "1")]}, "quota": {"quota_project_id": 1}}
    schema = "path string, kind string, size long, mode long, flags long, uid long, gid long, mtime_secs long, mtime_nanos int, xattrs array<struct<name: string, value: string>>, quota_project_id long"
    a = spark.createDataFrame([{"path": f"/{k}", **base} for k in [*cases, "gone"]], schema)
    b = spark.createDataFrame([{"path": f"/{k}", **base, **v} for k, v in [*cases.items(), ("new", {})]], schema)
    want = {f"/{k}": "changed" for k in cases} | {"/same": "unchanged", "/gone": "removed", "/new": "added"}
    assert dict(rows(diff.changes(a, b), "path", "status")) == want
    assert {p for (p,) in rows(diff.to_read(a, b), "path")} == {p for p, s in want.items() if s in ("changed", "added")}


def test_walks_and_pages(spark):
    files = spark.createDataFrame([("/top.txt", "file", 9), ("/a/b/deep.txt", "file", 4), ("/a/mid.txt", "file", 3)], "path string, kind string, size long")
    every = catalog.with_directories(files)
    assert rows(catalog.walk(every, kinds=("file",)), "path") == [("/a/b/deep.txt",), ("/a/mid.txt",), ("/top.txt",)]
    assert [r.path for r in every.orderBy(catalog.order()).collect()] == ["/", "/a", "/a/b", "/a/b/deep.txt", "/a/mid.txt", "/top.txt"]
    assert [r.path for r in catalog.skip(every, 4).collect()] == ["/a/mid.txt", "/top.txt"]
    assert rows(catalog.walk(every, pruned=spark.createDataFrame([("/a/b",)], "path string")), "path") == [("/",), ("/a",), ("/a/mid.txt",), ("/top.txt",)]
    assert [(r.position, r.name) for r in catalog.page(every, "/a", 1, 3).orderBy("position").collect()] == [(2, "mid.txt"), (3, "."), (4, "..")]
    asked = spark.createDataFrame([(0, "/a/mid.txt"), (1, "/no"), (2, "/a/mid.txt")], "pos long, path string")
    assert rows(catalog.look_up(every, asked).fillna(-1), "pos", "size") == [(0, 3), (1, -1), (2, 3)]
    assert catalog.result(every).first().asDict() == {"files": 3, "directories": 2, "bytes": 16}
    assert rows(transfer.merged([files, files.withColumn("size", F.lit(1).cast("long"))], "last").filter("kind = 'file'"), "size") == [(1,), (1,), (1,)]
    assert transfer.merged([files, files]).filter("kind = 'file'").count() == 6
    assert rows(transfer.mapped(every, "/a", "/"), "path") == [("/",), ("/b",), ("/b/deep.txt",), ("/mid.txt",)]
    assert rows(transfer.mapped(every, "/", "/x"), "path")[:2] == [("/x",), ("/x/a",)]


def test_scalars(spark):
    df = spark.createDataFrame([(8, 1), (0xFFFFF123, 0xFFFFFF45)], "a long, b long").withColumn("dev", S.device_number("a", "b"))
    assert rows(df.select(S.device_major("dev").alias("a"), S.device_minor("dev").alias("b")), "a", "b") == [(8, 1), (0xFFFFF123, 0xFFFFFF45)]
    one = spark.range(1).select(S.le64(F.lit(-2)).alias("a"), S.from_le(F.unhex(F.lit("0102")), 0, 2).alias("b"), S.colon_hex(F.unhex(F.lit("0aff"))).alias("c"), S.snapshot_path(F.lit("vm"), F.lit("100"), F.lit(1700000000)).alias("d"), S.in_mask(F.lit("file"), 1 << 7).alias("e"), S.parent_of(F.lit("/a")).alias("f"), S.kind_number(F.lit("directory")).alias("g")).first()
    assert (bytes(one.a), one.b, one.c, one.d, one.e, one.f, one.g) == ((-2).to_bytes(8, "little", signed=True), 513, "0A:FF", "vm/100/2023-11-14T22:13:20Z", True, "/", 8)
    t = spark.createDataFrame([(-1,)], "n long").select(*S.from_nanos("n")).first()
    assert (t.mtime_secs, t.mtime_nanos) == (-1, 999_999_999)


def test_manifest(spark):
    files = spark.createDataFrame([("vm", "100", 1700000000, f, "none", s, c) for f, s, c in (("b", 2, "y"), ("a", 1, "x"))], "backup_type string, backup_id string, backup_time long, filename string, crypt_mode string, size long, csum string")
    back = manifest.parsed(manifest.assembled(files))
    assert rows(back, "filename", "size", "csum") == [("a", 1, "x"), ("b", 2, "y")]
    actual = spark.createDataFrame([("a", "x", 1), ("b", "z", 9), ("c", "x", 1)], "filename string, csum string, size long")
    assert rows(manifest.verified(back, actual), "filename", "status") == [("a", "ok"), ("b", "csum"), ("c", "missing")]


def test_backups(spark, tmp_path):
    body = {"/top.txt": b"t" * 3000, "/subdir/unchanged.txt": os.urandom(9000), "/subdir/changed.txt": os.urandom(9000)}

    def snapshot(content, **mtimes):
        rows_ = [(p, "file", len(b), mtimes.get(p.rpartition("/")[2].partition(".")[0], 1), b) for p, b in content.items()]
        return spark.createDataFrame(rows_, "path string, kind string, size long, mtime_secs long, content binary")

    c = chunking.Config(256)
    one = backup.full(snapshot(body), c)
    store = str(tmp_path / "store")
    first = dedup.insert(one.new_chunks, store)
    assert backup.full(snapshot(body), c, first).new_chunks.count() == 0
    body["/subdir/changed.txt"] = b"new" + body["/subdir/changed.txt"]
    two = backup.incremental(snapshot(body, changed=2), snapshot(dict(body, **{"/subdir/changed.txt": b"-" * 9000})).drop("content"), one.index, c, first)
    assert 0 < two.new_chunks.count() < one.new_chunks.count()
    everything = dedup.insert(two.new_chunks, store)
    assert {r.stream: bytes(r.data) for r in index.restored(two.index, everything).collect()} == body
    assert two.result().first().asDict() == {"files": 3, "directories": 1, "bytes": sum(map(len, body.values()))}
    assert two.manifest_files().count() == 3


def test_snapshots(spark):
    df = spark.createDataFrame([("vm", "1", "2024-01-01T00:00:00Z"), ("vm", "1", "owner"), ("vm", "1", "2024-01-02T00:00:00Z")], "type string, id string, dir string")
    got = snapshots.listed(df)
    assert rows(got, "backup_time") == [(1704067200,), (1704153600,)]
    assert rows(snapshots.with_previous(got.withColumnRenamed("backup_time", "time")).fillna(-1), "time", "previous") == [(1704067200, -1), (1704153600, 1704067200)]


def test_folders(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "f.txt").write_bytes(b"abc")
    assert rows(folders.files(spark, str(tmp_path / "d")), "path", "size") == [("/e/f.txt", 3)]


def test_streaming(spark, tmp_path):
    schema = "digest string, size long, blob binary"
    for n, digests in enumerate((["aa", "bb", "aa"], ["bb", "cc"])):
        spark.createDataFrame([(x, 1, b"x") for x in digests], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals.into_store(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "store")), "digest") == [("aa",), ("bb",), ("cc",)]
