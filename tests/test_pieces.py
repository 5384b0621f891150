"""Archives and streams that no task holds whole: in pieces they are the same bytes as in one row."""

import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_engine import tree
from vaultframe.functions import batches, codecs
from vaultframe.functions import scalars as S
from vaultframe.operators import chunking, index
from vaultframe.plans import backup
from vaultframe.plans import queries as Q
from vaultframe.sources import archive

SCHEMA = (
    "k string, path string, kind string, mode long, flags long, uid long, gid long, mtime_secs long, mtime_nanos int, xattrs array<struct<name: binary, value: binary>>, "
    "acl struct<users: array<struct<id: bigint, permissions: bigint>>, groups: array<struct<id: bigint, permissions: bigint>>, group_obj: bigint, `default`: struct<user_obj: bigint, group_obj: bigint, other: bigint, mask: bigint>, "
    "default_users: array<struct<id: bigint, permissions: bigint>>, default_groups: array<struct<id: bigint, permissions: bigint>>>, fcaps binary, quota_project_id long, link_target string, dev_major long, dev_minor long, content binary"
)


def entries():
    """Trees of which names sort otherwise than whole paths do, with directories of none to 40 entries."""
    rng = random.Random(5)
    stat = {"flags": 0, "uid": 1, "gid": 2, "mtime_secs": 3, "mtime_nanos": 4}
    out = [{"k": "a", **e} for e in tree()]
    for k in ("b", None):
        out.append({"k": k, "path": "/", "kind": "directory", "mode": 0o040755, **stat})
        for d in ("/a", "/a!", "/a.b", "/a/b", "/a\x01", "/empty"):
            out.append({"k": k, "path": d, "kind": "directory", "mode": 0o040755, **stat})
            for n in range(0 if d == "/empty" else rng.randrange(1, 40)):
                out.append({"k": k, "path": f"{d}/f{n}", "kind": "file", "mode": 0o100644, "content": rng.randbytes(rng.choice((0, 5, 3000, 90000))), **stat})
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(entries(), SCHEMA)


def whole(split):
    return {k: archive.encode([{f: v for f, v in e.items() if f != "k"} for e in entries() if e["k"] == k], split) for k in ("a", "b", None)}


@pytest.mark.parametrize("split", [False, True])
def test_pieces_are_the_archive(spark, table, split):
    made = archive.pieces(table, "k", split).collect()
    want = whole(split)
    for k, of in want.items():
        for payload, data in enumerate(of):
            rows = sorted((r.start_offset, bytes(r.data)) for r in made if r.k == k and r.payload == bool(payload))
            assert b"".join(b for _, b in rows) == (data or b"")
            assert all(at + len(b) == rows[n + 1][0] for n, (at, b) in enumerate(rows[:-1]))
            assert max((len(b) for _, b in rows), default=0) < 90200  # none grows with the archive, only with an entry
    assert {r.k: (bytes(r.archive), bytes(r.payload) if split else r.payload) for r in archive.archives(table, "k", split).collect()} == want


@pytest.mark.parametrize("split", [False, True])
def test_entries_from_pieces(spark, table, split):
    made = archive.pieces(table, "k", split)
    got = archive.entries_of_pieces(made.filter("NOT payload"), "k", True)
    got = archive.with_payloads(got, made.filter("payload"), "k", 1 << 10) if split else got
    seen = {(r.k, r.path): r for r in got.collect()}
    assert len(seen) == len(entries())
    for k, (main, pay) in whole(split).items():
        for e in archive.read(io.BytesIO(main), io.BytesIO(pay) if pay else None):
            r = seen[k, e["path"]].asDict(True)
            assert all((bytes(r[f]) if isinstance(v, bytes) else r[f]) == v for f, v in e.items() if f != "xattrs")


def test_pieces_refuse(spark, table):
    for bad, why in (("path <> '/a'", "before their directory"), ("path <> '/hello.txt'", "earlier file")):
        with pytest.raises(Exception, match=why):
            archive.pieces(table.filter(bad), "k").collect()
    with pytest.raises(Exception, match="comes twice"):
        archive.pieces(table.union(table.filter("path = '/a/f0'")), "k").collect()
    made = archive.pieces(table, "k")
    with pytest.raises(Exception, match="missing or there twice"):
        archive.entries_of_pieces(made.filter("start_offset <> 0"), "k").collect()
    both = archive.pieces(table, "k", True)
    with pytest.raises(Exception, match="no payload of"):
        archive.with_payloads(archive.entries_of_pieces(both.filter("NOT payload"), "k"), both.filter("payload AND start_offset < 20"), "k").collect()


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 4095, 4096, 4100, 70_000])
def test_chunks_over_blocks(spark, monkeypatch, size):
    """Blocks of 4 KiB here, so that chunks and windows cross their bounds; the same chunks as of the stream in one row."""
    monkeypatch.setattr(chunking, "BLOCK", 4096)
    rng, c = random.Random(size), chunking.Config(64 if size % 2 else 256)
    streams = {"r": rng.randbytes(size), "z": bytes(size), "p": (b"ab" * size)[:size]}
    rows = []
    for s, data in streams.items():
        at = 0
        while at < size:
            n = rng.choice((1, 7, 500, 9000))
            rows.append((s, at, data[at : at + n]))
            at += n
    rng.shuffle(rows)
    got = chunking.content_defined_pieces(spark.createDataFrame(rows, "stream string, start_offset long, data binary"), c)
    want = chunking.content_defined(spark.createDataFrame(list(streams.items()), "stream string, data binary"), c)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hole_in_a_stream(spark):
    rows = [("s", 0, b"a" * 100), ("s", 101, b"a" * 100)]
    with pytest.raises(Exception, match="missing or there twice"):
        chunking.content_defined_pieces(spark.createDataFrame(rows, "stream string, start_offset long, data binary"), chunking.Config(64)).collect()


@pytest.mark.parametrize("split", [False, True])
def test_chunked_archives(spark, table, split):
    b = backup.archived(table.filter("k IS NOT NULL"), "k", chunking.Config(4096), split)
    seen = {(r.k, r.path): r.content for r in backup.opened(b.index, b.new_chunks, "k", split=split).collect()}
    want = {(e["k"], e["path"]): e.get("content") for e in entries() if e["k"]}
    assert {k: v and bytes(v) for k, v in seen.items()} == want
    assert {r.stream for r in b.index.collect()} == {k + s for k in "ab" for s in ((backup.META, backup.PAYLOAD) if split else (backup.WHOLE,))}
    assert index.pieces(b.index, b.new_chunks).agg(F.sum(F.octet_length("data")).alias("n")).first().n == sum(len(x or b"") for k in "ab" for x in whole(split)[k])


def test_an_acl_attribute_is_made_once(spark):
    """Each entry of an attribute made the whole attribute again."""
    made = lambda c: F.unbase64(F.base64(c))
    df = spark.createDataFrame([(b"\2\0\0\0", None)], "a binary, d binary").select(S.posix_acl(made("a"), made("d")).alias("acl"))
    assert df._jdf.queryExecution().optimizedPlan().expressions().mkString().lower().count("unbase64(") <= 2
    assert df._jdf.queryExecution().analyzed().expressions().mkString().lower().count("unbase64(") == 2


def _sizes(spark, df):
    """Rows and bytes of the largest Arrow batch that Python now gets of (data)."""

    def run(of):
        for b in of:
            yield pa.RecordBatch.from_pylist([{"n": b.num_rows, "size": b.nbytes}])

    return df.mapInArrow(run, "n long, size long").agg(F.max("n").alias("n"), F.max("size").alias("size")).first()


@pytest.mark.parametrize("of", ["cdc_roundtrip", "incremental_backup", "blob_roundtrip"])
def test_python_gets_few_blobs_at_a_time(spark, sf, of):
    """With Spark's own setting a worker held 10,000 texts, whatever their length, several times."""
    for key, value in (("maxRecordsPerBatch", "10000"), ("maxBytesPerBatch", str(64 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    Q.QUERIES[of](spark, sf)
    most = list(batches.MOST.values())
    got = _sizes(spark, spark.range(0, 3000, 1, 1).select(F.expr("CAST(repeat('x', 20000) AS binary)").alias("data")))
    assert got.n <= most[0] and got.size <= most[1] + 100_000
    assert _sizes(spark, spark.range(0, 3000, 1, 1).select(F.lit(b"x").alias("data"))).n <= most[0]


def test_zstd_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(0, None), (1, b""), (2, b"a" * 5000)], "k int, d binary")
    got = df.select("k", codecs.zstd_decompress(codecs.zstd_compress("d")).alias("d")).orderBy("k").collect()
    assert [r.d and bytes(r.d) for r in got[:1]] + [bytes(r.d) for r in got[1:]] == [None, b"", b"a" * 5000]
