"""The engine's operators on the test tables, each with the SQL that says the same.

documents are the files of a snapshot (/source/lang/doc_id.txt), pages give directory trees, conversations are streams
of blocks, orders two snapshots, events a timeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.functions import codecs
from vaultframe.functions import scalars as S
from vaultframe.operators import catalog, chunking, dedup, diff, goodbye, index, manifest, snapshots, transfer
from vaultframe.plans import backup
from vaultframe.sources import archive, browse, indexes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CHUNK = 256
PAYLOAD_CHUNK = 65536


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bytes():
    return F.col("text").cast("binary")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")




def _files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _t(spark, d, "documents").select("doc_id", path.alias("path"), F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size"), "text")


_FILES = "SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, '/' || source || '/' || lang AS dir, source, lang, strlen(text)::BIGINT AS size, text FROM documents"
_DIRS = "SELECT '/' AS path UNION SELECT '/' || source FROM documents UNION SELECT '/' || source || '/' || lang FROM documents"


@query(f"SELECT path, 'file' AS kind, size AS file_size, dir AS parent_path FROM ({_FILES})")
def catalog_flat(spark, d):
    return catalog.flat(_files(spark, d))


@query(f"SELECT path, 'directory' AS kind, 0::BIGINT AS size FROM ({_DIRS}) WHERE path = '/src1' OR path LIKE '/src1/%'")
def walk_filter_kind(spark, d):
    return catalog.walk(catalog.with_directories(_files(spark, d)), "/src1", ("directory",))


@query(f"SELECT path, size FROM ({_FILES}) ORDER BY source, lang, doc_id || '.txt' OFFSET 100")
def walk_skip_count(spark, d):
    return catalog.skip(_files(spark, d).select("path", "size"), 100)


@query(f"""
    WITH e AS (
        SELECT doc_id || '.txt' AS name, 'file' AS kind, 0 AS last FROM ({_FILES}) WHERE dir = '/src1/en'
        UNION ALL SELECT '.', 'directory', 1 UNION ALL SELECT '..', 'directory', 2
    ) SELECT row_number() OVER (ORDER BY last, name) AS position, name, kind FROM e QUALIFY position > 10 AND position <= 40""")
def readdir_page(spark, d):
    return catalog.page(_files(spark, d).select("path", "kind"), "/src1/en", 10, 30)


_PAGE = "regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '')"
_PAGES = f"SELECT page_id, rtrim(regexp_replace({_PAGE}, '//+', '/', 'g'), '/') AS path, strlen(html)::BIGINT AS size FROM pages"


def _pages(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), r"[?#].*$", "")
    return _t(spark, d, "pages").select("page_id", F.rtrim(F.regexp_replace(path, "//+", "/"), F.lit("/")).alias("path"), F.lit("file").alias("kind"), F.octet_length("html").cast("long").alias("size"))


@query(f"SELECT page_id, split_part(path, '/', -1) AS name FROM ({_PAGES}) WHERE len(string_split(path, '/')) = 4")
def list_level(spark, d):
    return _pages(spark, d).filter(S.depth_of("path") == 3).select("page_id", S.base_name("path").alias("name"))


@query(f"SELECT dir AS path, size, doc_id FROM ({_FILES}) WHERE dir = '/src2/en'")
def list_directory(spark, d):
    return catalog.listing(_files(spark, d), "/src2/en").select(S.parent_of("path").alias("path"), "size", "doc_id")


@query(f"SELECT dir AS parent, count(*) AS n, sha256(string_agg(doc_id || '.txt', '/' ORDER BY doc_id || '.txt')) AS names FROM ({_FILES}) GROUP BY dir")
def children_per_dir(spark, d):
    got = catalog.children(_files(spark, d).select("path", "kind", "size"))
    return got.select("parent", "n", F.sha2(F.array_join(F.col("entries.name"), "/").cast("binary"), 256).alias("names"))


@query(f"SELECT count(*) AS directories FROM ({_DIRS})")
def dir_count(spark, d):
    return catalog.with_directories(_files(spark, d)).filter(F.col("kind") == "directory").agg(F.count("*").alias("directories"))


_ABOVE = f"""SELECT page_id, size, path, unnest(list_transform(range(1, greatest(len(string_split(path, '/')), 2)), lambda n: CASE WHEN n = 1 THEN '/' ELSE array_to_string(string_split(path, '/')[1:n], '/') END)) AS above FROM ({_PAGES})"""


@query(f"SELECT above AS path, count(*) AS files, sum(size)::BIGINT AS bytes FROM ({_ABOVE}) GROUP BY above")
def subtree_sizes(spark, d):
    return catalog.subtree_sizes(_pages(spark, d))


@query(f"SELECT DISTINCT above AS path, CASE WHEN above = '/' THEN 0 ELSE len(string_split(above, '/')) - 1 END::INTEGER AS depth FROM ({_ABOVE})")
def tree_ancestors(spark, d):
    return _pages(spark, d).select(F.explode(S.ancestors("path")).alias("path")).distinct().select("path", S.depth_of("path").alias("depth"))


@query("""
    WITH RECURSIVE t AS (
        SELECT r_regionkey AS id, r_name AS path, 0 AS depth FROM region
        UNION ALL SELECT 100 + n_nationkey, t.path || '/' || n_name, t.depth + 1 FROM nation JOIN t ON n_regionkey = t.id AND t.depth = 0
    ) SELECT id::BIGINT AS id, path, depth FROM t""")
def tree_walk(spark, d):
    regions = _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    nations = _t(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    return catalog.tree(regions.union(nations))


_ASKED = f"SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN '/none/' || doc_id ELSE path END AS path FROM ({_FILES})"


@query(f"SELECT a.pos, a.path, f.size FROM ({_ASKED}) a LEFT JOIN ({_FILES}) f ON a.path = f.path")
def lookup_batch(spark, d):
    files = _files(spark, d)
    asked = files.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/none/"), F.col("doc_id").cast("string"))).otherwise(F.col("path")).alias("path"))
    return catalog.look_up(files.select("path", "size"), asked).select("pos", "path", "size")


@query(f"SELECT doc_id AS pos, path, size FROM ({_FILES})")
def lookup_found(spark, d):
    files = _files(spark, d)
    return catalog.found(files.select("path", "size"), files.select(F.col("doc_id").alias("pos"), "path")).select("pos", "path", "size")


@query(f"SELECT a.dir AS parent, a.doc_id || CASE WHEN a.doc_id % 4 = 0 THEN '.no' ELSE '.txt' END AS name, CASE WHEN a.doc_id % 4 <> 0 THEN a.size END AS size FROM ({_FILES}) a")
def child_lookup(spark, d):
    files = _files(spark, d)
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, F.lit(".no")).otherwise(F.lit(".txt")))
    return catalog.children_named(files.select("path", "size"), files.select(S.parent_of("path").alias("parent"), name.alias("name"))).select("parent", "name", "size")


@query(f"SELECT path, size FROM ({_FILES}) WHERE source NOT IN ('src1', 'src3') AND dir <> '/src2/en'")
def skip_subtree(spark, d):
    pruned = spark.createDataFrame([("/src1",), ("/src3",), ("/src2/en",)], "path string")
    return catalog.walk(_files(spark, d).select("path", "size"), pruned=pruned)


def _streams(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stream"), _bytes().alias("data"))


_FIXED = f"""
    SELECT doc_id::VARCHAR AS stream, i AS pos, i * {CHUNK} AS start_offset, least((i + 1) * {CHUNK}, n) AS end_offset,
        sha256(unhex(substr(h, 2 * i * {CHUNK} + 1, 2 * {CHUNK}))) AS digest
    FROM (SELECT doc_id, strlen(text)::BIGINT AS n, hex(encode(text)) AS h, unnest(range(0, (strlen(text)::BIGINT + {CHUNK} - 1) // {CHUNK})) AS i FROM documents)"""


@query(_FIXED)
def fixed_chunk_index(spark, d):
    return chunking.fixed(_streams(spark, d), CHUNK).select("stream", "pos", "start_offset", "end_offset", "digest")


_BLOCKS = "SELECT conv_id::VARCHAR AS stream, turn AS pos, strlen(text)::BIGINT AS size, text, sha256(text) AS digest FROM conversations"
_INDEX = f"SELECT *, coalesce(end_offset - size, 0) AS start_offset FROM (SELECT *, sum(size) OVER (PARTITION BY stream ORDER BY pos)::BIGINT AS end_offset FROM ({_BLOCKS}))"


def _blocks(spark, d):
    return _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("pos"), F.octet_length("text").cast("long").alias("size"), F.sha2(_bytes(), 256).alias("digest"), _bytes().alias("blob"))


def _index(spark, d):
    return index.with_ends(_blocks(spark, d)).select("stream", "pos", "end_offset", "digest")


@query(f"SELECT stream, pos, start_offset, end_offset, digest FROM ({_INDEX})")
def dynamic_index_offsets(spark, d):
    return index.with_starts(_index(spark, d)).select("stream", "pos", "start_offset", "end_offset", "digest")


@query(f"""
    WITH i AS ({_INDEX}), p AS (SELECT stream, unnest([0, 97, 512, 4096, 1000000])::BIGINT AS "offset" FROM (SELECT DISTINCT stream FROM i))
    SELECT p.stream, p."offset", i.pos, i.digest FROM p LEFT JOIN i ON p.stream = i.stream AND i.start_offset <= p."offset" AND p."offset" < i.end_offset""")
def chunk_from_offset(spark, d):
    idx = _index(spark, d)
    points = idx.select("stream").distinct().withColumn("offset", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 97, 512, 4096, 1_000_000)])))
    return index.chunk_of(points, idx, 1024).select("stream", "offset", "pos", "digest")


_PLACED = f"SELECT *, (sum(size + 16) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT - size AS payload_offset FROM ({_FILES})"


@query(f"SELECT source AS stream, doc_id AS pos, size, payload_offset FROM ({_PLACED})")
def payload_offsets(spark, d):
    return _placed(spark, d)


def _placed(spark, d):
    return index.payload_places(_t(spark, d, "documents").select(F.col("source").alias("stream"), F.col("doc_id").alias("pos"), F.octet_length("text").cast("long").alias("size")))


@query(f"""
    WITH f AS ({_PLACED}), s AS (SELECT source, max(payload_offset + 16 + size) AS total FROM f GROUP BY source),
    c AS (SELECT source, i AS chunk_index, i * {PAYLOAD_CHUNK} AS a, least((i + 1) * {PAYLOAD_CHUNK}, total) AS b FROM (SELECT source, total, unnest(range(0, (total + {PAYLOAD_CHUNK} - 1) // {PAYLOAD_CHUNK})) AS i FROM s))
    SELECT f.source AS stream, f.doc_id AS pos, c.chunk_index, greatest(f.payload_offset + 16, a) AS content_start, least(f.payload_offset + 16 + f.size, b) AS content_end,
        f.payload_offset + 16 <= a AND f.payload_offset + 16 + f.size >= b AS is_full_chunk
    FROM f JOIN c ON f.source = c.source AND f.payload_offset + 16 < b AND f.payload_offset + 16 + f.size > a WHERE f.size > 0""")
def file_to_chunks(spark, d):
    files = _placed(spark, d)
    streams = files.groupBy("stream").agg(F.max(F.col("payload_offset") + 16 + F.col("size")).alias("total"))
    got = index.file_ranges(files, index.fixed_bounds(streams, PAYLOAD_CHUNK), PAYLOAD_CHUNK)
    return got.select("stream", "pos", "chunk_index", "content_start", "content_end", "is_full_chunk")


@query("SELECT conv_id::VARCHAR AS stream, sha256(string_agg(text, '' ORDER BY turn)) AS digest, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY conv_id")
def restore_stream(spark, d):
    got = index.restored(_index(spark, d), _blocks(spark, d).select("digest", "size", "blob").dropDuplicates(["digest"]))
    return got.select("stream", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("bytes"))


@query("""
    SELECT conv_id::VARCHAR AS stream, substr(string_agg(hex(encode(text)), '' ORDER BY turn), 2 * 5 + 1, 2 * 200) AS data
    FROM conversations GROUP BY conv_id HAVING sum(strlen(text)) > 5""")
def restore_range(spark, d):
    idx = _index(spark, d)
    wanted = idx.groupBy("stream").agg(F.max("end_offset").alias("n")).filter("n > 5").select("stream", F.lit(5).cast("long").alias("offset"), F.lit(200).cast("long").alias("length"))
    got = index.restored_ranges(wanted, idx, _blocks(spark, d).select("digest", "size", "blob").dropDuplicates(["digest"]))
    return got.select("stream", F.hex("data").alias("data"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(_bytes(), 256).alias("digest"))


_MARKED = f"SELECT *, row_number() OVER (PARTITION BY digest ORDER BY stream::BIGINT, pos) > 1 AS \"exists\" FROM ({_FIXED})"


def _marked(spark, d):
    chunks = chunking.fixed(_streams(spark, d), CHUNK).drop("blob").withColumn("doc_id", F.col("stream").cast("long"))
    return dedup.marked(chunks, order=("doc_id", "pos"))


@query(f'SELECT stream, pos, digest, "exists" FROM ({_MARKED})')
def dedup_first_occurrence(spark, d):
    return _marked(spark, d).select("stream", "pos", "digest", "exists")


@query(f'SELECT count(*) FILTER ("exists") AS hits, count(*) AS total, sum(end_offset - start_offset)::BIGINT AS bytes, sum(end_offset - start_offset) FILTER (NOT "exists")::BIGINT AS new_bytes FROM ({_MARKED})')
def dedup_stats(spark, d):
    return dedup.statistics(_marked(spark, d))


def _halves(spark, d):
    c = chunking.fixed(_streams(spark, d), CHUNK).select("stream", "digest")
    return c.filter(F.col("stream").cast("long") % 2 == 0), c.filter(F.col("stream").cast("long") % 2 == 1)


@query(f"SELECT digest FROM ({_FIXED}) WHERE stream::BIGINT % 2 = 0 INTERSECT SELECT digest FROM ({_FIXED}) WHERE stream::BIGINT % 2 = 1")
def chunks_shared(spark, d):
    return dedup.shared(*_halves(spark, d))


@query(f"SELECT DISTINCT digest FROM ({_FIXED}) WHERE stream::BIGINT % 2 = 1 EXCEPT SELECT digest FROM ({_FIXED}) WHERE stream::BIGINT % 2 = 0")
def chunks_new(spark, d):
    even, odd = _halves(spark, d)
    return dedup.new(odd, even)


@query(f"SELECT DISTINCT digest FROM ({_FIXED})")
def chunks_all(spark, d):
    return dedup.all_digests(*_halves(spark, d))


@query("SELECT sha256(text) AS digest, strlen(text)::BIGINT AS size FROM benchmark WHERE text NOT IN (SELECT text FROM documents) GROUP BY text")
def dedup_insert(spark, d):
    whole = lambda name: _t(spark, d, name).select(F.sha2(_bytes(), 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return dedup.to_insert(whole("benchmark"), whole("documents"))


@query(f"SELECT stream, count(*) AS chunks, max(end_offset) AS bytes FROM ({_INDEX}) GROUP BY stream")
def index_totals(spark, d):
    return index.totals(_index(spark, d))


@query(f"""
    SELECT stream, sha256(unhex(string_agg(array_to_string(list_transform(range(8), lambda i: printf('%02x', (end_offset >> (8 * i)) & 255)), '') || digest, '' ORDER BY pos))) AS csum
    FROM ({_INDEX}) GROUP BY stream""")
def index_checksum(spark, d):
    return index.checksum(_index(spark, d))


_A = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0"
_B = "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0"


@query(f"""
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
        WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice THEN 'unchanged' ELSE 'changed' END AS status
    FROM ({_A}) a FULL JOIN ({_B}) b ON a.o_orderkey = b.o_orderkey""")
def snapshot_diff(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    b = o.filter(k % 11 != 0).withColumns({"o_orderstatus": F.when(k % 13 == 0, None).otherwise(F.col("o_orderstatus")), "o_totalprice": F.col("o_totalprice") + F.when(k % 7 == 0, 1).otherwise(0)})
    return diff.changes(o.filter(k % 10 != 0), b, "o_orderkey", ("o_orderstatus", "o_totalprice"))


@query(f"""
    WITH m AS (
        SELECT '/backup/a/' || lang || '/' || doc_id || '.txt' AS path, 'file' AS kind, size FROM ({_FILES}) WHERE source = 'src1'
        UNION ALL SELECT '/backup/b/' || doc_id || '.txt', 'file', size FROM ({_FILES}) WHERE dir = '/src2/en'
    ), n AS (SELECT '/' AS path UNION SELECT '/backup' UNION SELECT '/backup/a' UNION SELECT '/backup/b' FROM ({_FILES}) WHERE dir = '/src2/en' UNION SELECT '/backup/a/' || lang FROM documents WHERE source = 'src1')
    SELECT * FROM m UNION ALL SELECT path, 'directory', 0 FROM n""")
def merge_remap(spark, d):
    return transfer.copied(_files(spark, d).select("path", "kind", "size"), [("/src1", "/backup/a"), ("/src2/en", "/backup/b")])


def _manifest_files(spark, d):
    o = _t(spark, d, "orders")
    return o.select(
        F.lower("o_orderstatus").alias("backup_type"), (F.col("o_custkey") % 50).cast("string").alias("backup_id"), F.unix_seconds(F.date_trunc("month", "o_orderdate")).alias("backup_time"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".didx")).alias("filename"),
        F.lit("none").alias("crypt_mode"), F.floor("o_totalprice").cast("long").alias("size"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("csum"),
    )


_MANIFEST = """SELECT lower(o_orderstatus) AS backup_type, (o_custkey % 50)::VARCHAR AS backup_id, epoch(date_trunc('month', o_orderdate))::BIGINT AS backup_time, o_orderkey || '.didx' AS filename,
    'none' AS crypt_mode, floor(o_totalprice)::BIGINT AS size, sha256(o_orderkey::VARCHAR) AS csum FROM orders"""


@query(_MANIFEST)
def manifest_json(spark, d):
    return manifest.parsed(manifest.assembled(_manifest_files(spark, d)))


@query(f"""
    SELECT filename, CASE WHEN k % 35 = 0 THEN 'csum' WHEN k % 55 = 0 THEN 'size' WHEN k % 65 = 0 THEN 'missing' ELSE 'ok' END AS status
    FROM (SELECT o_orderkey AS k, o_orderkey || CASE WHEN o_orderkey % 65 = 0 AND o_orderkey % 35 <> 0 AND o_orderkey % 55 <> 0 THEN '.x' ELSE '.didx' END AS filename FROM orders)""")
def manifest_verify(spark, d):
    files = _manifest_files(spark, d)
    k = F.substring_index("filename", ".", 1).cast("long")
    odd = (k % 65 == 0) & (k % 35 != 0) & (k % 55 != 0)
    actual = files.select(F.when(odd, F.concat(k.cast("string"), F.lit(".x"))).otherwise(F.col("filename")).alias("filename"), F.when(k % 35 == 0, F.lit("0")).otherwise(F.col("csum")).alias("csum"), (F.col("size") + F.when(k % 55 == 0, 1).otherwise(0)).alias("size"))
    return manifest.verified(manifest.parsed(manifest.assembled(files)), actual)


_SNAPS = "SELECT DISTINCT event_type AS type, (user_id % 20)::VARCHAR AS id, epoch(date_trunc('day', ts))::BIGINT AS time FROM events"


def _snaps(spark, d):
    return _t(spark, d, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 20).cast("string").alias("id"), F.unix_seconds(F.date_trunc("day", "ts")).alias("time")).distinct()


@query(f"SELECT type, id, time AS backup_time, type || '/' || id || '/' || strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS path FROM ({_SNAPS})")
def snapshot_list(spark, d):
    paths = _snaps(spark, d).select("type", "id", S.snapshot_path("type", "id", "time").alias("path")).withColumn("dir", F.substring_index("path", "/", -1))
    notes = paths.select("type", "id", "path", F.lit("owner").alias("dir")).distinct()
    return snapshots.listed(paths.union(notes)).select("type", "id", "backup_time", "path")


@query(f"SELECT type, id, time, lag(time) OVER (PARTITION BY type, id ORDER BY time) AS previous FROM ({_SNAPS})")
def previous_snapshot(spark, d):
    return snapshots.with_previous(_snaps(spark, d))


@query(f"SELECT type || '/' || id AS snapshot, count(*) FILTER (time % 7 <> 0) AS files, bool_or(time % 7 = 0) AS protected FROM ({_SNAPS}) GROUP BY ALL")
def snapshot_info(spark, d):
    s = _snaps(spark, d).select(F.concat_ws("/", "type", "id").alias("snapshot"), F.when(F.col("time") % 7 == 0, snapshots.PROTECTED).otherwise(F.concat(F.col("time").cast("string"), F.lit(".didx"))).alias("filename"))
    return snapshots.described(s).select("snapshot", F.size("files").cast("long").alias("files"), "protected")


@query(f"SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) - 1 FROM ({_DIRS})) AS directories, (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes")
def backup_result(spark, d):
    return catalog.result(catalog.with_directories(_files(spark, d)))


@query(f"SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM ({_DIRS})) AS entries, (SELECT sum(strlen(text))::BIGINT // 512 FROM documents) AS blocks")
def file_system_totals(spark, d):
    return catalog.file_system_totals(catalog.with_directories(_files(spark, d)))


_MODES = "[49152, 40960, 32768, 24576, 16384, 8192, 4096]"


@query(f"""
    SELECT p_partkey, mode & 61440 AS type, mode & 4095 AS bits, (mode & 61440) = 16384 AS is_directory, (mode & 61440) IN (8192, 24576) AS is_device,
        CASE mode & 61440 WHEN 49152 THEN 'socket' WHEN 40960 THEN 'symlink' WHEN 32768 THEN 'file' WHEN 24576 THEN 'device' WHEN 16384 THEN 'directory' WHEN 8192 THEN 'device' ELSE 'fifo' END AS kind
    FROM (SELECT p_partkey, ({_MODES}[p_partkey % 7 + 1] + p_partkey % 4096)::BIGINT AS mode FROM part)""")
def mode_predicates(spark, d):
    modes = F.array(*[F.lit(m).cast("long") for m in (49152, 40960, 32768, 24576, 16384, 8192, 4096)])
    p = _t(spark, d, "part").select("p_partkey", (F.element_at(modes, (F.col("p_partkey") % 7 + 1).cast("int")) + F.col("p_partkey") % 4096).alias("mode"))
    return p.select("p_partkey", S.file_type("mode").alias("type"), S.permission_bits("mode").alias("bits"), S.is_type("mode", "directory").alias("is_directory"), S.is_type("mode", "device").alias("is_device"), S.kind_of("mode").alias("kind"))


@query("""
    SELECT p_partkey, ((ma & 4095) << 8) | ((ma & 4294963200) << 32) | (mi & 255) | ((mi & 4294967040) << 12) AS dev, ma AS major, mi AS minor
    FROM (SELECT p_partkey, (p_partkey * 7919 % 65536)::BIGINT AS ma, (p_partkey * 104729 % 1048576)::BIGINT AS mi FROM part)""")
def devt_roundtrip(spark, d):
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 65536).cast("long").alias("ma"), (F.col("p_partkey") * 104729 % 1048576).cast("long").alias("mi"))
    p = p.withColumn("dev", S.device_number("ma", "mi"))
    return p.select("p_partkey", "dev", S.device_major("dev").alias("major"), S.device_minor("dev").alias("minor"))


@query(f"SELECT path, (size + 511) // 512 AS blocks, 1::BIGINT AS nlink FROM ({_FILES})")
def file_attributes(spark, d):
    return _files(spark, d).select("path", *S.attributes("kind", "size"))


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS valid FROM part")
def valid_names(spark, d):
    k = F.col("p_partkey")
    names = F.when(k % 3 != 0, F.col("p_name")).when(k % 9 == 0, F.lit("..")).when(k % 9 == 3, F.lit("")).otherwise(F.concat(F.lit("a/"), "p_name"))
    return _t(spark, d, "part").select("p_partkey", S.valid_component(names).alias("valid"))


@query(f"SELECT link AS path, f.path AS target, f.size, 33188::BIGINT AS mode FROM (SELECT '/links/' || doc_id AS link, * FROM ({_FILES})) f")
def hard_links(spark, d):
    files = _files(spark, d).withColumn("mode", F.lit(33188).cast("long"))
    links = files.select(F.concat(F.lit("/links/"), F.col("doc_id").cast("string")).alias("path"), F.lit("hardlink").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mode"), F.col("path").alias("link_target"))
    return catalog.hard_links(files.select("path", "kind", "size", "mode").unionByName(links, allowMissingColumns=True))


@query(f"SELECT dir, path FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY doc_id) AS k FROM ({_FILES})) WHERE k = 3")
def nth_match(spark, d):
    return catalog.nth(_files(spark, d).select("doc_id", "path", S.parent_of("path").alias("dir")), "dir", 2, "doc_id").select("dir", "path")


@query("SELECT doc_id, strlen(text)::BIGINT + 12 AS size, sha256(text) AS digest FROM documents")
def blob_roundtrip(spark, d):
    b = _t(spark, d, "documents").select("doc_id", codecs.blob_encode(_bytes()).alias("b"), codecs.blob_encode(_bytes(), compress=True).alias("c"))
    return b.select("doc_id", F.octet_length("b").cast("long").alias("size"), F.sha2(F.when(codecs.blob_decode(F.col("b")) == codecs.blob_decode(F.col("c")), codecs.blob_decode(F.col("c"))), 256).alias("digest"))


_KEY = bytes(range(32))


@query("SELECT doc_id, sha256(text) AS digest, true AS encrypted FROM documents")
def aes_gcm_roundtrip(spark, d):
    e = _t(spark, d, "documents").select("doc_id", codecs.blob_encrypt(_bytes(), _KEY, F.unhex(F.lpad(F.hex("doc_id"), 24, "0")), compress=True).alias("b"))
    return e.select("doc_id", F.sha2(codecs.blob_decode(F.col("b"), _KEY), 256).alias("digest"), codecs.is_encrypted(F.col("b")).alias("encrypted"))


@query("SELECT doc_id, sha256(text || 'key') AS digest FROM documents")
def keyed_digest(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.keyed_digest(_bytes(), b"key").alias("digest"))


_CRC_TABLE = "SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))"
_BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)"


@query(f"SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS crc FROM documents, ({_CRC_TABLE})")
def crc32_blob(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.crc32(_bytes()).alias("crc"))


@query()
def goodbye_order(spark, d):
    return goodbye.ranked(_files(spark, d).select(S.parent_of("path").alias("parent"), S.base_name("path").alias("name")))


def _cdc(spark, d):
    return chunking.content_defined(_streams(spark, d), chunking.Config(1024))


def _spanned(source: str, span: int) -> str:
    """SQL of one doubling step of the rolling hash."""
    before = f"coalesce(lag(h, {span}) OVER (PARTITION BY doc_id ORDER BY p), 0)"
    turned = f"(({before} << {span}) & 4294967295) | ({before} >> {32 - span})" if span < 32 else before
    return f"SELECT doc_id, p, xor(h, {turned}) AS h FROM {source}"


def _cut(average: int) -> str:
    c, low = chunking.Config(average), "list_filter(m, lambda x: x >= {})[1]"
    return f"""
    WITH RECURSIVE of_byte AS (SELECT printf('%02X', b) AS x, ('0x' || d[7:8] || d[5:6] || d[3:4] || d[1:2])::BIGINT AS h FROM (SELECT b, sha256(unhex(printf('%02X', b))) AS d FROM range(256) r(b))),
    h1 AS (SELECT doc_id, p, h FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents)) JOIN of_byte USING (x)),
    {", ".join(f"h{2 * n} AS ({_spanned(f'h{n}', n)})" for n in (1, 2, 4, 8, 16, 32))},
    marks AS (SELECT doc_id, list(p ORDER BY p) AS m FROM h64 WHERE h & {c.mask} >= {c.threshold} GROUP BY doc_id),
    walk AS (
        SELECT doc_id, text, strlen(text)::BIGINT AS n, 0::BIGINT AS pos, 0::BIGINT AS s, least(coalesce({low.format(max(c.least, chunking.WINDOW + 1))}, strlen(text)), {c.most}, strlen(text))::BIGINT AS e, m FROM documents LEFT JOIN marks USING (doc_id) WHERE text <> ''
        UNION ALL SELECT doc_id, text, n, pos + 1, e, least(coalesce({low.format(f"e + {c.least}")}, n), e + {c.most}, n)::BIGINT, m FROM walk WHERE e < n)
    SELECT doc_id::VARCHAR AS stream, pos, s AS start_offset, e AS end_offset, e - s AS size, sha256(unhex(substr(hex(encode(text)), 2 * s + 1, 2 * (e - s)))) AS digest FROM walk"""


_CDC = _cut(1024)


@query(_CDC)
def cdc_chunks(spark, d):
    return _cdc(spark, d).drop("blob")


@query(f"SELECT (sum(n) - count(*))::BIGINT AS hits, sum(n)::BIGINT AS total, sum(n * size)::BIGINT AS bytes, sum(size)::BIGINT AS new_bytes FROM (SELECT digest, any_value(size) AS size, count(*) AS n FROM ({_CDC}) GROUP BY digest)")
def cdc_dedup_stats(spark, d):
    return dedup.statistics(dedup.marked(_cdc(spark, d).drop("blob")))


@query("SELECT doc_id::VARCHAR AS stream, sha256(text) AS digest FROM documents WHERE text <> ''")
def cdc_roundtrip(spark, d):
    c = _cdc(spark, d)
    return index.restored(c.select("stream", "pos", "end_offset", "digest"), c.select("digest", "blob").dropDuplicates(["digest"])).select("stream", F.sha2("data", 256).alias("digest"))


def _tree(spark, d):
    f = _t(spark, d, "documents").select("source", F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.lit("file").alias("kind"), F.lit(33188).cast("long").alias("mode"), _bytes().alias("content"))
    dirs = f.select("source", F.explode(S.ancestors("path")).alias("path")).distinct().select("source", "path", F.lit("directory").alias("kind"), F.lit(16877).cast("long").alias("mode"), F.lit(None).cast("binary").alias("content"))
    return f.union(dirs)


_TREE = """
    SELECT source, '/' || lang || '/' || doc_id AS path, 'file' AS kind, strlen(text)::BIGINT AS size, sha256(text) AS digest FROM documents
    UNION ALL SELECT DISTINCT source, '/' || lang, 'directory', 0, NULL FROM documents UNION ALL SELECT DISTINCT source, '/', 'directory', 0, NULL FROM documents"""


def _read_back(spark, d, split):
    made = archive.pieces(_tree(spark, d), "source", split)
    got = archive.entries_of_pieces(made.filter("NOT payload"), "source")
    if split:
        got = archive.with_payloads(got, made.filter("payload"), "source")
    return got.select("source", "path", "kind", "size", F.sha2("content", 256).alias("digest"))


@query(_TREE)
def archive_roundtrip(spark, d):
    return _read_back(spark, d, False)


@query(_TREE)
def archive_split_roundtrip(spark, d):
    return _read_back(spark, d, True)


def _backup(spark, d, split):
    return backup.archived(_tree(spark, d), "source", chunking.Config(4096), split)


def _opened(b, split):
    return backup.opened(b.index, b.new_chunks, "source", split=split)


@query(_TREE)
def chunked_archive(spark, d):
    return _opened(_backup(spark, d, False), False).select("source", "path", "kind", "size", F.sha2("content", 256).alias("digest"))


@query(_TREE)
def chunked_split_archive(spark, d):
    return _opened(_backup(spark, d, True), True).select("source", "path", "kind", "size", F.sha2("content", 256).alias("digest"))


@query(f"SELECT source, path, kind, size FROM ({_TREE})")
def chunked_metadata(spark, d):
    b = _backup(spark, d, True)
    light = b.index.filter(~F.col("stream").endswith(backup.PAYLOAD))
    return backup.opened(light, b.new_chunks.join(light.select("digest"), "digest", "left_semi"), "source", content=False).select("source", "path", "kind", "size")


@query(f"SELECT 0::BIGINT AS new_chunks, (SELECT count(DISTINCT source) * 2 FROM documents) AS streams")
def split_backup_again(spark, d):
    b = _backup(spark, d, True)
    again = backup.archived(_tree(spark, d), "source", chunking.Config(4096), True, b.new_chunks)
    return again.index.select("stream").unionByName(again.new_chunks.select("digest"), allowMissingColumns=True).agg(F.count("digest").alias("new_chunks"), F.count_distinct("stream").alias("streams"))


@query(f"SELECT path AS stream, size AS bytes FROM ({_FILES}) WHERE size > 0")
def incremental_backup(spark, d):
    files = _files(spark, d).select("path", "kind", "size", F.lit(1).cast("long").alias("mtime_secs"), _bytes().alias("content"))
    c, before = chunking.Config(1024), files.withColumn("mtime_secs", F.when(F.pmod(F.xxhash64("path"), F.lit(7)) == 0, 0).otherwise(1).cast("long"))
    first = backup.full(before, c)
    return index.totals(backup.incremental(files, before.drop("content"), first.index, c, first.new_chunks).index).select("stream", "bytes")


@query(f"SELECT stream, pos, end_offset, digest FROM ({_INDEX})")
def dynamic_index_file(spark, d):
    return indexes.dynamic(indexes.dynamic_files(_index(spark, d), 1700000000))


@query(f"SELECT stream, pos, end_offset, digest, {CHUNK}::BIGINT AS chunk_size, max(end_offset) OVER (PARTITION BY stream) AS total_size FROM ({_FIXED})")
def fixed_index_file(spark, d):
    return indexes.fixed(indexes.fixed_files(chunking.fixed(_streams(spark, d), CHUNK), CHUNK, 1700000000))


@query(ORACLE_SQL["index_checksum"].replace("SELECT stream, sha256", "SELECT stream, 1700000000::BIGINT AS created, sha256", 1))
def index_headers(spark, d):
    return indexes.headers(indexes.dynamic_files(_index(spark, d), 1700000000)).select("stream", "created", "csum")


@query(f"SELECT path, size, doc_id - 500 AS mtime FROM ({_FILES})")
def browse_catalog(spark, d):
    files = _files(spark, d).select(F.split("path", "/")[1].alias("source"), "path", "kind", "size", (F.col("doc_id") - 500).alias("mtime"))
    return browse.rows(browse.catalogs(files, "source")).filter("kind = 'file'").select("path", "size", "mtime")


@query(f"SELECT digest, count(*) AS n FROM (SELECT DISTINCT digest FROM ({_FIXED})) WHERE digest IN (SELECT digest FROM ({_FIXED}) WHERE stream::BIGINT % 2 = 0) GROUP BY digest")
def chunks_referenced(spark, d):
    chunks = chunking.fixed(_streams(spark, d), CHUNK).select("stream", "digest")
    return dedup.referenced(chunks.select("digest").distinct(), chunks.filter(F.col("stream").cast("long") % 2 == 0)).groupBy("digest").agg(F.count("*").alias("n"))


_PAD = [bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query(f"SELECT doc_id, sha256(unhex('{_PAD[1]}') || unhex(sha256(unhex('{_PAD[0]}') || encode(text)))) AS mac FROM documents")
def hmac_digest(spark, d):
    return _t(spark, d, "documents").select("doc_id", codecs.hmac_sha256(_bytes(), b"key").alias("mac"))


@query("SELECT p_partkey, regexp_replace(upper(sha256(p_name)), '(..)', '\\1:', 'g')[:95] AS print FROM part")
def colon_digest(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.colon_hex(F.unhex(F.sha2(F.col("p_name").cast("binary"), 256))).alias("print"))


@query("SELECT event_id, (n // 1000000000) - CASE WHEN n < 0 AND n % 1000000000 <> 0 THEN 1 ELSE 0 END AS secs, ((n % 1000000000) + 1000000000) % 1000000000 AS nanos, n FROM (SELECT event_id, (event_id - 100) * 123456789123 AS n FROM events)")
def timestamps(spark, d):
    e = _t(spark, d, "events").select("event_id", ((F.col("event_id") - 100) * 123456789123).alias("n"))
    e = e.select("event_id", *S.from_nanos("n"))
    return e.select("event_id", F.col("mtime_secs").alias("secs"), F.col("mtime_nanos").cast("long").alias("nanos"), S.to_nanos("mtime_secs", "mtime_nanos").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey - 9223372036854775807 - 1 END AS inode FROM part")
def inode_numbers(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.inode("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "directory").otherwise("file")).alias("inode"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND (p_partkey % 5 = 0 OR p_partkey % 7 <> 0) AS same FROM part")
def entry_match(spark, d):
    k = F.col("p_partkey")
    base = _t(spark, d, "part").select("p_partkey", F.when(k % 5 == 0, "symlink").otherwise("file").alias("kind"), k.cast("long").alias("size"), F.lit(33188).alias("mode"), F.lit(None).cast("string").alias("fcaps"))
    other = base.select("p_partkey", F.when(k % 3 == 0, "fifo").otherwise(F.col("kind")).alias("kind"), (F.col("size") + F.when(k % 7 == 0, 1).otherwise(0)).alias("size"), F.when(k % 2 == 0, F.col("mode")).otherwise(0).alias("mode"), "fcaps")
    return base.alias("a").join(other.alias("b"), "p_partkey").select("p_partkey", S.entry_matches("a", "b", ("mode", "fcaps")).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'user.a' ELSE 'user.a,trusted.' || p_partkey END AS names FROM part")
def kept_xattrs(spark, d):
    k = F.col("p_partkey")
    x = lambda name: F.struct(name.cast("binary").alias("name"), F.lit(b"v").alias("value"))
    xattrs = F.array(x(F.lit("user.a")), x(F.when(k % 2 == 0, F.concat(F.lit("security."), k.cast("string"))).otherwise(F.concat(F.lit("trusted."), k.cast("string")))))
    kept = S.without_xattrs(xattrs, "security.")
    return _t(spark, d, "part").select("p_partkey", F.array_join(F.transform(kept, lambda y: y["name"].cast("string")), ",").alias("names"))


@query(f"""
    WITH e AS (SELECT dir, doc_id || '.txt' AS name FROM ({_FILES})), s AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY sha256(name), name) AS r FROM e),
    heap AS (SELECT dir, i, floor(log2(i))::BIGINT AS depth FROM (SELECT dir, unnest(range(1, count(*) + 1)) AS i FROM e GROUP BY dir)),
    visited AS (SELECT dir, i - 1 AS place, row_number() OVER (PARTITION BY dir ORDER BY (2 * (i - (1::BIGINT << depth)) + 1) / (2::BIGINT << depth)::DOUBLE) AS r FROM heap)
    SELECT dir AS parent, name, place FROM s JOIN visited USING (dir, r)""")
def goodbye_layout(spark, d):
    entries = _files(spark, d).select(S.parent_of("path").alias("parent"), S.base_name("path").alias("name"))
    return goodbye.laid_out(entries, F.sha2(F.col("name").cast("binary"), 256))


_SIGNED = f"""
    SELECT backup_type, backup_id, backup_time, '{{"backup-type":"' || backup_type || '","backup-id":"' || backup_id || '","backup-time":' || backup_time || ',"files":['
        || string_agg('{{"filename":"' || filename || '","crypt-mode":"none","size":' || size || ',"csum":"' || csum || '"}}', ',' ORDER BY filename) || ']}}' AS m FROM ({_MANIFEST}) GROUP BY backup_type, backup_id, backup_time"""


@query(f"SELECT backup_type, backup_id, backup_time, regexp_replace(upper(sha256(unhex('{_PAD[1]}') || unhex(sha256(unhex('{_PAD[0]}') || encode(m))))), '(..)', '\\1:', 'g')[:95] AS signature, 'AB:CD' AS print, 'ok' AS status, 'mismatch' AS other FROM ({_SIGNED})")
def manifest_signed(spark, d):
    m = manifest.signed(manifest.assembled(_manifest_files(spark, d)), b"key", "AB:CD")
    return m.select(
        "backup_type", "backup_id", "backup_time", F.get_json_object("manifest", "$.signature").alias("signature"), F.get_json_object("manifest", "$.unprotected.key-fingerprint").alias("print"),
        manifest.signature_status("manifest", b"key").alias("status"), manifest.signature_status("manifest", b"yek").alias("other"),
    )


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_partkey || ':' || p_partkey % 8 END AS users, '7:5' AS groups, (p_partkey % 5)::BIGINT AS group_obj,
        CASE WHEN p_partkey % 2 = 0 THEN 4::BIGINT END AS default_mask, p_partkey % 2 = 1 AND p_partkey < 0 AS empty FROM part""")
def posix_acls(spark, d):
    k = F.col("p_partkey").cast("long")
    entry = lambda tag, may, who: F.concat(F.unhex(F.lit(f"{tag:02x}00")), F.substring(S.le32(may), 1, 2), S.le32(who))
    none, version = F.lit(-1).cast("long"), F.unhex(F.lit("02000000"))
    access = F.concat(version, entry(1, F.lit(7), none), F.when(k % 3 == 0, F.lit(b"")).otherwise(entry(2, k % 8, k)), entry(4, k % 5, none), entry(8, F.lit(5), F.lit(7)), entry(32, F.lit(1), none))
    default = F.when(k % 2 == 0, F.concat(version, entry(1, F.lit(7), none), entry(16, F.lit(4), none)))
    p = _t(spark, d, "part").select("p_partkey", S.posix_acl(access, default).alias("acl"))
    text = lambda field: F.array_join(F.transform(F.col(f"acl.{field}"), lambda x: F.concat_ws(":", x["id"], x["permissions"])), ",").alias(field)
    return p.select("p_partkey", text("users"), text("groups"), "acl.group_obj", F.col("acl.default.mask").alias("default_mask"), S.acl_is_empty("acl").alias("empty"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN 'h' || s_suppkey END AS host, CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 8007 ELSE s_suppkey::INTEGER END END AS port, CASE WHEN s_suppkey % 5 <> 0 THEN 'a:b' END AS datastore FROM supplier")
def repositories(spark, d):
    k = F.col("s_suppkey")
    user = F.when(k % 2 == 0, "u@realm@").otherwise("")
    text = F.concat(user, F.lit("h"), k.cast("string"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(":"), F.when(k % 3 == 0, "x").otherwise(k.cast("string")), F.lit(":a:b"))))
    return _t(spark, d, "supplier").select("s_suppkey", S.repository(text).alias("r")).select("s_suppkey", "r.host", "r.port", "r.datastore")


@query("""
    SELECT p_partkey, coalesce((['vm', 'ct', 'host'])[p_partkey % 4 + 1], 'unknown') AS type, coalesce((['legacy', 'data', 'metadata'])[p_partkey % 4 + 1], 'unknown') AS mode,
        CASE p_partkey % 4 WHEN 1 THEN 'v1' WHEN 2 THEN 'v2' ELSE 'unknown(' || p_partkey % 4 || ')' END AS version, CASE WHEN p_partkey % 4 < 3 THEN (p_partkey % 4)::BIGINT END AS number FROM part""")
def enum_names(spark, d):
    k = F.col("p_partkey") % 4
    named = _t(spark, d, "part").select("p_partkey", S.named(k, S.BACKUP_TYPES).alias("type"), S.named(k, S.DETECTION_MODES).alias("mode"), S.format_version(k).alias("version"))
    return named.withColumn("number", S.numbered(F.nullif("type", F.lit("unknown")), S.BACKUP_TYPES))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS directory FROM part")
def directory_inodes(spark, d):
    number = S.inode("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "directory").otherwise("file"))
    return _t(spark, d, "part").select("p_partkey", S.is_directory_inode(number).alias("directory"))


@query(f"SELECT source, path, kind, path AS at, NULL::VARCHAR AS beside FROM ({_TREE})")
def entry_at_offset(spark, d):
    every = archive.entries_of_pieces(archive.pieces(_tree(spark, d), "source"), "source", content=False).select("source", "path", "kind", "file_offset")
    asked = every.select("source", F.col("path").alias("at"), "file_offset")
    inside = catalog.at_offset(every.select(F.col("source").alias("__s"), F.col("path").alias("beside"), "file_offset"), asked.select(F.col("source").alias("__s"), "at", (F.col("file_offset") + 1).alias("file_offset")), ["__s"])
    return catalog.at_offset(every, asked, ["source"]).join(inside.select(F.col("__s").alias("source"), "at", "beside"), ["source", "at"]).select("source", "path", "kind", "at", "beside")


@query("SELECT p_partkey, 33188 + p_partkey % 8 AS mode, p_partkey AS uid, 0::BIGINT AS gid, 0::BIGINT AS mtime_secs, 0 AS mtime_nanos, 0::BIGINT AS flags, 0 AS names, true AS plain FROM part")
def metadata_builder(spark, d):
    made = S.metadata(F.lit(33188) + F.col("p_partkey") % 8, uid=F.col("p_partkey"))
    return _t(spark, d, "part").select("p_partkey", *made).select("p_partkey", *S.STAT, F.size("xattrs").alias("names"), (F.col("fcaps").isNull() & F.col("quota_project_id").isNull()).alias("plain"))
