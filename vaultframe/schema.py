"""Schemas of the engine's tables."""

from pyspark.sql import types as T

_ACL_ENTRY = "array<struct<id: bigint, permissions: bigint>>"
#: Rows of an archive. Lists are arrays, not maps, as their order counts in comparisons.
ENTRIES = (
    "path string, parent string, name string, kind string, size bigint, file_offset bigint, payload_offset bigint, content_offset bigint, "
    "mode bigint, flags bigint, uid bigint, gid bigint, mtime_secs bigint, mtime_nanos int, xattrs array<struct<name: binary, value: binary>>, "
    f"acl struct<users: {_ACL_ENTRY}, groups: {_ACL_ENTRY}, group_obj: bigint, `default`: struct<user_obj: bigint, group_obj: bigint, other: bigint, mask: bigint>, default_users: {_ACL_ENTRY}, default_groups: {_ACL_ENTRY}>, "
    "fcaps binary, quota_project_id bigint, link_target string, link_offset bigint, dev_major bigint, dev_minor bigint, content binary"
)
CHUNKS = "digest string, size bigint, blob binary"
INDEX = "stream string, pos bigint, end_offset bigint, digest string"
CATALOG = "path string, kind string, file_size bigint, parent_path string"
BROWSE = "path string, parent string, name string, kind string, size bigint, mtime bigint, depth int"
MANIFEST = T.StructType(
    [
        T.StructField("backup-type", T.StringType()),
        T.StructField("backup-id", T.StringType()),
        T.StructField("backup-time", T.LongType()),
        T.StructField("files", T.ArrayType(T.StructType([T.StructField("filename", T.StringType()), T.StructField("crypt-mode", T.StringType()), T.StructField("size", T.LongType()), T.StructField("csum", T.StringType())]))),
        T.StructField("crypt-mode", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("unprotected", T.StringType()),
    ]
)
#: Kinds of entries in the order of their numbers.
KINDS = ("symlink", "hardlink", "device", "socket", "fifo", "file", "directory")
FIRST_KIND = 2
