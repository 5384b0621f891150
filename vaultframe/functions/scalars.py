"""Column functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultframe.schema import FIRST_KIND, KINDS

# File types of Linux modes.
TYPE_MASK = 0o170000
TYPES = {"socket": 0o140000, "symlink": 0o120000, "file": 0o100000, "block": 0o060000, "directory": 0o040000, "char": 0o020000, "fifo": 0o010000}

# Tags of the entries of an ACL in Linux.
ACL_TAGS = {"user_obj": 1, "user": 2, "group_obj": 4, "group": 8, "mask": 16, "other": 32}
# Names of numbers.
BACKUP_TYPES = {0: "vm", 1: "ct", 2: "host"}
DETECTION_MODES = {0: "legacy", 1: "data", 2: "metadata"}
DEFAULT_PORT = 8007


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_type(mode: Column | str) -> Column:
    return _c(mode).bitwiseAND(F.lit(TYPE_MASK).cast("long"))


def permission_bits(mode: Column | str) -> Column:
    return _c(mode).bitwiseAND(F.lit(~TYPE_MASK).cast("long"))


def is_type(mode: Column | str, kind: str) -> Column:
    """Whether a mode is of a kind; device means char or block."""
    return file_type(mode).isin(TYPES["char"], TYPES["block"]) if kind == "device" else file_type(mode) == TYPES[kind]


def kind_of(mode: Column | str) -> Column:
    out = F.when(is_type(mode, "device"), "device")
    for k in ("file", "directory", "symlink", "fifo", "socket"):
        out = out.when(is_type(mode, k), k)
    return out


def kind_number(kind: Column | str) -> Column:
    out = F.lit(None).cast("int")
    for n, k in reversed(list(enumerate(KINDS, FIRST_KIND))):
        out = F.when(_c(kind) == k, n).otherwise(out)
    return out


def in_mask(kind: Column | str, mask: int) -> Column:
    """Whether the bit of a kind's number is set."""
    return _c(kind).isin(*[k for n, k in enumerate(KINDS, FIRST_KIND) if mask >> n & 1])


def device_number(major: Column | str, minor: Column | str) -> Column:
    a, b = _c(major), _c(minor)
    part = lambda c, mask, by: F.shiftleft(c.bitwiseAND(F.lit(mask).cast("long")), by)
    return part(a, 0xFFF, 8).bitwiseOR(part(a, 0xFFFFF000, 32)).bitwiseOR(part(b, 0xFF, 0)).bitwiseOR(part(b, 0xFFFFFF00, 12))


def device_major(dev: Column | str) -> Column:
    d = _c(dev)
    return F.shiftrightunsigned(d, 8).bitwiseAND(F.lit(0xFFF).cast("long")).bitwiseOR(F.shiftrightunsigned(d, 32).bitwiseAND(F.lit(0xFFFFF000).cast("long")))


def device_minor(dev: Column | str) -> Column:
    d = _c(dev)
    return d.bitwiseAND(F.lit(0xFF).cast("long")).bitwiseOR(F.shiftrightunsigned(d, 12).bitwiseAND(F.lit(0xFFFFFF00).cast("long")))


def valid_component(name: Column | str) -> Column:
    n = _c(name)
    return n.isNotNull() & (n != "") & ~n.contains("/") & ~n.isin(".", "..")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent_of(path: Column | str) -> Column:
    """The directory above; that of the root is null."""
    p = _c(path)
    return F.when(p == "/", None).otherwise(F.coalesce(F.nullif(F.regexp_replace(p, r"/[^/]*$", ""), F.lit("")), F.lit("/")))


def components_of(path: Column | str) -> Column:
    return F.filter(F.split(_c(path), "/"), lambda x: x != "")


def ancestors(path: Column | str) -> Column:
    """All directories above a path, the root first."""
    parts = components_of(path)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def depth_of(path: Column | str) -> Column:
    return F.size(components_of(path))


def below(path: Column | str, root: str) -> Column:
    """Whether a path is a root or in its subtree."""
    p = _c(path)
    return F.lit(True) if root == "/" else (p == root) | p.startswith(f"{root}/")


def rewritten(path: Column | str, src: str, dst: str) -> Column:
    """A path below src moved below dst."""
    rest = F.substring(_c(path), len("" if src == "/" else src) + 1, 1 << 30)
    out = F.concat(F.lit("" if dst == "/" else dst), rest)
    return F.when(out.isin("", "/"), "/").otherwise(F.regexp_replace(out, r"(?<=.)/$", ""))


def sha256(data: Column | str) -> Column:
    return F.sha2(_c(data), 256)


def keyed_digest(data: Column | str, key: bytes) -> Column:
    return F.sha2(F.concat(_c(data), F.lit(key)), 256)


def _little(value: Column | str, size: int) -> Column:
    padded = F.lpad(F.hex(_c(value).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(padded, 15 - 2 * k, 2) for k in range(size)]))


def le64(value: Column | str) -> Column:
    return _little(value, 8)


def le32(value: Column | str) -> Column:
    return _little(value, 4)


def from_le(data: Column | str, start: int, size: int) -> Column:
    """An unsigned little-endian number at a place (from 0) of a binary."""
    at = [F.hex(F.substring(_c(data), start + 1 + k, 1)) for k in reversed(range(size))]
    return F.conv(F.concat(*at), 16, 10).cast("decimal(20,0)").cast("long")


def colon_hex(data: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.hex(_c(data))), r"(..)(?!$)", "$1:")


def fingerprint(id_key: bytes, salt: bytes) -> Column:
    """Of a key: its digest after a fixed input, in colon hex."""
    return colon_hex(F.unhex(F.sha2(F.lit(salt + id_key), 256)))


def snapshot_path(kind: Column | str, name: Column | str, seconds: Column | str) -> Column:
    return F.concat_ws("/", _c(kind), _c(name), F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def inode(file_offset: Column | str, kind: Column | str) -> Column:
    """Directories have their offset, others also the top bit."""
    off = _c(file_offset).cast("long")
    return F.when(_c(kind) == "directory", off).otherwise(off.bitwiseOR(F.lit(-(1 << 63))))


def is_directory_inode(number: Column | str) -> Column:
    """Whether an inode number is a directory's: the top bit is clear."""
    return _c(number) >= 0


def attributes(entry_kind: Column | str, size: Column | str) -> list[Column]:
    """What a file system reports beside the stat: 512-byte blocks and links."""
    return [F.floor((_c(size) + 511) / 512).cast("long").alias("blocks"), F.when(_c(entry_kind) == "directory", 2).otherwise(1).cast("long").alias("nlink")]


def from_nanos(nanos: Column | str) -> list[Column]:
    n = _c(nanos)
    return [F.floor(n / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long").alias("mtime_secs"), F.pmod(n, F.lit(1_000_000_000)).cast("int").alias("mtime_nanos")]


def to_nanos(secs: Column | str, nanos: Column | str) -> Column:
    return _c(secs) * 1_000_000_000 + _c(nanos)


def without_xattrs(xattrs: Column | str, prefix: str) -> Column:
    return F.filter(_c(xattrs), lambda x: ~x["name"].cast("string").startswith(prefix))


def posix_acl(access: Column | str, default: Column | str) -> Column:
    """An entry's ACL from the extended attributes in which Linux keeps its access ACL and its default one.

    Either may be null. Each holds a version (2) and entries of tag, permissions (16 bits each) and id (32 bits). An
    attribute shorter than its version, or of another version, fails.
    """
    def entries(data: Column) -> Column:
        n = F.floor((F.octet_length(data) - 4) / 8).cast("int")
        fail = lambda why: F.raise_error(F.lit(why)).cast("array<struct<tag: bigint, permissions: bigint, id: bigint>>")
        number = lambda h, at, size: F.conv(F.concat(*[F.substring(h, 1 + 2 * (at + b), 2) for b in reversed(range(size))]), 16, 10).cast("long")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.hex(F.substring(data, 5 + 8 * k, F.lit(8))))
        first = F.transform(pieces, lambda h: F.struct(number(h, 0, 4).alias("t"), number(h, 4, 4).alias("id")))
        each = F.transform(first, lambda x: F.struct(x["t"].bitwiseAND(F.lit(0xFFFF)).alias("tag"), F.shiftright(x["t"], 16).alias("permissions"), x["id"]))
        return F.when(F.octet_length(data) < 4, fail("ACL too short")).when(from_le(data, 0, 4) != 2, fail("unknown version of an ACL")).when(n > 0, each)

    # An attribute is bound once: each place below, and each of its entries, would make it again.
    bound = lambda data: F.get(F.transform(F.array(data.cast("binary")), entries), F.lit(0))

    def of(found: Column, tag: str) -> Column:
        own = F.filter(found, lambda e: e["tag"] == ACL_TAGS[tag])
        return F.coalesce(F.transform(own, lambda e: F.struct(e["id"].alias("id"), e["permissions"].alias("permissions"))), F.array().cast("array<struct<id: bigint, permissions: bigint>>"))

    one = lambda found, tag: F.get(F.filter(found, lambda e: e["tag"] == ACL_TAGS[tag])["permissions"], F.lit(0)).alias(tag)

    def both(x: Column) -> Column:
        a, d = x["a"], x["d"]
        defaults = F.when(d.isNotNull(), F.struct(*[one(d, k) for k in ("user_obj", "group_obj", "other", "mask")]))
        return F.struct(of(a, "user").alias("users"), of(a, "group").alias("groups"), one(a, "group_obj"), defaults.alias("default"), of(d, "user").alias("default_users"), of(d, "group").alias("default_groups"))

    parsed = F.array(F.struct(bound(_c(access)).alias("a"), bound(_c(default)).alias("d")))  # bound once: the fields below would each parse again
    return F.get(F.transform(parsed, both), F.lit(0))


def repository(text: Column | str) -> Column:
    """host, port and datastore of user@host:port:datastore (the user may be left out); null without both colons. A port that does not begin with a digit is the default one."""
    parts = F.split(_c(text), ":", 3)
    port = F.nullif(F.regexp_extract(parts[1], r"^\s*([+-]?[0-9]+)", 1), F.lit(""))
    return F.when(F.size(parts) == 3, F.struct(F.substring_index(parts[0], "@", -1).alias("host"), F.coalesce(port.cast("int"), F.lit(DEFAULT_PORT)).alias("port"), parts[2].alias("datastore")))


def named(number: Column | str, names: dict[int, str], otherwise: str | None = "unknown") -> Column:
    """The name of a number, such as one of DETECTION_MODES."""
    n = _c(number)
    out = F.lit(otherwise)
    for value, name in names.items():
        out = F.when(n == value, name).otherwise(out)
    return out


def numbered(name: Column | str, names: dict[int, str]) -> Column:
    """The number of a name; a name that is not known fails, null stays null."""
    n = _c(name)
    out = F.when(n.isNotNull(), F.raise_error(F.concat(F.lit("unknown name: "), n))).cast("long")
    for value, known in names.items():
        out = F.when(n == known, F.lit(value).cast("long")).otherwise(out)
    return out


def format_version(number: Column | str) -> Column:
    return F.coalesce(named(number, {1: "v1", 2: "v2"}, None), F.concat(F.lit("unknown("), _c(number).cast("string"), F.lit(")")))


def metadata(mode: Column | str, **given: Column) -> list[Column]:
    """The metadata columns of an entry: those given, and for the others what an entry without them has."""
    if wrong := set(given) - set(METADATA):
        raise ValueError(f"not metadata: {sorted(wrong)}")
    kinds = {"xattrs": "array<struct<name: binary, value: binary>>", "acl": "struct<>", "fcaps": "binary", "quota_project_id": "bigint", "mtime_nanos": "int"}
    unset = {k: F.lit(0) if k in STAT else F.lit(None) for k in METADATA if k not in ("acl", "xattrs")} | {"xattrs": F.array()}
    own = unset | given | {"mode": _c(mode)}
    return [(own[k] if k == "acl" else own[k].cast(kinds.get(k, "bigint"))).alias(k) for k in METADATA if k in own]


def acl_is_empty(acl: Column | str) -> Column:
    a = _c(acl)
    none = lambda f: F.coalesce(F.size(a[f]), F.lit(0)) <= 0
    return a.isNull() | (none("users") & none("groups") & a["group_obj"].isNull() & a["default"].isNull() & none("default_users") & none("default_groups"))


STAT = ("mode", "flags", "uid", "gid", "mtime_secs", "mtime_nanos")
METADATA = (*STAT, "xattrs", "acl", "fcaps", "quota_project_id")


def equal(a: str, b: str, columns: tuple[str, ...]) -> Column:
    """Null-safe equality of the columns of two aliases; lists count by position."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def entry_matches(a: str, b: str, columns: tuple[str, ...] = METADATA) -> Column:
    """Same kind, same metadata, and for files the same size."""
    kind = F.col(f"{a}.kind").eqNullSafe(F.col(f"{b}.kind"))
    return kind & ((F.col(f"{a}.kind") != "file") | F.col(f"{a}.size").eqNullSafe(F.col(f"{b}.size"))) & equal(a, b, columns)
