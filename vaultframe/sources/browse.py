"""Browse catalogs: a tree of directory blocks, later ones pointing back to earlier ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vaultframe.schema import BROWSE

# Fixed values of the format.
MAGIC = bytes((145, 253, 96, 249, 196, 103, 88, 213))
LETTERS = {"directory": "d", "file": "f", "symlink": "l", "hardlink": "h", "block": "b", "char": "c", "fifo": "p", "socket": "s"}
_KINDS = {v: k for k, v in LETTERS.items()}


def number(v: int) -> bytes:
    """Seven bits a byte, low ones first; a set top bit says that more follow. Negative numbers set it in every byte and end with a zero."""
    n, out = abs(v), bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | 128 if n or v < 0 else low)
        if not n:
            return bytes(out) + b"\0" * (v < 0)


def parse_number(data: bytes, at: int, signed: bool = False) -> tuple[int, int]:
    """(value, place after it)."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 70:
            raise ValueError("broken number")
        b = data[at]
        at += 1
        if signed and b == 0 and shift:
            return -value, at
        value |= (b & 127) << shift
        shift += 7
        if not b & 128:
            return value, at


def parse(data: bytes) -> Iterator[dict]:
    """Rows of a catalog, each directory before what it holds."""
    if data[:8] != MAGIC or len(data) < 16:
        raise ValueError("not a browse catalog")
    todo = [(int.from_bytes(data[-8:], "little"), "", 0)]
    yield {"path": "/", "parent": None, "name": "", "kind": "directory", "size": None, "mtime": None, "depth": 0}
    while todo:
        at, above, depth = todo.pop()
        count, at = parse_number(data, at)
        n, at = parse_number(data, at)
        at += n
        for _ in range(count):
            n, at = parse_number(data, at)
            kind, name = _KINDS[chr(data[at])], data[at + 1 : at + 1 + n].decode("utf-8", "surrogateescape")
            at += 1 + n
            row = {"path": f"{above}/{name}", "parent": above or "/", "name": name, "kind": kind, "size": None, "mtime": None, "depth": depth + 1}
            if kind == "file":
                row["size"], at = parse_number(data, at)
                row["mtime"], at = parse_number(data, at, signed=True)
            elif kind == "directory":
                where, at = parse_number(data, at)
                todo.append((where, row["path"], depth + 1))
            yield row


def encode(rows: list[dict]) -> bytes:
    """A catalog of rows (path, kind, size, mtime); directories above rows need no row."""
    inside: dict[str, list[dict]] = {"": []}
    for r in sorted(rows, key=lambda r: r["path"].split("/")):
        if r["path"] == "/":
            continue
        parts = r["path"].strip("/").split("/")
        for k in range(1, len(parts)):
            folder = "/" + "/".join(parts[:k])
            if folder not in inside:
                inside[folder] = []
                inside[folder.rpartition("/")[0]].append({"path": folder, "kind": "directory"})
        if r["kind"] == "directory":
            if r["path"] in inside:
                continue
            inside[r["path"]] = []
        inside[r["path"].rpartition("/")[0]].append(r)
    out, places = bytearray(MAGIC), {}
    for folder in sorted(inside, key=lambda p: -p.count("/")):
        places[folder] = len(out)
        name = folder.rpartition("/")[2].encode("utf-8", "surrogateescape")
        out += number(len(inside[folder])) + number(len(name)) + name
        for r in inside[folder]:
            name = r["path"].rpartition("/")[2].encode("utf-8", "surrogateescape")
            out += number(len(name)) + LETTERS[r["kind"]].encode() + name
            if r["kind"] == "file":
                out += number(r["size"]) + number(r["mtime"])
            elif r["kind"] == "directory":
                out += number(places[r["path"]])
    return bytes(out) + places[""].to_bytes(8, "little")


def rows(files: DataFrame) -> DataFrame:
    """Rows of catalogs (content)."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                got = list(parse(data))
                yield pa.RecordBatch.from_pydict({k: [r[k] for r in got] for k in got[0]}, pa.schema([("path", pa.string()), ("parent", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("depth", pa.int32())]))

    return files.select("content").mapInArrow(run, BROWSE)


def catalogs(entries: DataFrame, key: str) -> DataFrame:
    """A catalog for each value of a column of entries (path, kind, size, mtime): key, content. Entries of one catalog meet in one task."""

    def run(k: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        return pa.table([pa.array([k[0].as_py()], pa.string()), pa.array([encode(got.select(["path", "kind", "size", "mtime"]).to_pylist())], pa.binary())], [key, "content"])

    return entries.select(key, "path", "kind", "size", "mtime").groupBy(key).applyInArrow(run, f"{key} string, content binary")
