"""Blobs, compression, encryption and keyed hashes. Spark's own AES is used; what it lacks is Arrow-batched Python."""

from __future__ import annotations

import hashlib
import hmac
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from vaultframe.functions.batches import small_batches
from vaultframe.functions.scalars import from_le, le32

# Fixed values of the blob format: what a blob begins with, by kind.
PLAIN = bytes((66, 171, 56, 7, 190, 131, 112, 161))
COMPRESSED = bytes((49, 185, 88, 66, 111, 182, 163, 127))
ENCRYPTED = bytes((123, 103, 133, 190, 34, 45, 76, 240))
ENCRYPTED_COMPRESSED = bytes((230, 89, 27, 191, 11, 191, 216, 11))
MOST = 128 << 20
#: Shorter data are not compressed.
LEAST_COMPRESSED = 32
#: The keys of the hash of names.
NAME_KEYS = (0x83AC3F1CFBB450DB, 0xAA4F1B6879369FBD)


@F.arrow_udf(BinaryType())
def _compress(data: pa.Array) -> pa.Array:
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    return pa.array([c.compress(x.as_buffer()) if x.is_valid else None for x in data], pa.binary())


@F.arrow_udf(BinaryType())
def _decompress(data: pa.Array) -> pa.Array:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompressobj().decompress(x.as_buffer()) if x.is_valid else None for x in data], pa.binary())


def _batched(of, data: Column | str) -> Column:
    """A function of whole blobs, in a session that gives Python few of them at a time."""
    if spark := SparkSession.getActiveSession():
        small_batches(spark)
    return of(data)


def zstd_compress(data: Column | str) -> Column:
    return _batched(_compress, data)


def zstd_decompress(data: Column | str) -> Column:
    return _batched(_decompress, data)


def hmac_sha256(data: Column, key: bytes) -> Column:
    """By the definition of HMAC, with Spark's own hash."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), data), 256))), 256)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def siphash(messages: list[bytes], keys: tuple[int, int] = NAME_KEYS) -> np.ndarray:
    """SipHash-2-4 of many messages at once, those of a length together."""
    out = np.zeros(len(messages), np.uint64)
    lengths = np.array([len(m) for m in messages], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        padded = np.zeros((len(at), int(n) // 8 * 8 + 8), np.uint8)
        padded[:, :n] = np.frombuffer(b"".join(messages[i] for i in at), np.uint8).reshape(len(at), int(n))
        padded[:, -1] = n & 255
        blocks = padded.view("<u8")
        k0, k1 = (np.uint64(k) for k in keys)
        a, b, c, d = (np.full(len(at), k ^ np.uint64(v)) for k, v in zip((k0, k1, k0, k1), (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573), strict=True))

        def stir(times: int) -> None:
            nonlocal a, b, c, d
            for _ in range(times):
                a, c = a + b, c + d
                b, d = _rotated(b, 13) ^ a, _rotated(d, 16) ^ c
                a = _rotated(a, 32)
                a, c = a + d, c + b
                b, d = _rotated(b, 17) ^ c, _rotated(d, 21) ^ a
                c = _rotated(c, 32)

        for i in range(blocks.shape[1]):
            d = d ^ blocks[:, i]
            stir(2)
            a = a ^ blocks[:, i]
        c = c ^ np.uint64(0xFF)
        stir(4)
        out[at] = a ^ b ^ c ^ d
    return out


@F.arrow_udf(LongType())
def name_hash(name: pa.Array) -> pa.Array:
    """SipHash of a name as a signed number; order by its XOR with the least one for unsigned order."""
    got = siphash([(x or "").encode() for x in name.to_pylist()]).view(np.int64)
    return pa.array(got, pa.int64(), mask=np.asarray(name.is_null()))


def _blob(magic: Column, payload: Column) -> Column:
    return F.concat(magic, le32(F.crc32(payload)), payload)


def blob_encode(data: Column, compress: bool = False) -> Column:
    """A blob: its kind, the CRC-32 of the payload, the payload; compressed only where that is shorter."""
    sound = F.when(F.octet_length(data) > MOST, F.raise_error(F.lit("blob data too large"))).otherwise(data)
    if not compress:
        return _blob(F.lit(PLAIN), sound)
    small = zstd_compress(data)
    shorter = (F.octet_length(data) >= LEAST_COMPRESSED) & (F.octet_length(small) < F.octet_length(data))
    return F.when(shorter, _blob(F.lit(COMPRESSED), small)).otherwise(_blob(F.lit(PLAIN), sound))


def is_encrypted(blob: Column) -> Column:
    return F.substring(blob, 1, 8).isin(F.lit(ENCRYPTED), F.lit(ENCRYPTED_COMPRESSED))


def is_compressed(blob: Column) -> Column:
    return F.substring(blob, 1, 8).isin(F.lit(COMPRESSED), F.lit(ENCRYPTED_COMPRESSED))


def _rest(blob: Column, start: int) -> Column:
    return F.substring(blob, start + 1, 1 << 30)


def blob_decode(blob: Column, key: bytes | None = None) -> Column:
    """The data of a blob; fails on a wrong CRC or an unknown kind. Encrypted blobs need the key."""
    magic = F.substring(blob, 1, 8)
    body = F.when(is_encrypted(blob), _rest(blob, 44)).otherwise(_rest(blob, 12))
    checked = F.when(F.crc32(body) == from_le(blob, 8, 4), body).otherwise(F.raise_error(F.lit("blob CRC mismatch")).cast("binary"))
    out = F.when(magic == F.lit(PLAIN), checked).when(magic == F.lit(COMPRESSED), zstd_decompress(F.when(magic == F.lit(COMPRESSED), checked)))
    if key is not None:
        sealed = F.concat(F.substring(blob, 13, 12), checked, F.substring(blob, 29, 16))
        plain = F.aes_decrypt(F.when(is_encrypted(blob), sealed), F.lit(key), F.lit("GCM"))
        out = out.when(magic == F.lit(ENCRYPTED), plain).when(magic == F.lit(ENCRYPTED_COMPRESSED), zstd_decompress(F.when(magic == F.lit(ENCRYPTED_COMPRESSED), plain)))
    return out.otherwise(F.raise_error(F.lit("unknown blob kind")).cast("binary"))


def blob_encrypt(data: Column, key: bytes, nonce: Column, compress: bool = False) -> Column:
    """An encrypted blob: kind, CRC-32 of the ciphertext, nonce in 16 bytes, tag, ciphertext. The nonce (12 bytes) must not come twice for a key."""
    small = zstd_compress(data) if compress else None
    shorter = (F.octet_length(data) >= LEAST_COMPRESSED) & (F.octet_length(small) < F.octet_length(data)) if compress else F.lit(False)
    sealed = F.aes_encrypt(F.when(shorter, small).otherwise(data) if compress else data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce)
    n = F.octet_length(sealed)
    text = F.substring(sealed, F.lit(13), n - 28)
    return F.concat(F.when(shorter, F.lit(ENCRYPTED_COMPRESSED)).otherwise(F.lit(ENCRYPTED)), le32(F.crc32(text)), F.substring(sealed, 1, 12), F.lit(bytes(4)), F.substring(sealed, n - 15, F.lit(16)), text)


def derive_key(password: bytes, salt: bytes, iterations: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password, salt, iterations)


def derive_id_key(password: bytes, salt: bytes, iterations: int) -> bytes:
    """The plain chain of keyed hashes that id keys use: no block number, nothing summed."""
    out = salt
    for _ in range(max(1, iterations)):
        out = hmac.new(password, out, hashlib.sha256).digest()
    return out


def canonical_manifest(manifest: dict) -> bytes:
    """What is signed: fields in fixed order, without signature and unprotected part; empty optional ones are left out."""
    out = {k: manifest[k] for k in ("backup-type", "backup-id", "backup-time")}
    out["files"] = [{"filename": f["filename"], **({"crypt-mode": f["crypt-mode"]} if f.get("crypt-mode") else {}), "size": f["size"], "csum": f["csum"]} for f in manifest["files"]]
    if manifest.get("crypt-mode"):
        out["crypt-mode"] = manifest["crypt-mode"]
    return json.dumps(out, separators=(",", ":"), ensure_ascii=False).encode()


def sign_manifest(manifest: dict, id_key: bytes) -> str:
    return hmac.new(id_key, canonical_manifest(manifest), hashlib.sha256).digest().hex(":").upper()


def manifest_signature_ok(manifest: dict, id_key: bytes) -> bool:
    return bool(manifest.get("signature")) and hmac.compare_digest(manifest["signature"], sign_manifest(manifest, id_key))
