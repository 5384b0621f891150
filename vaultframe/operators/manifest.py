"""Snapshot manifests as JSON, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.functions.codecs import hmac_sha256
from vaultframe.functions.scalars import colon_hex
from vaultframe.schema import MANIFEST


def assembled(files: DataFrame) -> DataFrame:
    """A manifest for each snapshot of (backup_type, backup_id, backup_time, filename, crypt_mode, size, csum), files by name."""
    one = F.struct("filename", F.col("crypt_mode").alias("crypt-mode"), "size", "csum")
    each = files.groupBy("backup_type", "backup_id", "backup_time").agg(F.array_sort(F.collect_list(one)).alias("files"))
    body = F.struct(F.col("backup_type").alias("backup-type"), F.col("backup_id").alias("backup-id"), F.col("backup_time").alias("backup-time"), "files")
    return each.select("backup_type", "backup_id", "backup_time", F.to_json(body).alias("manifest"))


def parsed(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """Files of manifests, one row each."""
    m = manifests.select(F.from_json(column, MANIFEST).alias("m"))
    f = m.select(F.col("m.backup-type").alias("backup_type"), F.col("m.backup-id").alias("backup_id"), F.col("m.backup-time").alias("backup_time"), F.explode("m.files").alias("f"))
    return f.select("backup_type", "backup_id", "backup_time", "f.filename", F.col("f.crypt-mode").alias("crypt_mode"), "f.size", "f.csum")


def verified(manifest_files: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("filename",)) -> DataFrame:
    """Status of each actual file: ok, csum, size (checked in this order), or missing in the manifest."""
    m = manifest_files.select(*keys, F.col("csum").alias("m_csum"), F.col("size").alias("m_size"), F.lit(True).alias("m_has"))
    got = actual.join(m, list(keys), "left")
    status = F.when(F.col("m_has").isNull(), "missing").when(~F.col("m_csum").eqNullSafe(F.col("csum")), "csum").when(~F.col("m_size").eqNullSafe(F.col("size")), "size").otherwise("ok")
    return got.select(*keys, status.alias("status"))


def signature(manifest: Column, id_key: bytes) -> Column:
    """Of a manifest (a struct of MANIFEST): the HMAC, in colon hex, of its fields in fixed order without signature and unprotected part; empty crypt modes are left out."""
    given = lambda c: F.nullif(c, F.lit(""))
    file = lambda f: F.struct(f["filename"].alias("filename"), given(f["crypt-mode"]).alias("crypt-mode"), f["size"].alias("size"), f["csum"].alias("csum"))
    parts = [manifest[k].alias(k) for k in ("backup-type", "backup-id", "backup-time")]
    canonical = F.to_json(F.struct(*parts, F.transform(manifest["files"], file).alias("files"), given(manifest["crypt-mode"]).alias("crypt-mode")))
    return colon_hex(F.unhex(hmac_sha256(canonical.cast("binary"), id_key)))


def signed(manifests: DataFrame, id_key: bytes, fingerprint: str) -> DataFrame:
    """manifests (manifest: JSON) with their signature in them and the key's fingerprint in the unprotected part."""
    m = F.from_json("manifest", MANIFEST)
    fields = [m[k].alias(k) for k in ("backup-type", "backup-id", "backup-time", "files", "crypt-mode")]
    unprotected = F.struct(F.lit(fingerprint).alias("key-fingerprint")).alias("unprotected")
    return manifests.withColumn("manifest", F.to_json(F.struct(*fields, signature(m, id_key).alias("signature"), unprotected)))


def signature_status(manifest: Column | str, id_key: bytes) -> Column:
    """Of a manifest as JSON: ok, mismatch, or missing where it has no signature."""
    m = F.from_json(manifest, MANIFEST)
    return F.when(F.coalesce(m["signature"], F.lit("")) == "", "missing").when(m["signature"] == signature(m, id_key), "ok").otherwise("mismatch")
