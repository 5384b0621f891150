"""Encryption keys and key files. Keys stay on the driver: the JVM's cipher is called directly, so that no plan or event log holds one."""

from __future__ import annotations

import base64
import hashlib
import json
import secrets
from dataclasses import dataclass

from pyspark.sql import SparkSession

from vaultframe.functions.codecs import derive_id_key, derive_key

# Fixed values of key files: how an id key is derived, and how often a password is hashed.
ID_SALT, ID_TIMES = b"_id_key", 10
TIMES = 65535


@dataclass(frozen=True)
class Key:
    """A key of 32 bytes with the id key that digests and signatures use."""

    raw: bytes

    def __post_init__(self):
        if len(self.raw) != 32:
            raise ValueError(f"a key has 32 bytes, not {len(self.raw)}")

    def __repr__(self) -> str:
        return "Key(...)"

    @property
    def id_key(self) -> bytes:
        return derive_id_key(self.raw, ID_SALT, ID_TIMES)

    def fingerprint(self, salt: bytes) -> str:
        """Digest of a salt (that of a store's key files) and the id key, in colon hex."""
        return hashlib.sha256(salt + self.id_key).digest().hex(":").upper()


def random_key() -> Key:
    return Key(secrets.token_bytes(32))


def _aes(spark: SparkSession, encrypt: bool, key: bytes, nonce: bytes, data: bytes) -> bytes:
    crypto = spark.sparkContext._jvm.javax.crypto
    cipher = crypto.Cipher.getInstance("AES/GCM/NoPadding")
    cipher.init(1 if encrypt else 2, crypto.spec.SecretKeySpec(key, "AES"), crypto.spec.GCMParameterSpec(128, nonce))
    return bytes(cipher.doFinal(data))


def key_file(spark: SparkSession, key: Key, password: str | None, salt: bytes | None = None) -> str:
    """A key as JSON, under a password unless that is None; with a fingerprint if its salt is given."""
    text = lambda b: base64.b64encode(b).decode()
    if password is None:
        out = {"kdf": {"type": "none"}, "data": text(key.raw)}
    else:
        own, nonce = secrets.token_bytes(32), secrets.token_bytes(12)
        sealed = _aes(spark, True, derive_key(password.encode(), own, TIMES), nonce, key.raw)
        out = {"kdf": {"type": "pbkdf2", "salt": text(own), "iter": TIMES}, "data": text(nonce + bytes(4) + sealed[-16:] + sealed[:-16])}
    return json.dumps(out | ({"fingerprint": key.fingerprint(salt)} if salt is not None else {}), indent=2)


def load_key(spark: SparkSession, content: str, password: str | None = None, salt: bytes | None = None) -> Key:
    """The key of a key file. Fails on a wrong password, an unknown way to derive keys (scrypt, too), short data, and, if the salt is given, another fingerprint."""
    file = json.loads(content)
    data, kdf = base64.b64decode(file["data"]), file["kdf"]
    if (kind := kdf["type"]) not in ("none", "pbkdf2"):
        raise ValueError(f"keys derived by {kind} are not supported")
    if (kind == "none") != (password is None):
        raise ValueError("the key file has no password" if kind == "none" else "the key file needs a password")
    if kind == "none":
        key = Key(data)
    else:
        if len(data) < 32:
            raise ValueError(f"{len(data)} bytes are no encrypted key")
        derived = derive_key(password.encode(), base64.b64decode(kdf["salt"]), kdf.get("iter") or TIMES)
        try:
            key = Key(_aes(spark, False, derived, data[:12], data[32:] + data[16:32]))
        except Exception as e:
            if "AEADBadTag" not in str(e):
                raise
            raise ValueError("wrong password or damaged key file") from None
    if salt is not None and file.get("fingerprint") not in (None, "", key.fingerprint(salt)):
        raise ValueError("the key has another fingerprint")
    return key
