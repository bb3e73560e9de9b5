"""Keyed digests, password hashes and AES-GCM as Columns. Asymmetric keys are in ``keys``."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def mac(x: Column, key: bytes, how: str = "sha256") -> Column:
    """HMAC, as bytes."""

    @F.arrow_udf("binary")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if v is None else hmac.digest(key, v, how) for v in b.to_pylist()], pa.binary())

    return sign(x.cast("binary"))


def verify_mac(x: Column, tag: Column, key: bytes, how: str = "sha256") -> Column:
    return mac(x, key, how) == tag


def encrypt(x: Column, key: Column, aad: str = "") -> Column:
    """AES-GCM with a fresh nonce before the text."""
    return F.aes_encrypt(x, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad)) if aad else F.aes_encrypt(x, key, F.lit("GCM"))


def decrypt(x: Column, key: Column, aad: str = "") -> Column:
    """Absent where the key or the text is wrong."""
    return F.try_aes_decrypt(x, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)) if aad else F.try_aes_decrypt(x, key, F.lit("GCM"))


def hash_password(password: str, n: int = 1 << 14) -> str:
    """scrypt with a fresh salt, on the driver."""
    salt = os.urandom(16)
    raw = hashlib.scrypt(password.encode(), salt=salt, n=n, r=8, p=1)
    return f"scrypt${n}${base64.b64encode(salt).decode()}${base64.b64encode(raw).decode()}"


def verify_password(password: str, stored: str) -> bool:
    _, n, salt, raw = stored.split("$")
    again = hashlib.scrypt(password.encode(), salt=base64.b64decode(salt), n=int(n), r=8, p=1)
    return hmac.compare_digest(again, base64.b64decode(raw))


def _passphrase_key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def encrypt_with_passphrase(x: Column, passphrase: str) -> Column:
    """AES-GCM under a scrypt key; the call's fresh salt (16 bytes) stands before each text."""
    salt = os.urandom(16)
    return F.concat(F.lit(salt), encrypt(x.cast("binary"), F.lit(_passphrase_key(passphrase, salt))))


def decrypt_with_passphrase(x: Column, passphrase: str) -> Column:
    """Absent where the passphrase or the text is wrong. A key is derived once for each salt in a task."""

    @F.arrow_udf("binary")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, bytes] = {}
        for b in batches:
            for salt in b.unique().to_pylist():
                if salt is not None and salt not in known:
                    known[salt] = _passphrase_key(passphrase, salt)
            yield pa.array([None if s is None else known[s] for s in b.to_pylist()], pa.binary())

    return decrypt(F.substring(x, 17, 1 << 30), keys(F.substring(x, 1, 16)))


def armor(x: Column) -> Column:
    """Bytes as base64 lines between markers."""
    return F.concat(F.lit("-----BEGIN ENCRYPTED DATA-----\n"), F.replace(F.base64(x), F.lit("\r\n"), F.lit("\n")), F.lit("\n-----END ENCRYPTED DATA-----\n"))


def unarmor(s: Column) -> Column:
    body = F.regexp_extract(s, r"(?s)-----BEGIN ENCRYPTED DATA-----\n(.*?)\n-----END", 1)
    return F.try_to_binary(F.nullif(F.regexp_replace(body, r"\s", ""), F.lit("")), F.lit("base64"))
