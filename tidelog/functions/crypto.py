"""Encryption at rest: AES-256-GCM, 12-byte nonce before the ciphertext."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt(data: Column, key: bytes) -> Column:
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"))


def decrypt(data: Column, key: bytes) -> Column:
    """Raises on a wrong key or changed bytes."""
    return F.aes_decrypt(data, F.lit(key), F.lit("GCM"))


def try_decrypt(data: Column, key: bytes) -> Column:
    """Null on a wrong key or changed bytes."""
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM"))
