"""Masking and keyed tokens as plain expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from conductrisk.config import MASK_LENGTH


def mask(c: Column, salt: str, length: int = MASK_LENGTH) -> Column:
    """Prefix of SHA-256(salt + value); null stays null."""
    length = max(1, min(length, 64))
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, length)


def secret(spark: SparkSession, key: bytes) -> Column:
    """Struct(key, inner, outer): a key and its two HMAC pads, as the value of a one-row key table.

    Expressions refer to the table, so neither plans nor event logs show the key.
    """
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    row = (bytearray(key), bytearray(b ^ 0x36 for b in block), bytearray(b ^ 0x5C for b in block))
    table = spark.createDataFrame([row], "key binary, inner binary, outer binary")
    return table.select(F.struct("key", "inner", "outer")).scalar()


def token(c: Column, pads: Column, salt: Column | str = "") -> Column:
    """URL-safe base64 of HMAC-SHA256(key, "value:salt"); `pads` comes from `secret`."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    message = F.encode(F.concat(c.cast("string"), F.lit(":"), salt), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(pads["inner"], message), 256))
    outer = F.unhex(F.sha2(F.concat(pads["outer"], inner), 256))
    return F.translate(F.base64(outer), "+/", "-_")
