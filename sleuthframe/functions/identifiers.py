"""Canonical identifiers and keyed hashes, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
LEAST_PHONE_DIGITS = 7


def check_key(key: str) -> bytes:
    """The key of all identifier hashes; there is no default, since a known key makes phone numbers guessable."""
    if not key or not key.strip() or "change_me" in key.lower() or key.strip().lower() == "changeme":
        raise ValueError("a secret key is required for identifier hashes")
    return key.encode()


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def normalize(value: Column) -> Column:
    """struct(value, type): a lower-case e-mail address, or the digits of a phone number; null for anything else."""
    bare = F.trim(value)
    email = F.struct(F.lower(bare).alias("value"), F.lit("email").alias("type"))
    phone = F.struct(digits(bare).alias("value"), F.lit("phone").alias("type"))
    return F.when(bare.rlike(EMAIL), email).when(F.length(digits(bare)) >= LEAST_PHONE_DIGITS, phone)


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal, composed of the built-in SHA-2."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def identifier_hash(value: Column, key: str) -> Column:
    return hmac_sha256(normalize(value)["value"], check_key(key))


def display_id(hmac_hex: Column) -> Column:
    """Public name of a node: the hash of the hash, so that the index key stays private."""
    return F.sha2(hmac_hex, 256)


def entity(value: Column, key: str, run_id: Column | None = None) -> Column:
    """struct(id, value, type); free text is an entity of its own case if ``run_id`` is given. Null for blanks."""
    known, bare = normalize(value), F.trim(value)
    other = bare if run_id is None else F.concat(F.lit("other|"), run_id, F.lit("|"), bare)
    material = F.coalesce(known["value"], other)
    found = F.struct(display_id(hmac_sha256(material, check_key(key))).alias("id"), F.coalesce(known["value"], bare).alias("value"), F.coalesce(known["type"], F.lit("other")).alias("type"))
    return F.when(F.length(bare) > 0, found)
