"""Deterministic and randomised AES of integer columns.

Deterministic ciphertexts of equal values are equal, so they join; they show which values are equal. The default key and
initialisation vector are fixed and known: with them, the ciphertext shows form, not secrecy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A key of 32 zero bytes and a vector of 16 one bytes.
KEY, VECTOR = bytes(32), b"\x01" * 16


def little_endian(value: Column) -> Column:
    """A 32-bit unsigned integer as 4 bytes, the least first. Values outside of the 32 bits are an error."""
    big = F.lpad(F.hex(value.cast("long")), 8, "0")
    ok = F.when(value.cast("long").between(0, 4294967295), big).when(value.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("not an unsigned 32-bit integer")))
    return F.unhex(F.concat(*[F.substring(ok, i, 2) for i in (7, 5, 3, 1)]))


def from_little_endian(data: Column) -> Column:
    h = F.hex(data)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


def encrypt(data: Column, key: bytes = KEY, vector: bytes = VECTOR) -> Column:
    """AES-256-CBC of binary data with a fixed vector, without the vector."""
    return F.substring(F.aes_encrypt(data, F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(vector)), 17, 2147483647)


def decrypt(data: Column, key: bytes = KEY, vector: bytes = VECTOR) -> Column:
    return F.aes_decrypt(F.concat(F.lit(vector), data), F.lit(key), F.lit("CBC"), F.lit("PKCS"))


def encrypt_int(value: Column, key: bytes = KEY, vector: bytes = VECTOR) -> Column:
    return encrypt(little_endian(value), key, vector)


def decrypt_int(data: Column, key: bytes = KEY, vector: bytes = VECTOR) -> Column:
    return from_little_endian(decrypt(data, key, vector))


def encrypt_random(data: Column, key: bytes = KEY) -> Column:
    """AES-256-CBC with a random vector, which comes first."""
    return F.aes_encrypt(data, F.lit(key), F.lit("CBC"), F.lit("PKCS"))


def decrypt_random(data: Column, key: bytes = KEY) -> Column:
    return F.aes_decrypt(data, F.lit(key), F.lit("CBC"), F.lit("PKCS"))


def ciphertext_length(n: Column) -> Column:
    """Bytes of the ciphertext of ``n`` bytes, without the vector."""
    return (F.floor(n / 16) + 1) * 16


def xor(a: Column, b: Column) -> Column:
    """Byte-wise exclusive or of two binary columns, as long as the shorter."""
    at = F.sequence(F.lit(1), F.least(F.octet_length(a), F.octet_length(b)))
    byte = lambda x, i: F.conv(F.hex(F.substring(x, i, F.lit(1))), 16, 10).cast("int")
    return F.when(F.least(F.octet_length(a), F.octet_length(b)) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(F.transform(at, lambda i: F.lpad(F.hex(byte(a, i).bitwiseXOR(byte(b, i)).cast("long")), 2, "0")), "")))
