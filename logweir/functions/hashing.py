"""Keyed pseudonyms and stable ids from built-in SHA-256, as Spark SQL expressions."""

from __future__ import annotations

KEY_BYTES = 32
#: Key of the queries over the synthetic tables; real analyses read theirs from a file.
TEST_KEY = bytes(range(KEY_BYTES))


def _pad(key: bytes, mask: int) -> bytes:
    return bytes(b ^ mask for b in key.ljust(64, b"\0"))


def hmac_hex(key: bytes, purpose: str, value: str, n_hex: int = 64) -> str:
    """First hex digits of HMAC-SHA256 over purpose, a zero byte and the value (a string or binary expression)."""
    inner = (_pad(key, 0x36) + purpose.encode() + b"\0").hex()
    digest = f"sha2(concat(X'{_pad(key, 0x5C).hex()}', unhex(sha2(concat(X'{inner}', CAST({value} AS BINARY)), 256))), 256)"
    return digest if n_hex == 64 else f"substr({digest}, 1, {n_hex})"


def length_prefixed(value: str) -> str:
    return f"concat(unhex(lpad(hex(octet_length({value})), 8, '0')), CAST({value} AS BINARY))"


def stable_id(prefix: str, purpose: str, *fields: str) -> str:
    """`prefix` and 16 hex digits of SHA-256 over the purpose and length-prefixed fields."""
    parts = ", ".join(length_prefixed(f) for f in fields)
    return f"concat('{prefix}', substr(sha2(concat(X'{(purpose.encode() + bytes(1)).hex()}', {parts}), 256), 1, 16))"


def key_id(key: bytes) -> str:
    """Public name of a key: 16 hex digits of its SHA-256."""
    import hashlib

    return hashlib.sha256(key).hexdigest()[:16]
