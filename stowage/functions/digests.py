"""SHA-256 digests and keyed signatures from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.schemas import SIGNATURE_PREFIX

BLOCK_BYTES = 64


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def key_pad(secret: Column, mask: int) -> Column:
    """Secret as a 64-byte block with every byte combined with `mask` by XOR.

    Evaluated once per sender row, so the per-byte step stays off the hot path.
    """
    raw = secret.cast("binary")
    short = F.when(F.octet_length(raw) > BLOCK_BYTES, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    digits = F.rpad(F.hex(short), BLOCK_BYTES * 2, "0")
    masked = F.transform(
        F.sequence(F.lit(0), F.lit(BLOCK_BYTES - 1)),
        lambda i: F.lpad(
            F.hex(
                F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10)
                .cast("long")
                .bitwiseXOR(F.lit(mask).cast("long"))
            ),
            2,
            "0",
        ),
    )
    return F.unhex(F.array_join(masked, ""))


def with_signing_pads(senders, secret: str = "secret"):
    """Sender table with the two pads the signature needs, secret removed."""
    return senders.withColumns(
        {"ipad": key_pad(F.col(secret), 0x36), "opad": key_pad(F.col(secret), 0x5C)}
    ).drop(secret)


def signature(message: Column, ipad: Column, opad: Column) -> Column:
    """HMAC-SHA256 of a message as prefixed lower-case hex."""
    inner = F.unhex(F.sha2(F.concat(ipad, message.cast("binary")), 256))
    return F.concat(F.lit(SIGNATURE_PREFIX), F.sha2(F.concat(opad, inner), 256))


def signature_matches(message: Column, claimed: Column, ipad: Column, opad: Column) -> Column:
    return F.coalesce(signature(message, ipad, opad) == claimed, F.lit(False))


def receipt_digest(manifest: Column, archive: Column) -> Column:
    """Digest of the manifest bytes, a zero byte and the archive bytes."""
    return F.sha2(
        F.concat(manifest.cast("binary"), F.lit(bytearray(b"\x00")), archive.cast("binary")), 256
    )
