"""Time-ordered bundle ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7(ts: Column, entropy: Column | None = None) -> Column:
    """Version-7 UUID text: 48-bit milliseconds, then version, variant and noise.

    `entropy` is hex text of 32 digits or more; a random one is drawn when unset.
    """
    noise = entropy if entropy is not None else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(ts))), 12, "0")
    variant = F.substr(F.lit("89ab"), F.ascii(F.substring(noise, 4, 1)) % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(stamp, 1, 8),
        F.substring(stamp, 9, 4),
        F.concat(F.lit("7"), F.substring(noise, 1, 3)),
        F.concat(variant, F.substring(noise, 5, 3)),
        F.substring(noise, 9, 12),
    )
