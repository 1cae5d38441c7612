"""Expressions for sizes, times, window names and content probes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: trailing windows, seconds; None keeps everything ---------
WINDOWS: tuple[tuple[str, int | None], ...] = (
    ("all", None),
    ("1m", 60),
    ("5m", 300),
    ("15m", 900),
    ("1h", 3600),
    ("8h", 28800),
    ("1d", 86400),
)
SENDER_ID_PATTERN = "^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"
# ---- end of fixed values ----------------------------------------------------


def human_size(size_bytes: Column) -> Column:
    """One decimal, KiB below 1024 KiB and MiB from there."""
    kib = size_bytes / F.lit(1024.0)
    return F.when(kib < 1024.0, F.format_string("%.1f KiB", kib)).otherwise(
        F.format_string("%.1f MiB", kib / F.lit(1024.0))
    )


def utc_text(ts: Column) -> Column:
    """Second-precision UTC text ending in Z; needs a UTC session."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_text_from_epoch(seconds: Column) -> Column:
    return utc_text(F.timestamp_seconds(F.floor(seconds)))


def date_parts(ts: Column) -> list[Column]:
    """Year, month and day as zero-padded text, for dated folders."""
    return [
        F.date_format(ts, "yyyy").alias("yyyy"),
        F.date_format(ts, "MM").alias("mm"),
        F.date_format(ts, "dd").alias("dd"),
    ]


def has_nul(content: Column, probe_bytes: int) -> Column:
    """True when the first bytes of a binary value hold a NUL."""
    return F.contains(F.substring(content, 1, probe_bytes), F.lit(bytearray(b"\x00")))


def valid_sender_id(sender_id: Column) -> Column:
    return sender_id.rlike(SENDER_ID_PATTERN)


def window_seconds(key: str | None) -> int | None:
    """Length of a named window; None for 'all', blank and unset."""
    if key is None or not key.strip():
        return None
    wanted = dict(WINDOWS)
    name = key.strip().lower()
    if name not in wanted:
        raise ValueError(f"unknown window {key!r}; one of {sorted(wanted)}")
    return wanted[name]


def clean_window_key(raw: Column) -> Column:
    """Column form: trimmed lower-case key, null when blank, an error when unknown."""
    name = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    known = name.isin([k for k, _ in WINDOWS])
    return F.when(raw.isNull() | (name == ""), F.lit(None).cast("string")).when(
        known, name
    ).otherwise(F.raise_error(F.concat(F.lit("unknown window "), name)).cast("string"))
