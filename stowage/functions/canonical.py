"""JSON texts whose exact bytes are signed or hashed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.schemas import AUDIT_FIELDS, SEAL_FIELDS

# Control characters whose escape holds a hex letter; canonical text wants them lower case.
_LETTERED = [f"{code:04X}" for code in range(0x20) if f"{code:04X}" != f"{code:04x}"]


def lower_escapes(text: Column) -> Column:
    """Turn \\u001F into \\u001f, leaving literal backslashes alone.

    Backslashes escape each other in pairs from the left, so pairs are set aside
    first under a control character, which JSON text never holds raw; what is
    left of \\uXXXX then is an escape.  Plain replacements, no regex per code.
    """
    aside = F.lit("\u0001")
    fixed = F.replace(text, F.lit("\\\\"), aside)
    for code in _LETTERED:
        fixed = F.replace(fixed, F.lit(f"\\u{code}"), F.lit(f"\\u{code.lower()}"))
    fixed = F.replace(fixed, aside, F.lit("\\\\"))
    return F.when(text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)


def manifest_text(
    bundle_id: Column,
    files: Column,
    sender_id: Column,
    sent_at: Column,
    source_root: Column,
    schema_version: Column,
) -> Column:
    """Canonical manifest JSON, keys sorted, one line feed at the end.

    `files` is an array of structs whose fields are already in sorted order.
    """
    body = F.to_json(
        F.struct(
            bundle_id.alias("bundle_id"),
            files.alias("files"),
            schema_version.alias("schema_version"),
            sender_id.alias("sender_id"),
            sent_at.alias("sent_at"),
            source_root.alias("source_root"),
        )
    )
    return F.concat(lower_escapes(body), F.lit("\n"))


def _line(fields: tuple[str, ...], values: dict[str, Column]) -> Column:
    return lower_escapes(
        F.to_json(
            F.struct(*[values[name].alias(name) for name in fields]),
            {"ignoreNullFields": "false"},
        )
    )


def audit_line(**values: Column) -> Column:
    """Audit record as compact JSON in written order, nulls kept, no line feed."""
    return _line(AUDIT_FIELDS, values)


def audit_line_head(**values: Column) -> Column:
    """The same text up to, not including, the prev_hash value.

    The chain hash is the last field, so a line is this head, the hash and '"}'.
    """
    body = _line(AUDIT_FIELDS[:-1], values)
    return F.concat(F.left(body, F.length(body) - 1), F.lit(',"prev_hash":"'))


def seal_line(**values: Column) -> Column:
    return _line(SEAL_FIELDS, values)
