"""Shell globs as one regular expression each, tested JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: paths left out of a backup -------------------------------
DEFAULT_EXCLUSIONS = (
    ".git/",
    "__pycache__/",
    "*.pyc",
    "*.pyo",
    "*.pyd",
    ".pytest_cache/",
    ".coverage",
    "htmlcov/",
    ".python-version",
    ".DS_Store",
    "Thumbs.db",
    ".Spotlight-V100",
    ".Trashes",
    ".fseventsd",
    ".vscode/",
    ".idea/",
    ".project",
    ".settings/",
    "*.log",
    "*.zip",
    "*.tar",
    "*.gz",
    "*.bz2",
    "*.xz",
    "*.zst",
    "*.db",
    "*.sqlite",
    "*.sqlite3",
    "*/postfix/spool/*",
)
# ---- end of fixed values ----------------------------------------------------


def _class_body(body: str) -> str:
    negated = body.startswith("!")
    inner = body[1:] if negated else body
    escaped = re.sub(r"([\\\[\]&^~|])", r"\\\1", inner)
    return f"[{'^' if negated else ''}{escaped}]"


def glob_regex(pattern: str) -> str:
    """Body of a regex that matches what the glob matches; '*' crosses '/'."""
    out, rest = [], pattern
    while rest:
        if rest[0] == "*":
            rest = rest.lstrip("*")
            out.append(".*")
            continue
        if rest[0] == "?":
            out.append(".")
        elif rest[0] == "[" and (found := re.match(r"\[(!?\]?[^\]]*)\]", rest)) and found[1] not in ("", "!"):
            out.append(_class_body(found[1]))
            rest = rest[found.end() :]
            continue
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/ ])", r"\\\1", rest[0]))
        rest = rest[1:]
    return "".join(out)


def any_glob(value: Column, patterns: list[str]) -> Column:
    """True when the whole value matches one of the patterns."""
    if not patterns:
        return F.lit(False)
    body = "|".join(dict.fromkeys(glob_regex(p) for p in patterns))
    return value.rlike(rf"(?s)\A(?:{body})\z")


def excluded(
    relative_path: Column, patterns: tuple[str, ...] = DEFAULT_EXCLUSIONS
) -> Column:
    """True when a pattern matches the path, its name or any component.

    Two regexes, no per-component step: one over the whole path, where '*'
    crosses '/', and one that finds a matching run between slashes.
    """
    if not patterns:
        return F.lit(False)
    trimmed = [p.rstrip("/") for p in patterns]
    whole = any_glob(relative_path, [*trimmed, *patterns])
    inside = "|".join(dict.fromkeys(_slash_free(p) for p in trimmed if p and "/" not in p))
    if not inside:
        return whole
    return whole | relative_path.rlike(rf"(?s)(?:\A|/)(?:{inside})(?:/|\z)")


def _slash_free(pattern: str) -> str:
    """Glob body restricted to one component, for patterns with '?' or classes."""
    out = []
    for piece in re.findall(r"\*+|\?|\[!?\]?[^\]]*\]|.", pattern, flags=re.S):
        if piece[0] == "*":
            out.append("[^/]*")
        elif piece == "?":
            out.append("[^/]")
        elif piece[0] == "[" and len(piece) > 2:
            out.append(f"(?!/){glob_regex(piece)}")
        else:
            out.append(glob_regex(piece))
    return "".join(out)
