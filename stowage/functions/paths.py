"""Expressions over slash-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL_CHARACTERS = r"[\x00-\x1f\x7f]"


def parts(path: Column) -> Column:
    """Components of a path without the empty and '.' ones; '..' is kept."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def normalise(path: Column) -> Column:
    """Relative text form: no leading slash, no '.' and no empty component.

    Plain substring tests pick the rows that need the split; few do.
    """
    untidy = (
        path.startswith("/")
        | path.endswith("/")
        | path.startswith("./")
        | path.endswith("/.")
        | path.contains("//")
        | path.contains("/./")
        | (path == ".")
    )
    return F.when(untidy, F.array_join(parts(path), "/")).otherwise(path)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a normalised path, '' at the top."""
    above = F.length(path) - F.length(base_name(path)) - 1
    return F.left(path, F.greatest(above, F.lit(0)))


def depth(path: Column) -> Column:
    """Number of components of a normalised path; the empty path has none."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.when(path == "", F.lit(0)).otherwise(slashes + 1).cast("int")


def extension(path: Column) -> Column:
    """Lower-cased final suffix; a name that is all suffix, or ends in a dot, has none."""
    name = base_name(path)
    last = F.substring_index(name, ".", -1)
    has_stem = F.length(name) - F.length(last) > 1
    return F.when(has_stem & (last != ""), F.concat(F.lit("."), F.lower(last))).otherwise("")


def escapes_root(path: Column) -> Column:
    """True when some prefix of the path climbs above where it starts."""
    step = F.transform(
        parts(path), lambda p: F.when(p == "..", F.lit(-1)).otherwise(F.lit(1))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("lowest"))
    walk = F.aggregate(
        step,
        start,
        lambda acc, s: F.struct(
            (acc["at"] + s).alias("at"),
            F.least(acc["lowest"], acc["at"] + s).alias("lowest"),
        ),
        lambda acc: acc["lowest"] < 0,
    )
    return F.when(path.contains(".."), walk).otherwise(F.lit(False))


def ancestors(path: Column, include_self: bool = False, include_top: bool = False) -> Column:
    """Directories above a normalised path, outermost first.

    `include_self` adds the path, `include_top` adds '' for the root.
    """
    pieces = F.split(path, "/")
    last = F.size(pieces) if include_self else F.size(pieces) - 1
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    chain = F.transform(steps, lambda k: F.array_join(F.slice(pieces, 1, k), "/"))
    if include_top:
        chain = F.concat(F.array(F.lit("")), F.filter(chain, lambda p: p != ""))
    return chain


def illegal_name(name: Column) -> Column:
    """Names with control characters or DEL."""
    return name.rlike(CONTROL_CHARACTERS)


def tree_key(path: Column, is_folder: Column) -> Column:
    """Sort key that puts a folder first, then its files, then its sub-folders.

    Folder components are marked '1', a file's own name '0'; the separator
    sorts below every name, so a folder's key is a prefix of all inside it.
    """
    sep = "\u0001"
    folders = F.transform(F.split(path, "/"), lambda p: F.concat(F.lit("1"), p))
    as_folder = F.when(path == "", F.lit("")).otherwise(F.array_join(folders, sep))
    above = F.slice(folders, 1, F.size(folders) - 1)
    as_file = F.array_join(
        F.concat(above, F.array(F.concat(F.lit("0"), base_name(path)))), sep
    )
    return F.when(is_folder, as_folder).otherwise(as_file)


def clean_extension_list(raw: Column) -> Column:
    """Set of lower-cased, dotted extensions from comma-separated text."""
    trimmed = F.transform(
        F.split(raw, ","), lambda e: F.lower(F.regexp_replace(e, r"^\s+|\s+$", ""))
    )
    dotted = F.transform(
        F.filter(trimmed, lambda e: e != ""),
        lambda e: F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e)),
    )
    return F.array_sort(F.array_distinct(dotted))
