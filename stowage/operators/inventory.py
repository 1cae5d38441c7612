"""File inventories: pre-flight, roll-ups, windows, selections.

A file table has root, root_ord, relative_path, size_bytes, mtime (epoch
seconds) and, where a probe is asked for, content.  Paths are normalised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import paths, text
from stowage.plans import spread
from stowage.plans.sliced import SlicedOrder
from stowage.schemas import Limits

# ---- fixed values: directories a scope scan never enters --------------------
SKIPPED_DIRECTORIES = (
    ".git",
    ".venv",
    ".venvs",
    ".tox",
    ".boot-linux",
    ".gcloud",
    ".runtime",
    ".pytest_cache",
    ".mypy_cache",
    ".ruff_cache",
    "node_modules",
    "__pycache__",
    "build",
    "dist",
    "tmp",
    "projects",
)
SUMMARY_FILES = 20
# ---- end of fixed values ----------------------------------------------------


# -- pre-flight ---------------------------------------------------------------
def cheap_status(limits: Limits) -> Column:
    """Status from name and size alone; null when the content must decide."""
    bad_extension = ~paths.extension(F.col("relative_path")).isin(list(limits.extensions))
    too_large = F.col("size_bytes") > limits.max_file_bytes
    return F.when(bad_extension, "ext_not_allowed").when(too_large, "file_too_large")


def _detail(limits: Limits) -> Column:
    return (
        F.when(
            F.col("preflight") == "ext_not_allowed",
            F.format_string("extension '%s' is not allowed", paths.extension(F.col("relative_path"))),
        )
        .when(
            F.col("preflight") == "file_too_large",
            F.format_string(f"%d bytes, the cap is {limits.max_file_bytes}", F.col("size_bytes")),
        )
        .when(
            F.col("preflight") == "not_text",
            F.lit(f"NUL byte in the first {limits.probe_bytes} bytes"),
        )
    )


def preflight(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add preflight, reject_detail and toggleable; drop content.

    Files that were read block by block bring `has_nul` in place of their content.
    Otherwise two branches, so a file that its name or size already rejects is not probed;
    the size test stands alone to reach the scan, which then skips large files.
    """
    plain = [c for c in files.columns if c != "content"]
    named = cheap_status(limits)
    if "has_nul" in files.columns:
        probed = F.when(F.col("has_nul"), "not_text").otherwise("ok")
        return (
            files.withColumn("preflight", F.coalesce(named, probed))
            .withColumn("reject_detail", _detail(limits))
            .withColumn("toggleable", F.col("preflight") == "ok")
        )
    rejected = files.select(*plain).withColumn("preflight", named).filter("preflight IS NOT NULL")
    probed = (
        files.filter(F.col("size_bytes") <= limits.max_file_bytes)
        .filter(named.isNull())
        .withColumn(
            "preflight",
            F.when(text.has_nul(F.col("content"), limits.probe_bytes), "not_text").otherwise("ok"),
        )
        .select(*plain, "preflight")
    )
    return (
        rejected.unionByName(probed)
        .withColumn("reject_detail", _detail(limits))
        .withColumn("toggleable", F.col("preflight") == "ok")
    )


def preview(checked: DataFrame) -> DataFrame:
    """Number of selectable files and of all files."""
    return checked.agg(
        F.count_if("toggleable").alias("ok_files"), F.count(F.lit(1)).alias("all_files")
    )


def send_blocked(selected: DataFrame, by: list[str], probe_bytes: int) -> DataFrame:
    """Per selection: does any chosen file fail the content probe?"""
    return (
        selected.withColumn("_nul", text.has_nul(F.col("content"), probe_bytes))
        .groupBy(*by)
        .agg(F.bool_or("_nul").alias("blocked"), F.count_if("_nul").alias("nul_files"))
    )


# -- several roots ------------------------------------------------------------
def from_file_root(files: DataFrame) -> Column:
    """True for a root that is itself a file; false where nothing says so."""
    return F.col("root_is_file") if "root_is_file" in files.columns else F.lit(False)


def absolute_path(files: DataFrame) -> Column:
    below = F.concat_ws("/", F.col("root"), F.col("relative_path"))
    return F.when(from_file_root(files), F.col("root")).otherwise(below)


def overlapping_roots(roots: Sequence[str]) -> list[str]:
    """Roots that hold, lie in or repeat another root of the same scan."""
    tops = [r.rstrip("/") for r in roots]
    return sorted(
        {
            a
            for i, a in enumerate(tops)
            for j, b in enumerate(tops)
            if i != j and (a == b or a.startswith(b + "/") or b.startswith(a + "/"))
        }
    )


def first_root_wins(files: DataFrame, roots: Sequence[str] | None = None) -> DataFrame:
    """Drop a file already listed under an earlier root.

    An aggregate with map-side combine, so copies of one path never meet in a
    single task before they are reduced.  `roots` is the list given to the scan;
    only files of roots that overlap are compared then, the others pass.
    """
    rest = [c for c in files.columns if c not in ("root_ord", "root", "relative_path")]
    named = files.withColumn("absolute_path", absolute_path(files))
    shared = None if roots is None else overlapping_roots(roots)
    compared = named if shared is None else named.filter(F.col("root").isin(shared))
    row = F.struct("root_ord", "root", "relative_path", *rest)
    kept = (
        compared.groupBy("absolute_path")
        .agg(F.min_by(row, F.struct("root_ord", "root")).alias("_row"))
        .select("absolute_path", "_row.*")
    )
    if shared is None:
        return kept
    alone = named.select("absolute_path", "root_ord", "root", "relative_path", *rest)
    if not shared:
        return alone
    return kept.unionByName(alone.filter(~F.col("root").isin(shared)))


# -- folders ------------------------------------------------------------------
_COUNTS = ("descendant_files", "selectable_files")


def _counted() -> dict[str, Column]:
    return dict(zip(_COUNTS, (F.lit(1).cast("long"), F.col("toggleable").cast("long"))))


def folder_rollup(
    checked: DataFrame,
    directories: DataFrame | None = None,
    consistent_counts: bool = False,
    roots: Sequence[str] | None = None,
) -> DataFrame:
    """Recursive file counts of every folder, the root included.

    A root that is a file has no folder.  Other roots count their files after
    files of earlier roots were dropped, folders below them before;
    `consistent_counts` drops them everywhere.  `directories` (root, root_ord,
    folder) adds folders that hold no file.  With `roots`, the list given to the
    scan, roots that cannot overlap are counted in one pass.
    """
    narrow = checked.select(
        "root", "root_ord", "relative_path", "toggleable", from_file_root(checked).alias("root_is_file")
    )
    keys = ["root", "root_ord"]
    disjoint = roots is not None and not overlapping_roots(roots)
    kept = narrow if disjoint else first_root_wins(narrow, roots).drop("absolute_path")
    trees, kept = narrow.filter("NOT root_is_file"), kept.filter("NOT root_is_file")
    if consistent_counts or disjoint:
        rolled = spread.ancestors_with_counts(kept, keys, "relative_path", _counted())
    else:
        nested = spread.ancestors_with_counts(trees, keys, "relative_path", _counted())
        tops = kept.groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in _counted().items()])
        every_root = nested.filter("folder = ''").select(*keys)
        rolled = nested.filter("folder <> ''").unionByName(
            every_root.join(tops, keys, "left")
            .withColumn("folder", F.lit(""))
            .na.fill(0, list(_COUNTS))
        )
    if directories is not None:
        empty = directories.select(*keys, "folder").distinct()
        rolled = rolled.join(empty, [*keys, "folder"], "full_outer").na.fill(0, list(_COUNTS))
    return rolled.withColumns(
        {
            "toggleable": F.col("selectable_files") > 0,
            "depth": paths.depth(F.col("folder")),
            "relative_path": F.when(F.col("folder") == "", paths.base_name(F.col("root"))).otherwise(
                F.col("folder")
            ),
        }
    )


def tree(checked: DataFrame, folders: DataFrame) -> DataFrame:
    """Files and folders as one table with kind and the pre-order sort key.

    Sort by (root_ord, tree_key) for display; the key itself carries the order,
    so no rank over the whole table is needed.
    """
    file_rows = checked.select(
        "root",
        "root_ord",
        F.lit("file").alias("kind"),
        "relative_path",
        "size_bytes",
        "toggleable",
        F.when(from_file_root(checked), F.lit(0)).otherwise(paths.depth(F.col("relative_path"))).alias("depth"),
        paths.tree_key(F.col("relative_path"), F.lit(False)).alias("tree_key"),
    )
    folder_rows = folders.select(
        "root",
        "root_ord",
        F.lit("folder").alias("kind"),
        "relative_path",
        F.lit(None).cast("long").alias("size_bytes"),
        "toggleable",
        "depth",
        paths.tree_key(F.col("folder"), F.lit(True)).alias("tree_key"),
    )
    return folder_rows.unionByName(file_rows)


def in_tree_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy("root_ord", "tree_key")


# -- scope scan ---------------------------------------------------------------
def scope_counts(files: DataFrame, suffixes: tuple[str, ...] = (".log",)) -> DataFrame:
    """Root with its recursive total, then each folder with its direct count.

    Folders under a skipped directory are never entered.  The root's own direct
    count is not listed; a root without a match gives no row.
    """
    folder = paths.parent(F.col("relative_path"))
    name = F.lower(paths.base_name(F.col("relative_path")))
    skipped = F.arrays_overlap(
        F.split(folder, "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRECTORIES])
    )
    matches = F.lit(False)
    for suffix in suffixes:
        matches = matches | name.endswith(suffix)
    direct = (
        files.filter(matches & ~skipped)
        .groupBy("root", folder.alias("folder"))
        .agg(F.count(F.lit(1)).alias("files"))
    )
    total = direct.groupBy("root").agg(F.sum("files").alias("files"))
    return (
        total.withColumn("folder", F.lit(""))
        .unionByName(direct.filter("folder <> ''"))
        .withColumn("is_root", F.col("folder") == "")
    )


def scope_labels(scopes: DataFrame) -> DataFrame:
    """One label per folder and count over all roots, the first root's kept."""
    path = F.when(F.col("folder") == "", F.col("root")).otherwise(
        F.concat_ws("/", F.col("root"), F.col("folder"))
    )
    label = F.format_string("%s (%d)", path, F.col("files"))
    return (
        scopes.withColumn("label", label)
        .groupBy("label")
        .agg(F.min_by(path, F.struct("root_ord", "folder")).alias("path"), F.min("root_ord").alias("root_ord"))
    )


# -- trailing windows ---------------------------------------------------------
def window_counts(checked: DataFrame, now_epoch: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Selectable files per trailing window, all windows in one pass; per key where keys are named."""
    counts = checked.filter("toggleable").groupBy(*keys).agg(
        *[
            F.count_if(F.lit(True) if secs is None else F.col("mtime") >= now_epoch - secs).alias(key)
            for key, secs in text.WINDOWS
        ]
    )
    pairs = ", ".join(f"'{key}', `{key}`" for key, _ in text.WINDOWS)
    return counts.select(*keys, F.expr(f"stack({len(text.WINDOWS)}, {pairs}) AS (window_key, files)"))


def in_window(checked: DataFrame, window_key: str | None, now_epoch: Column) -> DataFrame:
    """Files no older than the named window; 'all' and unset keep everything.

    Folder rows follow from folder_rollup over the result: a folder without a
    file left gets no row, and counts are recomputed.
    """
    seconds = text.window_seconds(window_key)
    if seconds is None:
        return checked
    return checked.filter(F.col("mtime") >= now_epoch - seconds)


# -- selections ---------------------------------------------------------------
def _chosen_paths(chosen: DataFrame) -> DataFrame:
    whole = F.when(F.col("relative_path") == "", F.col("root")).otherwise(absolute_path(chosen))
    return chosen.select(whole.alias("absolute_path"))


def expand_selection(
    checked: DataFrame,
    folders: DataFrame,
    files: DataFrame,
    roots: Sequence[str] | None = None,
) -> DataFrame:
    """Selectable files chosen by name or lying below a chosen folder.

    `folders` and `files` have (root, relative_path); a folder of '' is the
    root.  Absolute paths decide, so a choice made under one root also finds a
    file that an earlier root listed.  Each file appears once however often it
    was chosen.  Directories are taken from the unfiltered table, so finding the
    chosen ones reads no content.
    """
    listed = first_root_wins(checked.filter("toggleable"), roots)
    everywhere = checked.select(absolute_path(checked).alias("absolute_path"))
    by_folder = spread.covered(
        listed, "absolute_path", _chosen_paths(folders), [], "_below", directories_of=everywhere
    )
    both = spread.spread_flag(by_folder, _chosen_paths(files), ["absolute_path"], "_named")
    return both.filter("_below OR _named").drop("_below", "_named")


def select_by_list(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Selectable tree entries whose full path or last name is listed.

    `wanted` has one column, `entry`.  Two flag joins instead of one join on an
    OR; a last name shared by most files is a skewed key, which the join splits.
    """
    base = entries.filter("toggleable").withColumn("_short", paths.base_name(F.col("relative_path")))
    by_path = spread.spread_flag(
        base, wanted.select(F.col("entry").alias("relative_path")), ["relative_path"], "_path"
    )
    by_name = spread.spread_flag(by_path, wanted.select(F.col("entry").alias("_short")), ["_short"], "_name")
    return by_name.filter("_path OR _name").drop("_path", "_name", "_short")


def common_root(selected: DataFrame, by: list[str]) -> DataFrame:
    """Deepest directory that holds every selected file.

    Any component all paths share is shared by the smallest and the largest
    directory, so two aggregates replace a set of all directories.
    """
    folder = F.split(paths.parent(absolute_path(selected)), "/")
    ends = selected.groupBy(*by).agg(F.min(folder).alias("_lo"), F.max(folder).alias("_hi"))
    shared = F.aggregate(
        F.zip_with("_lo", "_hi", lambda a, b: a.eqNullSafe(b)),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, same: F.struct(
            (acc["n"] + F.when(acc["on"] & same, 1).otherwise(0)).alias("n"),
            (acc["on"] & same).alias("on"),
        ),
        lambda acc: acc["n"],
    )
    return ends.select(*by, F.array_join(F.slice("_lo", 1, shared), "/").alias("source_root"))


# -- summaries ----------------------------------------------------------------
def archive_totals(selected: DataFrame, by: list[str]) -> DataFrame:
    """Bytes, size text, file count and how many files the preview leaves out."""
    return (
        selected.groupBy(*by)
        .agg(F.sum("size_bytes").alias("total_bytes"), F.count(F.lit(1)).alias("n_files"))
        .withColumn("size_text", text.human_size(F.col("total_bytes")))
        .withColumn("more_files", F.greatest(F.col("n_files") - SUMMARY_FILES, F.lit(0)))
    )


def archive_preview(selected: DataFrame, by: list[str], order: str) -> DataFrame:
    """First files of each selection; the rank limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return (
        selected.withColumn("line_no", rank)
        .filter(F.col("line_no") <= SUMMARY_FILES)
        .withColumn("size_text", text.human_size(F.col("size_bytes")))
    )


def first_files(selected: DataFrame, order: str, count: int = SUMMARY_FILES) -> DataFrame:
    return selected.orderBy(order).limit(count)


def numbered(entries: DataFrame, order: SlicedOrder) -> DataFrame:
    """Position of each entry in its group, for listings of any length."""
    return order.position(entries)
