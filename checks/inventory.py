"""Queries over file inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import register
from stowage.functions import globs, paths, text
from stowage.operators import inventory


def _checked(spark, sf):
    return inventory.preflight(V.files(spark, sf), V.FILE_LIMITS)


def _two_roots(spark, sf):
    return V.two_roots(_checked(spark, sf))


CHECKED = ("files", "checked")
EVENTS_NOW = 1706572800


@register(
    "preflight_status",
    V.with_views("SELECT doc_id, relative_path, size_bytes, preflight, toggleable FROM checked", *CHECKED),
)
def preflight_status(spark, sf):
    """Extension, size and content checks of every file before it is offered."""
    return _checked(spark, sf).select("doc_id", "relative_path", "size_bytes", "preflight", "toggleable")


@register(
    "preview_counts",
    V.with_views(
        "SELECT CAST(count(*) FILTER (toggleable) AS BIGINT) AS ok_files, count(*) AS all_files FROM checked", *CHECKED
    ),
)
def preview_counts(spark, sf):
    return inventory.preview(_checked(spark, sf))


@register(
    "send_blocked",
    V.with_views(
        """SELECT source, lang, bool_or(strpos(content, chr(0)) BETWEEN 1 AND 8192) AS blocked,
  CAST(count(*) FILTER (strpos(content, chr(0)) BETWEEN 1 AND 8192) AS BIGINT) AS nul_files
FROM files GROUP BY source, lang""",
        "files",
    ),
)
def send_blocked(spark, sf):
    """Does a selection hold a file that must stop the send?"""
    return inventory.send_blocked(V.files(spark, sf), ["source", "lang"], V.FILE_LIMITS.probe_bytes)


@register(
    "cross_root_dedupe",
    V.with_views(
        """SELECT absolute_path, root, relative_path, preflight FROM (
  SELECT *, root || '/' || relative_path AS absolute_path, row_number() OVER (PARTITION BY root || '/' || relative_path ORDER BY root_ord) AS rn
  FROM (SELECT root_ord, root, relative_path, preflight FROM checked UNION ALL
        SELECT 1, '/data/src3', substr(relative_path, 6), preflight FROM checked WHERE source = 'src3')) WHERE rn = 1""",
        *CHECKED,
    ),
)
def cross_root_dedupe(spark, sf):
    """A file under two roots belongs to the first."""
    return inventory.first_root_wins(_two_roots(spark, sf)).select(
        "absolute_path", "root", "relative_path", "preflight"
    )


_ROLLUP = """
SELECT root, root_ord, CASE WHEN folder = '' THEN regexp_extract(root, '[^/]*$') ELSE folder END AS relative_path,
  descendant_files, selectable_files, selectable_files > 0 AS toggleable,
  CAST(CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END AS INTEGER) AS depth"""


@register(
    "folder_rollup",
    V.with_views(
        _ROLLUP
        + """ FROM (SELECT root, root_ord, folder, count(*) AS descendant_files,
  CAST(count(*) FILTER (toggleable) AS BIGINT) AS selectable_files FROM file_folders GROUP BY ALL)""",
        *CHECKED,
        "file_folders",
    ),
)
def folder_rollup(spark, sf):
    """Recursive and selectable file counts of every folder."""
    return inventory.folder_rollup(_checked(spark, sf), roots=["/data"]).drop("folder")


@register(
    "folder_rollup_two_roots",
    V.with_views(
        _ROLLUP
        + """ FROM (
  SELECT root, root_ord, folder, count(*) AS descendant_files, CAST(count(*) FILTER (toggleable) AS BIGINT) AS selectable_files
  FROM (SELECT r.root, r.root_ord, r.toggleable, array_to_string(string_split(r.relative_path, '/')[1:k], '/') AS folder
        FROM rooted r, unnest(range(1, len(string_split(r.relative_path, '/')))) AS u(k)) GROUP BY ALL
  UNION ALL SELECT '/data', 0, '', count(*), CAST(count(*) FILTER (toggleable) AS BIGINT) FROM checked
  UNION ALL SELECT '/data/src3', 1, '', 0, 0 WHERE EXISTS (SELECT 1 FROM checked WHERE source = 'src3'))""",
        *CHECKED,
        "rooted",
    ),
)
def folder_rollup_two_roots(spark, sf):
    """Overlapping roots: a later root counts only files not yet listed."""
    return inventory.folder_rollup(_two_roots(spark, sf), roots=["/data", "/data/src3"]).drop("folder")


@register(
    "tree_folder_sizes",
    V.with_views(
        """SELECT folder, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM (
  SELECT size_bytes, array_to_string(string_split(path, '/')[1:k], '/') AS folder
  FROM page_files, unnest(range(0, len(string_split(path, '/')))) AS u(k)) GROUP BY folder""",
        "page_files",
    ),
)
def tree_folder_sizes(spark, sf):
    """Files and bytes below every folder of the page tree."""
    from stowage.plans.spread import ancestors_with_counts

    return ancestors_with_counts(
        V.page_files(spark, sf), [], "path", {"files": F.lit(1).cast("long"), "size_bytes": F.col("size_bytes")}
    )


_SKIP = ", ".join(f"'{d}'" for d in inventory.SKIPPED_DIRECTORIES)
_SCOPED = f"""
SELECT root, folder, count(*) AS files FROM (
  SELECT '/srv' AS root, regexp_replace('/' || path, '/[^/]*$', '')[2:] AS folder, lower(regexp_extract(path, '[^/]*$')) AS name
  FROM (SELECT CASE page_id % 5 WHEN 0 THEN 'build/' ELSE '' END || path AS path FROM page_files))
WHERE name LIKE '%.log' AND NOT list_has_any(string_split(folder, '/'), [{_SKIP}]) GROUP BY ALL"""


def _scoped_pages(spark, sf):
    pages = V.page_files(spark, sf)
    prefix = F.expr("CASE page_id % 5 WHEN 0 THEN 'build/' ELSE '' END")
    return pages.select(F.lit("/srv").alias("root"), F.concat(prefix, "path").alias("relative_path"))


@register(
    "scope_counts",
    V.with_views(
        f"""SELECT root, '' AS folder, CAST(sum(files) AS BIGINT) AS files, true AS is_root FROM ({_SCOPED}) GROUP BY root
UNION ALL SELECT root, folder, files, false FROM ({_SCOPED}) WHERE folder <> ''""",
        "page_files",
    ),
)
def scope_counts(spark, sf):
    """Root total, then direct counts per folder, junk folders left out."""
    return inventory.scope_counts(_scoped_pages(spark, sf))


@register(
    "scope_labels",
    V.with_views(
        """SELECT label, arg_min(path, root_ord) AS path, CAST(min(root_ord) AS INTEGER) AS root_ord FROM (
  SELECT path || ' (' || files || ')' AS label, path, root_ord FROM (
    SELECT 0 AS root_ord, '/data' AS path, count(*) AS files FROM checked WHERE lower(relative_path) LIKE '%.log'
    UNION ALL SELECT 0, '/data/' || source || '/' || lang, count(*) FROM checked WHERE lower(relative_path) LIKE '%.log' GROUP BY source, lang
    UNION ALL SELECT 1, '/data/src3', count(*) FROM checked WHERE lower(relative_path) LIKE '%.log' AND source = 'src3'
    UNION ALL SELECT 1, '/data/src3/' || lang, count(*) FROM checked WHERE lower(relative_path) LIKE '%.log' AND source = 'src3' GROUP BY lang))
GROUP BY label""",
        *CHECKED,
    ),
)
def scope_labels(spark, sf):
    """Scopes of several roots, each label offered once."""
    rows = V.two_roots(V.files(spark, sf)).select("root", "root_ord", "relative_path")
    scopes = inventory.scope_counts(rows).join(rows.select("root", "root_ord").distinct(), "root")
    return inventory.scope_labels(scopes)


_WINDOWS = "(VALUES " + ", ".join(f"('{k}', {s if s is not None else 'NULL'})" for k, s in text.WINDOWS) + ") AS w(window_key, secs)"


@register(
    "window_counts",
    V.with_views(
        f"""SELECT window_key, CAST(count(*) FILTER (toggleable AND (secs IS NULL OR mtime >= {V.NOW} - secs)) AS BIGINT) AS files
FROM checked, {_WINDOWS} GROUP BY window_key""",
        *CHECKED,
    ),
)
def window_counts(spark, sf):
    """Selectable files per trailing window."""
    return inventory.window_counts(_checked(spark, sf), F.lit(V.NOW))


@register(
    "window_counts_events",
    f"""SELECT user_id, {", ".join(f'CAST(count(*) FILTER ({"true" if s is None else f"epoch(ts) >= {EVENTS_NOW} - {s}"}) AS BIGINT) AS "w_{k}"' for k, s in text.WINDOWS)}
FROM events GROUP BY user_id""",
)
def window_counts_events(spark, sf):
    """The same seven windows per user over event times."""
    rows = V.table(spark, sf, "events").select(
        "user_id", F.lit(True).alias("toggleable"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("mtime")
    )
    counts = inventory.window_counts(rows, F.lit(EVENTS_NOW), ("user_id",))
    wide = [F.max(F.when(F.col("window_key") == k, F.col("files"))).alias(f"w_{k}") for k, _ in text.WINDOWS]
    return counts.groupBy("user_id").agg(*wide)


@register(
    "window_filter",
    V.with_views(
        f"""SELECT CASE WHEN folder = '' THEN 'data' ELSE folder END AS relative_path, count(*) AS descendant_files,
  CAST(count(*) FILTER (toggleable) AS BIGINT) AS selectable_files
FROM file_folders WHERE mtime >= {V.NOW} - 28800 GROUP BY folder""",
        *CHECKED,
        "file_folders",
    ),
)
def window_filter(spark, sf):
    """Folders after a trailing window: empty ones are gone, counts are new."""
    recent = inventory.in_window(_checked(spark, sf), "8H ", F.lit(V.NOW))
    return inventory.folder_rollup(recent, roots=["/data"]).select("relative_path", "descendant_files", "selectable_files")


@register(
    "window_files",
    V.with_views(
        f"SELECT relative_path, preflight, mtime FROM checked WHERE mtime >= {V.NOW} - 3600", *CHECKED
    ),
)
def window_files(spark, sf):
    """Recent files; those that cannot be selected stay listed."""
    return inventory.in_window(_checked(spark, sf), "1h", F.lit(V.NOW)).select("relative_path", "preflight", "mtime")


@register(
    "expand_selection",
    V.with_views(
        """SELECT root, relative_path FROM checked WHERE toggleable AND (
  starts_with(relative_path, 'src1/') OR starts_with(relative_path, 'src2/en/') OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
        *CHECKED,
    ),
)
def expand_selection(spark, sf):
    """Chosen folders and files become the selectable files they stand for."""
    files = V.files(spark, sf)
    checked = inventory.preflight(files, V.FILE_LIMITS)
    toxic = V.table(spark, sf, "labels").filter("toxic = 1")
    named = files.join(toxic, "doc_id", "left_semi").select("root", "relative_path")
    folders = files.filter("source = 'src1' OR (source = 'src2' AND lang = 'en')").select(
        "root", F.when(F.col("source") == "src1", "src1").otherwise("src2/en").alias("relative_path")
    )
    return inventory.expand_selection(checked, folders, named, ["/data"]).select("root", "relative_path")


@register(
    "select_by_list",
    V.with_views(
        """SELECT kind, relative_path FROM (
  SELECT 'file' AS kind, relative_path, toggleable FROM checked
  UNION ALL SELECT 'folder', CASE WHEN folder = '' THEN 'data' ELSE folder END, bool_or(toggleable) FROM file_folders GROUP BY folder)
WHERE toggleable AND (relative_path IN (SELECT source || '/' || lang FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)
  OR regexp_extract(relative_path, '[^/]*$') IN (SELECT doc_id || '.log' FROM labels WHERE quality = 1)
  OR relative_path IN (SELECT doc_id || '.log' FROM labels WHERE quality = 1)
  OR regexp_extract(relative_path, '[^/]*$') IN (SELECT source || '/' || lang FROM labels JOIN documents USING (doc_id) WHERE toxic = 1))""",
        *CHECKED,
        "file_folders",
    ),
)
def select_by_list(spark, sf):
    """Entries whose path or last name is in a list."""
    checked = _checked(spark, sf)
    entries = inventory.tree(checked, inventory.folder_rollup(checked, roots=["/data"]))
    labels = V.table(spark, sf, "labels")
    docs = V.table(spark, sf, "documents").select("doc_id", "source", "lang")
    wanted = (
        labels.filter("toxic = 1").join(docs, "doc_id").select(F.concat_ws("/", "source", "lang").alias("entry"))
    ).unionByName(labels.filter("quality = 1").select(F.expr("concat(doc_id, '.log')").alias("entry")))
    return inventory.select_by_list(entries, wanted).select("kind", "relative_path")


@register(
    "common_root",
    V.with_views(
        """SELECT selection, CASE WHEN count(DISTINCT source) > 1 THEN '/data' WHEN count(DISTINCT lang) > 1 THEN '/data/' || min(source)
  ELSE '/data/' || min(source) || '/' || min(lang) END AS source_root
FROM (SELECT *, doc_id % 313 AS selection FROM files) GROUP BY selection
UNION ALL SELECT -1, CASE WHEN count(DISTINCT source) > 1 THEN '/data' ELSE '/data/' || min(source) END FROM files""",
        "files",
    ),
)
def common_root(spark, sf):
    """Deepest directory above the files of many selections, and of all files."""
    files = V.files(spark, sf)
    dealt = files.withColumn("selection", F.expr("doc_id % 313"))
    everything = files.withColumn("selection", F.lit(-1).cast("long"))
    return inventory.common_root(dealt.unionByName(everything), ["selection"])


@register(
    "archive_totals",
    V.with_views(
        """SELECT source, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS n_files, greatest(count(*) - 20, 0) AS more_files
FROM files GROUP BY source""",
        "files",
    ),
)
def archive_totals(spark, sf):
    """Size and count of a selection, and how many files a preview leaves out."""
    return inventory.archive_totals(V.files(spark, sf), ["source"]).drop("size_text")


@register(
    "archive_preview",
    V.with_views(
        """SELECT source, CAST(line_no AS INTEGER) AS line_no, relative_path, size_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY relative_path) AS line_no FROM files) WHERE line_no <= 20""",
        "files",
    ),
)
def archive_preview(spark, sf):
    """First files of each selection."""
    return inventory.archive_preview(V.files(spark, sf), ["source"], "relative_path").select(
        "source", "line_no", "relative_path", "size_bytes"
    )


@register(
    "first_files",
    V.with_views("SELECT relative_path, size_bytes FROM files ORDER BY relative_path LIMIT 20", "files"),
)
def first_files(spark, sf):
    return inventory.first_files(V.files(spark, sf), "relative_path").select("relative_path", "size_bytes")


@register(
    "human_sizes",
    """SELECT l_orderkey, l_partkey, l_linenumber, size_bytes, CASE WHEN kib < 1024 THEN printf('%.1f KiB', kib) ELSE printf('%.1f MiB', kib / 1024.0) END AS size_text
FROM (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_extendedprice AS BIGINT) * 16 + 1 AS size_bytes, (CAST(l_extendedprice AS BIGINT) * 16 + 1) / 1024.0 AS kib FROM (SELECT l_orderkey, l_partkey, l_linenumber, floor(l_extendedprice) AS l_extendedprice FROM lineitem))""",
)
def human_sizes(spark, sf):
    """Sizes as text with one decimal."""
    size = F.floor("l_extendedprice").cast("long") * 16 + 1
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", size.alias("size_bytes"), text.human_size(size).alias("size_text")
    )


@register(
    "preorder_tree",
    V.with_views(
        """SELECT kind, relative_path, replace(tree_key, chr(1), '|') AS tree_key FROM (
  SELECT 'file' AS kind, relative_path,
    (SELECT string_agg(CASE WHEN i = n THEN '0' ELSE '1' END || p, chr(1) ORDER BY i)
     FROM (SELECT unnest(string_split(relative_path, '/')) AS p, generate_subscripts(string_split(relative_path, '/'), 1) AS i, len(string_split(relative_path, '/')) AS n)) AS tree_key
  FROM checked
  UNION ALL
  SELECT 'folder', CASE WHEN folder = '' THEN 'data' ELSE folder END,
    CASE WHEN folder = '' THEN '' ELSE '1' || replace(folder, '/', chr(1) || '1') END
  FROM (SELECT DISTINCT folder FROM file_folders))""",
        *CHECKED,
        "file_folders",
    ),
)
def preorder_tree(spark, sf):
    """Folder, its files, then its sub-folders, by one sort key."""
    checked = _checked(spark, sf)
    entries = inventory.tree(checked, inventory.folder_rollup(checked, roots=["/data"]))
    return inventory.in_tree_order(entries).select(
        "kind", "relative_path", F.replace("tree_key", F.lit("\u0001"), F.lit("|")).alias("tree_key")
    )


@register(
    "numbered_listing",
    V.with_views(
        "SELECT source, relative_path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_no FROM files", "files"
    ),
)
def numbered_listing(spark, sf):
    """Line numbers of a listing, in slices of each group."""
    from stowage.plans.sliced import SlicedOrder, by_number

    order = SlicedOrder(("source",), by_number("doc_id", 100), ("doc_id",))
    return inventory.numbered(V.files(spark, sf), order).select(
        "source", "relative_path", F.col("position").alias("line_no")
    )


_EXCLUDED = """regexp_matches(path, '(^|/)(\\.git|__pycache__|\\.pytest_cache|\\.coverage|htmlcov|\\.python-version|\\.DS_Store|Thumbs\\.db|\\.Spotlight-V100|\\.Trashes|\\.fseventsd|\\.vscode|\\.idea|\\.project|\\.settings)(/|$)')
  OR regexp_matches(path, '\\.(pyc|pyo|pyd|log|zip|tar|gz|bz2|xz|zst|db|sqlite|sqlite3)(/|$)') OR regexp_matches(path, '/postfix/spool/')"""


@register(
    "exclusion_filter",
    V.with_views(f"SELECT page_id, path, {_EXCLUDED} AS excluded FROM page_files", "page_files"),
)
def exclusion_filter(spark, sf):
    """Default exclusion globs over a tree."""
    return V.page_files(spark, sf).select("page_id", "path", globs.excluded(F.col("path")).alias("excluded"))


_NORM = "array_to_string(list_filter(string_split(name, '/'), lambda p: p NOT IN ('', '.')), '/')"


@register(
    "normalised_paths",
    V.with_views(
        f"""SELECT bundle_id, member_idx, relative_path, regexp_extract(relative_path, '[^/]*$') AS base,
  lower(regexp_extract(regexp_extract(relative_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS ext,
  CAST(len(string_split(relative_path, '/')) AS INTEGER) AS depth, name LIKE '../%' OR name LIKE '%/../../%' AS escapes
FROM (SELECT *, {_NORM} AS relative_path FROM members)""",
        "members",
    ),
)
def normalised_paths(spark, sf):
    """Normal form, base name, suffix, depth and escape test of member names."""
    clean = V.members(spark, sf).withColumn("relative_path", paths.normalise(F.col("name")))
    rel = F.col("relative_path")
    return clean.select(
        "bundle_id",
        "member_idx",
        "relative_path",
        paths.base_name(rel).alias("base"),
        paths.extension(rel).alias("ext"),
        paths.depth(rel).alias("depth"),
        paths.escapes_root(F.col("name")).alias("escapes"),
    )


@register(
    "illegal_names",
    """SELECT doc_id, regexp_matches(name, '[\\x00-\\x1f\\x7f]') AS illegal
FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN text || chr(9) ELSE replace(text, chr(10), ' ') END AS name FROM documents)""",
)
def illegal_names(spark, sf):
    """Names with control characters."""
    one_line = F.replace("text", F.lit("\n"), F.lit(" "))
    name = F.when(V.hit("doc_id", 6), F.concat(F.col("text"), F.lit("\t"))).otherwise(one_line)
    return V.table(spark, sf, "documents").select("doc_id", paths.illegal_name(name).alias("illegal"))


@register(
    "extension_lists",
    """SELECT p_partkey, (SELECT coalesce(string_agg(DISTINCT CASE WHEN starts_with(e, '.') THEN e ELSE '.' || e END, ',' ORDER BY CASE WHEN starts_with(e, '.') THEN e ELSE '.' || e END), '')
  FROM (SELECT lower(trim(x)) AS e FROM (SELECT unnest(string_split(raw, ',')) AS x)) WHERE e <> '') AS extensions
FROM (SELECT p_partkey, p_type || ', .' || p_brand || ' ,,' || lower(p_type) || ', ' || p_size AS raw FROM part)""",
)
def extension_lists(spark, sf):
    """Comma-separated extension text as a clean set."""
    raw = F.expr("concat(p_type, ', .', p_brand, ' ,,', lower(p_type), ', ', p_size)")
    return V.table(spark, sf, "part").select(
        "p_partkey", F.array_join(paths.clean_extension_list(raw), ",").alias("extensions")
    )


@register(
    "window_keys",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1h' WHEN 1 THEN '15m' WHEN 2 THEN NULL ELSE 'all' END AS window_key FROM events""",
)
def window_keys(spark, sf):
    """Window names as typed, cleaned."""
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN ' 1H ' WHEN 1 THEN '15m' WHEN 2 THEN '  ' ELSE 'ALL' END")
    return V.table(spark, sf, "events").select("event_id", text.clean_window_key(raw).alias("window_key"))


@register(
    "dated_paths",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_text, 'u' || user_id || '/' || strftime(ts, '%Y/%m/%d') || '/e' || event_id AS path FROM events""",
)
def dated_paths(spark, sf):
    """Second-precision time text and the dated folder of each bundle."""
    ts = F.col("ts").cast("timestamp")
    return V.table(spark, sf, "events").select(
        "event_id",
        text.utc_text(ts).alias("ts_text"),
        F.concat_ws(
            "/", F.expr("concat('u', user_id)"), *text.date_parts(ts), F.expr("concat('e', event_id)")
        ).alias("path"),
    )


@register(
    "sender_id_format",
    """SELECT c_custkey, sender_id, regexp_matches(sender_id, '^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$') AS valid FROM (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_') WHEN 2 THEN '-' || c_mktsegment ELSE repeat(c_mktsegment, 8) END AS sender_id FROM customer)""",
)
def sender_id_format(spark, sf):
    """Sender ids that have the required form."""
    sender = F.expr(
        "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_') "
        "WHEN 2 THEN concat('-', c_mktsegment) ELSE repeat(c_mktsegment, 8) END"
    )
    return V.table(spark, sf, "customer").select("c_custkey", sender.alias("sender_id")).withColumn(
        "valid", text.valid_sender_id(F.col("sender_id"))
    )
