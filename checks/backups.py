"""Queries over backup catalogs, restores and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import register
from stowage.operators import catalog, restore
from stowage.session import through_table
from stowage.sources import listing

@register(
    "retention_delete",
    V.with_views(
        """SELECT location, name, newest_rank, newest_rank > 5 AS "delete" FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY modified_time DESC, name DESC) AS newest_rank FROM backups
  WHERE regexp_matches(name, '^[^.]+\\.tar\\.zst$'))""",
        "backups",
    ),
)
def retention_delete(spark, sf):
    """Keep the newest five archives of each location; dotted names are not touched."""
    kept = catalog.retention(V.backups(spark, sf))
    return kept.select("location", "name", "newest_rank", "delete")


@register(
    "retention_dotted",
    V.with_views(
        """SELECT location, name, newest_rank > 3 AS "delete" FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY modified_time DESC, name DESC) AS newest_rank FROM backups WHERE name LIKE '%.tar.zst')""",
        "backups",
    ),
)
def retention_dotted(spark, sf):
    """The same over every archive name, keeping three."""
    kept = catalog.retention(V.backups(spark, sf), keep=3, dotted=True)
    return kept.select("location", "name", "delete")


@register(
    "latest_backup",
    V.with_views(
        """SELECT location, name, CAST(modified_time AS VARCHAR) AS modified_time FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY modified_time DESC, name DESC) AS rn
  FROM backups WHERE name LIKE '%.tar.zst') WHERE rn = 1""",
        "backups",
    ),
)
def latest_backup(spark, sf):
    newest = catalog.latest(V.backups(spark, sf), ["location"])
    return newest.withColumn("modified_time", F.col("modified_time").cast("string"))


@register(
    "find_by_name",
    V.with_views(
        """SELECT location, name FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY modified_time DESC, name DESC) AS rn
  FROM backups WHERE name LIKE '%v1.%.tar.zst') WHERE rn = 1""",
        "backups",
    ),
)
def find_by_name(spark, sf):
    """Newest archive of each location whose name holds a pattern."""
    return catalog.latest_matching(V.backups(spark, sf), F.lit("v1."), ["location"]).select("location", "name")


@register(
    "find_by_name_glob",
    V.with_views(
        """SELECT location, name FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY modified_time DESC, name DESC) AS rn
  FROM backups WHERE regexp_full_match(name, '.*up-[12].*7.*\\.tar\\.zst')) WHERE rn = 1""",
        "backups",
    ),
)
def find_by_name_glob(spark, sf):
    """The same with wildcards in the pattern."""
    return catalog.latest_matching(V.backups(spark, sf), "up-[12]*7", ["location"]).select("location", "name")


@register(
    "latest_by_priority",
    V.with_views(
        """SELECT owner, location, name FROM (
  SELECT *, row_number() OVER (PARTITION BY owner ORDER BY priority, modified_time DESC, name DESC) AS rn FROM (
    SELECT location AS owner, 'L' || (id % 6) AS location, CASE id % 6 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 0 WHEN 4 THEN 4 ELSE 2 END AS priority, name, modified_time
    FROM backups WHERE name LIKE '%.tar.zst')) WHERE rn = 1""",
        "backups",
    ),
)
def latest_by_priority(spark, sf):
    """First location with any backup wins, then the newest inside it."""
    backups = V.backups(spark, sf).select(
        F.col("location").alias("owner"), F.expr("concat('L', id % 6)").alias("location"), "name", "modified_time"
    )
    places = backups.select("location").distinct().withColumn(
        "priority", F.expr("CASE location WHEN 'L0' THEN 5 WHEN 'L1' THEN 1 WHEN 'L2' THEN 3 WHEN 'L3' THEN 0 WHEN 'L4' THEN 4 ELSE 2 END")
    )
    return catalog.latest_by_priority(backups, places, ["owner"])


_NTH = """SELECT location, id, name FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY modified_time DESC, name DESC) AS rn FROM backups) WHERE rn = {n}"""


@register("nth_backup", V.with_views(_NTH.format(n=3), "backups"))
def nth_backup(spark, sf):
    """Two steps back from the newest."""
    return catalog.nth_newest(V.backups(spark, sf), ("location",), 2).select("location", "id", "name")


@register("nth_backup_beyond", V.with_views(_NTH.format(n=21), "backups"))
def nth_backup_beyond(spark, sf):
    """Twenty steps back; most locations have no such backup."""
    return catalog.nth_newest(V.backups(spark, sf), ("location",), 20).select("location", "id", "name")


@register(
    "revision_labels",
    V.with_views(
        """SELECT location, id, revision, CASE WHEN revision = 0 THEN 'Latest' ELSE 'Rev ~' || revision END AS label, CASE WHEN keep_forever THEN '[kept]' ELSE '' END AS marker
FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY modified_time DESC, id DESC) - 1 AS revision FROM backups)""",
        "backups",
    ),
)
def revision_labels(spark, sf):
    """Revisions from the newest, with labels and the kept mark."""
    rows = catalog.revision_labels(V.backups(spark, sf), ("location",))
    return rows.select("location", "id", "revision", "label", "marker")


_REVISIONS = """SELECT location, id, revision, CASE WHEN revision = 0 THEN 'Latest' ELSE 'Rev ~' || revision END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY {order}) - 1 AS revision
  FROM (SELECT * REPLACE (CASE WHEN id % 13 <> 0 THEN modified_time END AS modified_time) FROM backups))"""


def _blank_times(spark, sf):
    return V.backups(spark, sf).withColumn("modified_time", F.expr("CASE WHEN id % 13 <> 0 THEN modified_time END"))


@register("revision_blank_times", V.with_views(_REVISIONS.format(order="modified_time DESC NULLS LAST, id DESC"), "backups"))
def revision_blank_times(spark, sf):
    """Revisions by time where some have none: those are the oldest."""
    rows = catalog.revision_labels(_blank_times(spark, sf), ("location",))
    return rows.select("location", "id", "revision", "label")


@register("revision_listed", V.with_views(_REVISIONS.format(order="id DESC"), "backups"))
def revision_listed(spark, sf):
    """Revisions by their place in the listing, whatever their times."""
    rows = catalog.revision_labels(_blank_times(spark, sf), ("location",), listed="id")
    return rows.select("location", "id", "revision", "label")


@register(
    "local_listing",
    V.with_views("SELECT location, name, size_bytes FROM backups WHERE name LIKE '%.tar.zst'", "backups"),
)
def local_listing(spark, sf):
    """Archives, newest first."""
    found = V.backups(spark, sf).filter(catalog.is_archive(F.col("name")))
    return catalog.newest_listing(found).select("location", "name", "size_bytes")


@register(
    "listed_files",
    V.with_views(
        """SELECT root, root_ord, path = root AS root_is_file, CASE WHEN path = root THEN regexp_extract(path, '[^/]*$') ELSE substr(path, length(root) + 2) END AS relative_path,
  size_bytes, mtime FROM listing WHERE kind = 'file' AND (path = root OR starts_with(path, root || '/'))""",
        "listing",
    ),
)
def listed_files(spark, sf):
    """Files of a listing, hidden and empty ones too; links and entries outside their root are not."""
    return listing.from_listing(V.listing(spark, sf))


@register(
    "listed_folders",
    V.with_views(
        "SELECT root, root_ord, substr(path, length(root) + 2) AS folder FROM listing WHERE kind = 'dir' AND starts_with(path, root || '/')",
        "listing",
    ),
)
def listed_folders(spark, sf):
    """Folders of a listing, below their root."""
    return listing.directories(V.listing(spark, sf))


@register(
    "listed_backups",
    V.with_views(
        """SELECT root AS location, substr(path, length(root) + 2) AS name, CAST(mtime AS BIGINT) AS modified, size_bytes FROM listing
WHERE kind = 'file' AND regexp_full_match(path, '/(data|more)/[^/]*\\.tar\\.zst') AND path <> root""",
        "listing",
    ),
)
def listed_backups(spark, sf):
    """Archives directly in a directory, newest first, hidden and empty ones too."""
    found = catalog.newest_listing(listing.backups_in(V.listing(spark, sf)))
    return found.select("location", "name", F.unix_seconds("modified_time").alias("modified"), "size_bytes")


@register(
    "remote_listing",
    """SELECT 'd' || p_partkey AS id, name, size_bytes FROM (
  SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'site-backup.tar.zst' ELSE replace(p_name, ' ', '-') || CASE WHEN p_size % 3 = 1 THEN '-site-backup.tar.zst.old' ELSE '' END END AS name,
    CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1000 END AS size_bytes, p_type, p_brand FROM part)
WHERE contains(name, 'site-backup.tar.zst') AND p_type <> 'PROMO' AND p_brand = 'Brand#2'""",
)
def remote_listing(spark, sf):
    """Catalog entries by name, trash mark and folder; blank sizes read as null."""
    name = F.expr(
        "CASE WHEN p_size % 3 = 0 THEN 'site-backup.tar.zst' ELSE concat(replace(p_name, ' ', '-'), "
        "CASE WHEN p_size % 3 = 1 THEN '-site-backup.tar.zst.old' ELSE '' END) END"
    )
    raw = V.table(spark, sf, "part").select(
        F.expr("concat('d', p_partkey)").alias("id"),
        name.alias("name"),
        F.lit("2026-04-19T08:12:00Z").alias("modifiedTime"),
        F.expr("CASE WHEN p_size % 10 = 0 THEN '' ELSE cast(p_size * 1000 as string) END").alias("size"),
        (F.col("p_type") == "PROMO").alias("trashed"),
        F.col("p_brand").alias("parent"),
    )
    return listing.remote_backups(listing.read_catalog(raw), "site-backup.tar.zst", "Brand#2").select("id", "name", "size_bytes")


@register(
    "catalog_upsert",
    """WITH old AS (SELECT 'o' || o_orderkey AS id, 'n' || (o_orderkey % 9000) AS name, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders),
new AS (SELECT 'n' || (c_custkey * 7) AS name, CAST(c_custkey + 10000000 AS BIGINT) AS size_bytes, 'x' || c_custkey AS new_id FROM customer),
t AS (SELECT n.name, n.size_bytes, coalesce(l.id, n.new_id) AS id, CASE WHEN l.id IS NULL THEN 'create' ELSE 'update' END AS action
  FROM new n LEFT JOIN (SELECT name, min(id) AS id FROM old GROUP BY name) l USING (name))
SELECT id, name, size_bytes, 'keep' AS action FROM old WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT id, name, size_bytes, action FROM t""",
)
def catalog_upsert(spark, sf):
    """Uploads by name: a known name keeps its id, a new one is created."""
    old = V.table(spark, sf, "orders").select(
        F.expr("concat('o', o_orderkey)").alias("id"),
        F.expr("concat('n', o_orderkey % 9000)").alias("name"),
        F.col("o_orderdate").alias("modified_time"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"),
    )
    new = V.table(spark, sf, "customer").select(
        F.expr("concat('n', c_custkey * 7)").alias("name"),
        F.lit(None).cast("timestamp_ntz").alias("modified_time"),
        (F.col("c_custkey") + 10000000).alias("size_bytes"),
        F.expr("concat('x', c_custkey)").alias("new_id"),
    )
    return catalog.upsert_by_name(old, new, F.col("new_id")).drop("modified_time")


@register(
    "catalog_upsert_folders",
    """WITH old AS (SELECT 'o' || o_orderkey AS id, 'n' || (o_orderkey % 900) AS name, 'f' || (o_orderkey % 4) AS folder, o_orderkey % 5 = 0 AS trashed,
  CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders),
new AS (SELECT 'n' || (c_custkey * 7) AS name, 'f' || (c_custkey % 3) AS folder, CAST(c_custkey + 10000000 AS BIGINT) AS size_bytes, 'x' || c_custkey AS new_id FROM customer),
t AS (SELECT n.name, n.size_bytes, coalesce(l.id, n.new_id) AS id, CASE WHEN l.id IS NULL THEN 'create' ELSE 'update' END AS action
  FROM new n LEFT JOIN (SELECT name, folder, min(id) AS id FROM old WHERE NOT trashed GROUP BY ALL) l USING (name, folder))
SELECT id, name, size_bytes, 'keep' AS action FROM old WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT id, name, size_bytes, action FROM t""",
)
def catalog_upsert_folders(spark, sf):
    """Uploads into folders; entries in the trash or elsewhere are left alone."""
    old = V.table(spark, sf, "orders").select(
        F.expr("concat('o', o_orderkey)").alias("id"),
        F.expr("concat('n', o_orderkey % 900)").alias("name"),
        F.expr("concat('f', o_orderkey % 4)").alias("folder"),
        F.expr("o_orderkey % 5 = 0").alias("trashed"),
        F.col("o_orderdate").alias("modified_time"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"),
    )
    new = V.table(spark, sf, "customer").select(
        F.expr("concat('n', c_custkey * 7)").alias("name"),
        F.expr("concat('f', c_custkey % 3)").alias("folder"),
        F.lit(None).cast("timestamp_ntz").alias("modified_time"),
        (F.col("c_custkey") + 10000000).alias("size_bytes"),
        F.expr("concat('x', c_custkey)").alias("new_id"),
    )
    return catalog.upsert_by_name(old, new, F.col("new_id")).drop("modified_time")


# -- restore ------------------------------------------------------------------
@register(
    "restore_plan",
    V.with_views(
        """SELECT profile, path, CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN 'overwrite' WHEN a.path IS NOT NULL THEN 'restore' ELSE 'preserve' END AS action
FROM snap_a a FULL JOIN snap_b b USING (profile, path)""",
        "snap_a",
        "snap_b",
    ),
)
def restore_plan(spark, sf):
    """Overwrite, restore or preserve each path; nothing is deleted."""
    return restore.reconcile(V.snap_a(spark, sf), V.snap_b(spark, sf), ["profile"])


# Requested paths: folders and files named by the label table, and page hosts.
_REQUESTED = """(SELECT DISTINCT CASE WHEN quality = 0 AND toxic = 1 THEN source || '/' || lang WHEN quality = 0 THEN source || '/' || lang || '/' || doc_id || '.log' ELSE lang || '/' || source END AS path
  FROM labels JOIN documents USING (doc_id))"""


def _requested(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "source", "lang")
    path = (
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.concat_ws("/", "source", "lang"))
        .when(F.col("quality") == 0, F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".log")))
        .otherwise(F.concat_ws("/", "lang", "source"))
    )
    return V.table(spark, sf, "labels").join(docs, "doc_id").select(path.alias("path"))


@register(
    "selective_restore",
    V.with_views(
        f"SELECT profile, path FROM snap_a s WHERE EXISTS (SELECT 1 FROM {_REQUESTED} r WHERE s.path = r.path OR starts_with(s.path, r.path || '/'))",
        "snap_a",
    ),
)
def selective_restore(spark, sf):
    """Members equal to or below a requested path."""
    return restore.select_members(V.snap_a(spark, sf), _requested(spark, sf), []).select("profile", "path")


@register(
    "prune_paths",
    f"SELECT path FROM {_REQUESTED} p WHERE NOT EXISTS (SELECT 1 FROM {_REQUESTED} r WHERE starts_with(p.path, r.path || '/'))",
)
def prune_paths(spark, sf):
    """Requested paths without those below another."""
    return restore.prune_paths(_requested(spark, sf), [])


# -- snapshots ----------------------------------------------------------------
_DIFF = """(SELECT profile, path, coalesce(b.size_bytes, 0) AS size_bytes, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted'
  WHEN a.size_bytes = b.size_bytes AND a.mtime = b.mtime THEN 'unchanged' ELSE 'changed' END AS state FROM snap_a a FULL JOIN snap_b b USING (profile, path))"""


def _diff(spark, sf):
    return restore.snapshot_diff(V.snap_a(spark, sf), V.snap_b(spark, sf), ["profile"], ["size_bytes", "mtime"])


@register("snapshot_diff", V.with_views(f"SELECT * FROM {_DIFF}", "snap_a", "snap_b"))
def snapshot_diff(spark, sf):
    """Unchanged, changed, added and deleted paths between two snapshots."""
    return _diff(spark, sf)


@register(
    "dedup_savings",
    V.with_views(
        f"""SELECT profile, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, CAST(coalesce(sum(size_bytes) FILTER (state <> 'unchanged'), 0) AS BIGINT) AS new_bytes,
  CAST(coalesce(sum(size_bytes) FILTER (state = 'unchanged'), 0) AS BIGINT) AS saved_bytes FROM {_DIFF} WHERE state <> 'deleted' GROUP BY profile""",
        "snap_a",
        "snap_b",
    ),
)
def dedup_savings(spark, sf):
    """New bytes against all bytes of the later snapshot."""
    return restore.dedup_savings(_diff(spark, sf), ["profile"])


_SNAPPED = """(SELECT 't' || (l_suppkey % 20) AS target, strftime(l_shipdate, '%Y-%m-%d') || CASE WHEN l_linenumber % 5 = 0 THEN '-1200' ELSE '-120000' END AS snapshot, CAST(l_quantity AS BIGINT) AS size_bytes FROM lineitem)"""


def _snapped(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        F.expr("concat('t', l_suppkey % 20)").alias("target"),
        F.concat(
            F.date_format("l_shipdate", "yyyy-MM-dd"), F.expr("CASE WHEN l_linenumber % 5 = 0 THEN '-1200' ELSE '-120000' END")
        ).alias("snapshot"),
        F.col("l_quantity").cast("long").alias("size_bytes"),
    )


_LISTED = f"""(SELECT target, snapshot, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM {_SNAPPED}
  WHERE regexp_full_match(snapshot, '\\d{{4}}-\\d{{2}}-\\d{{2}}-\\d{{6}}') GROUP BY ALL)"""


@register(
    "snapshot_list",
    f"SELECT target, snapshot, n_files, size_bytes, snapshot = max(snapshot) OVER (PARTITION BY target) AS is_latest, left(snapshot, 10) || ' 12:00:00' AS taken_at FROM {_LISTED}",
)
def snapshot_list(spark, sf):
    """Snapshots with time, size and the newest mark."""
    listed = catalog.snapshots(_snapped(spark, sf))
    return listed.withColumn("taken_at", F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss"))


@register(
    "snapshot_rotation",
    f"""SELECT target, snapshot, newest_rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY snapshot DESC) AS newest_rank FROM {_LISTED}) WHERE newest_rank > 10""",
)
def snapshot_rotation(spark, sf):
    """Snapshots past the newest ten of each target."""
    listed = through_table(catalog.snapshots(_snapped(spark, sf)), "snapshots")
    dropped = catalog.snapshots_to_drop(listed)
    return dropped.select("target", "snapshot", "newest_rank")


@register(
    "calendar_retention",
    V.with_views(
        """SELECT location, id, keep AND modified_time >= TIMESTAMP '2001-08-02' - INTERVAL 1500 DAY AS keep FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY modified_time DESC, name DESC) <= 2
    OR (first_of_day AND dense_rank() OVER (PARTITION BY location ORDER BY date_trunc('day', modified_time) DESC) <= 3)
    OR (first_of_week AND dense_rank() OVER (PARTITION BY location ORDER BY date_trunc('week', modified_time) DESC) <= 4)
    OR (first_of_month AND dense_rank() OVER (PARTITION BY location ORDER BY date_trunc('month', modified_time) DESC) <= 6) AS keep
  FROM (SELECT *, row_number() OVER (PARTITION BY location, date_trunc('day', modified_time) ORDER BY modified_time DESC, name DESC) = 1 AS first_of_day,
    row_number() OVER (PARTITION BY location, date_trunc('week', modified_time) ORDER BY modified_time DESC, name DESC) = 1 AS first_of_week,
    row_number() OVER (PARTITION BY location, date_trunc('month', modified_time) ORDER BY modified_time DESC, name DESC) = 1 AS first_of_month FROM backups))""",
        "backups",
    ),
)
def calendar_retention(spark, sf):
    """Newest two, and the newest of the last days, weeks and months, within an age."""
    kept = catalog.calendar_retention(
        V.backups(spark, sf),
        F.expr("timestamp_ntz'2001-08-02 00:00:00'"),
        ("location",),
        last=2,
        daily=3,
        weekly=4,
        monthly=6,
        max_age_days=1500,
    )
    return kept.select("location", "id", "keep")


_BOTH = "snap_a s FULL JOIN snap_b t USING (profile, path)"


def _plan_sql(action: str) -> str:
    return V.with_views(
        f"""SELECT profile, path, action, CAST(CASE WHEN action IN ('add_to_target', 'update_target') THEN s_size WHEN action IN ('add_to_source', 'update_source') THEN t_size ELSE 0 END AS BIGINT) AS transfer_bytes
FROM (SELECT profile, path, s.size_bytes AS s_size, t.size_bytes AS t_size, {action} AS action FROM {_BOTH})""",
        "snap_a",
        "snap_b",
    )


_ONE_WAY = "CASE WHEN t.sha256 IS NULL THEN 'add_to_target' WHEN s.sha256 IS NULL THEN '{gone}' WHEN s.sha256 = t.sha256 THEN 'none' ELSE 'update_target' END"
_TWO_WAY = "CASE WHEN t.sha256 IS NULL THEN 'add_to_target' WHEN s.sha256 IS NULL THEN 'add_to_source' WHEN s.sha256 = t.sha256 THEN 'none' WHEN s.mtime >= t.mtime THEN 'update_target' ELSE 'update_source' END"


def _plan(spark, sf, mode):
    return restore.sync_plan(V.snap_a(spark, sf), V.snap_b(spark, sf), ["profile"], mode)


@register("sync_plan_sync", _plan_sql(_ONE_WAY.format(gone="delete_from_target")))
def sync_plan_sync(spark, sf):
    """Make the target equal to the source."""
    return _plan(spark, sf, "sync")


@register("sync_plan_copy", _plan_sql(_ONE_WAY.format(gone="none")))
def sync_plan_copy(spark, sf):
    """Bring the target up to date and delete nothing."""
    return _plan(spark, sf, "copy")


@register("sync_plan_bisync", _plan_sql(_TWO_WAY))
def sync_plan_bisync(spark, sf):
    """Both ways, the newer file wins."""
    return _plan(spark, sf, "bisync")


@register(
    "sync_status",
    V.with_views(
        f"""SELECT profile, CAST(sum(CASE WHEN action IN ('add_to_target', 'update_target') THEN s_size ELSE 0 END) AS BIGINT) AS bytes,
  CAST(count(*) FILTER (action LIKE 'add%') AS BIGINT) AS added, CAST(count(*) FILTER (action LIKE 'update%') AS BIGINT) AS modified,
  CAST(count(*) FILTER (action LIKE 'delete%') AS BIGINT) AS deleted, CAST(count(*) FILTER (action = 'none') AS BIGINT) AS untouched
FROM (SELECT profile, s.size_bytes AS s_size, {_ONE_WAY.format(gone='delete_from_target')} AS action FROM {_BOTH}) GROUP BY profile""",
        "snap_a",
        "snap_b",
    ),
)
def sync_status(spark, sf):
    """Totals of a sync per profile."""
    return restore.sync_status(_plan(spark, sf, "sync"), ["profile"])


@register(
    "sync_filter",
    V.with_views(
        f"""SELECT profile, path FROM snap_b WHERE (regexp_matches(path, '\\.log$') OR regexp_matches(path, '(^|/)en(/|$)')) AND NOT regexp_matches(path, '(^|/)src1[0-9](/|$)')
  AND size_bytes BETWEEN 200 AND 6000 AND {V.NOW} - mtime BETWEEN 600 AND 30000""",
        "snap_b",
    ),
)
def sync_filter(spark, sf):
    """Include and exclude globs, size and age."""
    kept = restore.sync_filter(
        V.snap_b(spark, sf),
        include=("*.log", "en"),
        exclude=("src1[0-9]",),
        min_size=200,
        max_size=6000,
        min_age=600,
        max_age=30000,
        now_epoch=F.lit(V.NOW),
    )
    return kept.select("profile", "path")


_RUNS = """(SELECT 'i' || o_custkey AS instance, o_orderdate AS finished_at, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderstatus <> 'P' AS success, o_orderkey FROM orders)"""


def runs(spark, sf):
    return V.table(spark, sf, "orders").select(
        F.expr("concat('i', o_custkey)").alias("instance"),
        F.col("o_orderdate").alias("finished_at"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"),
        (F.col("o_orderstatus") != "P").alias("success"),
    )


@register(
    "backup_status",
    f"""SELECT instance, strftime(finished_at, '%Y-%m-%d') AS last_run, size_bytes, success, strftime(last_success, '%Y-%m-%d') AS last_success,
  CAST(996710400 - epoch(finished_at) AS BIGINT) AS age_seconds FROM (
  SELECT *, row_number() OVER (PARTITION BY instance ORDER BY finished_at DESC, size_bytes DESC) AS rn, max(finished_at) FILTER (success) OVER (PARTITION BY instance) AS last_success FROM {_RUNS}) WHERE rn = 1""",
)
def backup_status(spark, sf):
    """Last run, size, success and age per instance."""
    status = catalog.backup_status(runs(spark, sf), F.timestamp_seconds(F.lit(996710400)), ["instance"])
    return status.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("last_run", "last_success")}
    )


_CONTENT = """(SELECT profile, sha256(path || chr(1) || sha256 || chr(1) || size_bytes) AS h, size_bytes FROM snap_a)"""


@register(
    "backup_manifest",
    V.with_views(
        f"""SELECT profile, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, 'daily' AS retention_class, '2024-02-01' AS created_at,
  sha256(CAST(sum(CAST(CAST('0x' || h[1:15] AS BIGINT) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST(CAST('0x' || h[16:30] AS BIGINT) AS HUGEINT)) AS VARCHAR)) AS checksum
FROM {_CONTENT} GROUP BY profile""",
        "snap_a",
    ),
)
def backup_manifest(spark, sf):
    """One row per backup with size, count and an order-free checksum."""
    return catalog.backup_manifest(V.snap_a(spark, sf), ["profile"], F.lit("daily"), F.lit("2024-02-01"))
