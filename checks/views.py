"""File, bundle, audit and backup tables derived from the given tables.

Each view is written twice, in Spark and in SQL.  The given data holds no
faults, so fixed arithmetic on the keys puts some in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import digests
from stowage.operators import audit
from stowage.schemas import Limits
from stowage.session import through_table

FILE_LIMITS = Limits(max_file_bytes=16384)
BUNDLE_LIMITS = Limits(max_file_bytes=2000, max_bundle_bytes=3000, max_files=6)
STREAM_LIMITS = Limits(max_file_bytes=2000, max_bundle_bytes=200_000, max_files=6)
LARGE_LIMITS = Limits(max_file_bytes=490_000, max_bundle_bytes=1_500_000, max_files=12)
NOW = 1706659200
RECEIVED = "2024-02-01 06:07:08"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_views(body: str, *names: str) -> str:
    """Put the named SQL views in front of a query, in the order given."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body


SQL: dict[str, str] = {}


def hit(expression: str, modulus: int) -> Column:
    return F.expr(f"({expression}) % {modulus} = 0")


# -- files --------------------------------------------------------------------
SQL["files"] = """
SELECT 0 AS root_ord, '/data' AS root, doc_id, source, lang,
  source || '/' || lang || '/' || doc_id || CASE doc_id % 10 WHEN 0 THEN '.txt' WHEN 1 THEN '.LOG' WHEN 2 THEN '' ELSE '.log' END AS relative_path,
  CASE WHEN doc_id % 17 = 0 THEN chr(0) || text WHEN doc_id % 19 = 0 THEN repeat('x', 9000) || chr(0) || text ELSE text END AS content,
  CAST(strlen(CASE WHEN doc_id % 17 = 0 THEN chr(0) || text WHEN doc_id % 19 = 0 THEN repeat('x', 9000) || chr(0) || text ELSE text END) AS BIGINT) AS size_bytes,
  CAST(1706659200 - doc_id * 37 AS BIGINT) AS mtime
FROM documents"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    body = (
        F.when(hit("doc_id", 17), F.concat(F.lit("\0"), "text"))
        .when(hit("doc_id", 19), F.concat(F.lit("x" * 9000 + "\0"), F.col("text")))
        .otherwise(F.col("text"))
    )
    ext = F.expr("CASE doc_id % 10 WHEN 0 THEN '.txt' WHEN 1 THEN '.LOG' WHEN 2 THEN '' ELSE '.log' END")
    return table(spark, sf, "documents").select(
        F.lit(0).alias("root_ord"),
        F.lit("/data").alias("root"),
        "doc_id",
        "source",
        "lang",
        F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), ext).alias("relative_path"),
        body.cast("binary").alias("content"),
        F.octet_length(body).cast("long").alias("size_bytes"),
        F.expr("cast(1706659200 - doc_id * 37 as bigint)").alias("mtime"),
    )


SQL["checked"] = """
SELECT *, preflight = 'ok' AS toggleable FROM (
  SELECT * EXCLUDE (content), CASE
    WHEN lower(regexp_extract(regexp_extract(relative_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) <> '.log' THEN 'ext_not_allowed'
    WHEN size_bytes > 16384 THEN 'file_too_large'
    WHEN strpos(content, chr(0)) BETWEEN 1 AND 8192 THEN 'not_text'
    ELSE 'ok' END AS preflight
  FROM files)"""


def two_roots(files_df: DataFrame) -> DataFrame:
    """The same tree, and one of its folders again as a second root."""
    nested = (
        files_df.filter("source = 'src3'")
        .withColumns(
            {
                "root": F.lit("/data/src3"),
                "root_ord": F.lit(1),
                "relative_path": F.substring("relative_path", 6, 1 << 30),
            }
        )
    )
    return files_df.unionByName(nested)


SQL["rooted"] = """
SELECT root_ord, root, relative_path, toggleable, size_bytes, mtime FROM checked
UNION ALL
SELECT 1, '/data/src3', substr(relative_path, 6), toggleable, size_bytes, mtime FROM checked WHERE source = 'src3'"""

# Folders above each file, the root as ''.
SQL["file_folders"] = """
SELECT f.root, f.root_ord, f.relative_path, f.toggleable, f.size_bytes, f.mtime,
  array_to_string(string_split(f.relative_path, '/')[1:k], '/') AS folder
FROM checked f, unnest(range(0, len(string_split(f.relative_path, '/')))) AS u(k)"""

# -- listings: two roots, a file as root, links, folders, hidden, empty and outside entries --
SQL["listing"] = """
SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN path ELSE root END AS root, root_ord,
  CASE WHEN doc_id % 11 = 0 AND doc_id % 29 <> 0 THEN '/elsewhere' || path ELSE path END AS path, kind, size_bytes, mtime
FROM (SELECT *, root || '/' || CASE doc_id % 5 WHEN 0 THEN source || '/.' || doc_id || '.log' WHEN 1 THEN '_' || doc_id || '.tar.zst'
    WHEN 2 THEN 'site-' || doc_id || '.tar.zst' WHEN 3 THEN '.' || doc_id || '.tar.zst' ELSE source || '/' || lang || '/' || doc_id || '.tar.zst' END AS path
  FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN '/more' ELSE '/data' END AS root, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS root_ord,
      CASE doc_id % 13 WHEN 0 THEN 'link' WHEN 1 THEN 'dir' WHEN 2 THEN 'other' ELSE 'file' END AS kind,
      CASE WHEN doc_id % 7 = 0 THEN 0 ELSE CAST(strlen(text) AS BIGINT) END AS size_bytes, CAST(1706659200 - doc_id * 37 AS DOUBLE) AS mtime FROM documents))"""


def listing(spark: SparkSession, sf: str) -> DataFrame:
    root = F.when(hit("doc_id", 3), "/more").otherwise("/data")
    name = F.expr(
        """CASE doc_id % 5 WHEN 0 THEN concat(source, '/.', doc_id, '.log') WHEN 1 THEN concat('_', doc_id, '.tar.zst')
        WHEN 2 THEN concat('site-', doc_id, '.tar.zst') WHEN 3 THEN concat('.', doc_id, '.tar.zst')
        ELSE concat(source, '/', lang, '/', doc_id, '.tar.zst') END"""
    )
    path = F.concat(root, F.lit("/"), name)
    is_root, outside = hit("doc_id", 29), hit("doc_id", 11) & ~hit("doc_id", 29)
    return table(spark, sf, "documents").select(
        F.when(is_root, path).otherwise(root).alias("root"),
        F.when(hit("doc_id", 3), 1).otherwise(0).alias("root_ord"),
        F.when(outside, F.concat(F.lit("/elsewhere"), path)).otherwise(path).alias("path"),
        F.expr("CASE doc_id % 13 WHEN 0 THEN 'link' WHEN 1 THEN 'dir' WHEN 2 THEN 'other' ELSE 'file' END").alias("kind"),
        F.when(hit("doc_id", 7), 0).otherwise(F.octet_length("text")).cast("long").alias("size_bytes"),
        F.expr("cast(1706659200 - doc_id * 37 as double)").alias("mtime"),
    )


# -- pages as a file tree -----------------------------------------------------
_PAGE_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"
SQL["page_files"] = f"""
SELECT page_id, rtrim({_PAGE_PATH}, '/') || CASE page_id % 7 WHEN 0 THEN '.log' WHEN 1 THEN '.pyc' WHEN 2 THEN '/cache.db' WHEN 3 THEN '/.git/config' WHEN 4 THEN '/postfix/spool/q' ELSE '.html' END AS path,
  CAST(strlen(html) AS BIGINT) AS size_bytes, sha256(html) AS sha256
FROM pages"""


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.expr(
        "CASE page_id % 7 WHEN 0 THEN '.log' WHEN 1 THEN '.pyc' WHEN 2 THEN '/cache.db' "
        "WHEN 3 THEN '/.git/config' WHEN 4 THEN '/postfix/spool/q' ELSE '.html' END"
    )
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.rtrim(bare, F.lit("/")), tail).alias("path"),
        F.octet_length("html").cast("long").alias("size_bytes"),
        F.sha2("html", 256).alias("sha256"),
    )


# -- bundles ------------------------------------------------------------------
SQL["members"] = """
SELECT 's' || (conv_id % 5) AS sender_id, 'b' || conv_id AS bundle_id, conv_id, turn AS member_idx,
  CASE WHEN (conv_id * 3 + turn) % 29 = 0 THEN 'chat/turn-' || turn || '.txt'
       WHEN (conv_id * 5 + turn) % 43 = 0 THEN '../chat/turn-' || turn || '.log'
       WHEN (conv_id * 7 + turn) % 59 = 0 THEN 'chat/../../turn-' || turn || '.log'
       WHEN (conv_id + turn) % 37 = 0 THEN '/abs/turn-' || turn || '.log'
       WHEN (conv_id + turn) % 11 = 0 THEN 'chat/./turn-' || turn || '.LOG'
       ELSE 'chat/turn-' || turn || '.log' END AS name,
  CASE WHEN (conv_id * 11 + turn) % 47 = 0 THEN 'link' WHEN (conv_id * 13 + turn) % 31 = 0 THEN 'dir' ELSE 'file' END AS member_type,
  CASE WHEN (conv_id * 2 + turn) % 23 = 0 THEN chr(0) || text ELSE text END AS content,
  CAST(strlen(CASE WHEN (conv_id * 2 + turn) % 23 = 0 THEN chr(0) || text ELSE text END) AS BIGINT) AS size_bytes
FROM conversations"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    c = F.concat
    turn = F.col("turn").cast("string")
    name = (
        F.when(hit("conv_id * 3 + turn", 29), c(F.lit("chat/turn-"), turn, F.lit(".txt")))
        .when(hit("conv_id * 5 + turn", 43), c(F.lit("../chat/turn-"), turn, F.lit(".log")))
        .when(hit("conv_id * 7 + turn", 59), c(F.lit("chat/../../turn-"), turn, F.lit(".log")))
        .when(hit("conv_id + turn", 37), c(F.lit("/abs/turn-"), turn, F.lit(".log")))
        .when(hit("conv_id + turn", 11), c(F.lit("chat/./turn-"), turn, F.lit(".LOG")))
        .otherwise(c(F.lit("chat/turn-"), turn, F.lit(".log")))
    )
    kind = F.when(hit("conv_id * 11 + turn", 47), "link").when(hit("conv_id * 13 + turn", 31), "dir").otherwise("file")
    body = F.when(hit("conv_id * 2 + turn", 23), c(F.lit("\0"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        F.expr("concat('s', conv_id % 5)").alias("sender_id"),
        F.expr("concat('b', conv_id)").alias("bundle_id"),
        "conv_id",
        F.col("turn").alias("member_idx"),
        name.alias("name"),
        kind.alias("member_type"),
        body.cast("binary").alias("content"),
        F.octet_length(body).cast("long").alias("size_bytes"),
    )


# Regular members with their normalised path and digest.
SQL["regular"] = """
SELECT *, array_to_string(list_filter(string_split(name, '/'), lambda p: p NOT IN ('', '.')), '/') AS relative_path,
  sha256(content) AS sha256
FROM members WHERE member_type <> 'dir'"""

SQL["manifest_files"] = """
SELECT sender_id, bundle_id, member_idx AS idx, relative_path,
  CASE WHEN (conv_id * 7 + member_idx) % 41 = 0 THEN sha256('bad' || content) ELSE sha256 END AS sha256, size_bytes
FROM regular WHERE (conv_id + member_idx * 3) % 53 <> 0
UNION ALL
SELECT sender_id, bundle_id, member_idx - 100, relative_path, sha256('old' || content), size_bytes
FROM regular WHERE (conv_id + member_idx) % 19 = 0
UNION ALL
SELECT sender_id, bundle_id, 1000, 'extra/' || member_idx || '.log', sha256(content), size_bytes
FROM regular WHERE conv_id % 13 = 0"""


def manifest_files(member_rows: DataFrame) -> DataFrame:
    from stowage.operators.validate import checked_members

    keyed = ["sender_id", "bundle_id"]
    rows = member_rows.withColumns(
        {
            "bad": F.sha2(F.concat(F.lit(b"bad"), "content"), 256),
            "old": F.sha2(F.concat(F.lit(b"old"), "content"), 256),
        }
    )
    regular = checked_members(rows)
    current = regular.filter(~hit("conv_id + member_idx * 3", 53)).select(
        *keyed,
        F.col("member_idx").alias("idx"),
        "relative_path",
        F.when(hit("conv_id * 7 + member_idx", 41), F.col("bad")).otherwise(F.col("sha256")).alias("sha256"),
        "size_bytes",
    )
    older = regular.filter(hit("conv_id + member_idx", 19)).select(
        *keyed, (F.col("member_idx") - 100).alias("idx"), "relative_path", F.col("old").alias("sha256"), "size_bytes"
    )
    extra = regular.filter(hit("conv_id", 13)).select(
        *keyed,
        F.lit(1000).cast("long").alias("idx"),
        F.expr("concat('extra/', member_idx, '.log')").alias("relative_path"),
        "sha256",
        "size_bytes",
    )
    return current.unionByName(older).unionByName(extra)


_RULES = """
  CASE WHEN path_unsafe THEN 0 WHEN running_files > {files} THEN 1
       WHEN lower(regexp_extract(regexp_extract(relative_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) <> '.log' THEN 2
       WHEN size_bytes > {file} THEN 3 WHEN running_bytes > {bundle} THEN 4 END"""
_NAMES = "CASE rule WHEN 0 THEN 'path_unsafe' WHEN 1 THEN 'too_many_files' WHEN 2 THEN 'ext_not_allowed' WHEN 3 THEN 'file_too_large' WHEN 4 THEN 'bundle_too_large' END"

SQL["running"] = """
SELECT *, member_type <> 'file' OR name LIKE '../%' OR name LIKE '%/../../%' AS path_unsafe,
  row_number() OVER w AS running_files, CAST(sum(size_bytes) OVER w AS BIGINT) AS running_bytes
FROM regular WINDOW w AS (PARTITION BY sender_id, bundle_id ORDER BY member_idx)"""


def _findings_sql(b: Limits) -> str:
    return f"""
SELECT r.*, d.sha256 AS declared_sha,
  CASE WHEN rule IS NOT NULL THEN 1 WHEN strpos(content, chr(0)) BETWEEN 1 AND 8192 THEN 2
       WHEN d.sha256 IS DISTINCT FROM r.sha256 THEN 3 END AS phase,
  CASE WHEN rule IS NOT NULL THEN {_NAMES} WHEN strpos(content, chr(0)) BETWEEN 1 AND 8192 THEN 'not_text'
       WHEN d.sha256 IS DISTINCT FROM r.sha256 THEN 'hash_mismatch' END AS reason
FROM (SELECT *, {_RULES.format(files=b.max_files, file=b.max_file_bytes, bundle=b.max_bundle_bytes)} AS rule FROM running) r
LEFT JOIN (SELECT sender_id, bundle_id, relative_path, arg_max(sha256, idx) AS sha256 FROM manifest_files GROUP BY ALL) d
  USING (sender_id, bundle_id, relative_path)"""


def _verdicts_sql(b: Limits) -> str:
    return f"""
SELECT sender_id, bundle_id,
  CASE WHEN coalesce(n_declared, 0) > {b.max_files} THEN 'too_many_files' ELSE m.reason END AS reason,
  CAST(CASE WHEN coalesce(n_declared, 0) > {b.max_files} THEN 0 ELSE m.phase END AS INTEGER) AS phase,
  CASE WHEN coalesce(n_declared, 0) > {b.max_files} THEN NULL ELSE m.at_member END AS at_member,
  CAST(coalesce(n_members, 0) AS BIGINT) AS n_members, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes,
  coalesce(n_declared, 0) <= {b.max_files} AND m.phase IS NULL AS accepted
FROM (
  SELECT a.sender_id, a.bundle_id, n_members, n_bytes, v.reason, v.phase, v.member_idx AS at_member
  FROM (SELECT sender_id, bundle_id, count(*) AS n_members, sum(size_bytes) AS n_bytes FROM findings GROUP BY ALL) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sender_id, bundle_id ORDER BY phase, member_idx) AS rn
             FROM findings WHERE phase IS NOT NULL) v
    ON v.sender_id = a.sender_id AND v.bundle_id = a.bundle_id AND v.rn = 1
) m FULL JOIN (SELECT sender_id, bundle_id, count(*) AS n_declared FROM manifest_files GROUP BY ALL) d USING (sender_id, bundle_id)"""


SQL["findings"] = _findings_sql(BUNDLE_LIMITS)
SQL["verdicts"] = _verdicts_sql(BUNDLE_LIMITS)
# The same rules with the limits of the streaming queries.
STREAM_SQL = {"findings": _findings_sql(STREAM_LIMITS), "verdicts": _verdicts_sql(STREAM_LIMITS)}
BUNDLE_VIEWS = ("members", "regular", "manifest_files", "running", "findings", "verdicts")

# -- audit --------------------------------------------------------------------
# One receive attempt per event; a sender's attempts are one chain.
SQL["attempts"] = """
SELECT event_id, 'u' || user_id AS sender_id, 'e' || event_id AS bundle_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_text,
  CASE WHEN event_type = 'error' THEN 'reject' ELSE 'accept' END AS event,
  CASE WHEN event_type = 'error' THEN 'not_text' END AS reject_reason,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 9 + 1 END AS BIGINT) AS file_count,
  CAST(strlen(props) AS BIGINT) AS byte_count, sha256(props) AS receipt_sha256,
  CASE WHEN event_id % 50 = 0 THEN 'unknown' ELSE '10.0.0.' || (event_id % 250) END AS remote_addr,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq
FROM events"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    from stowage.plans.sliced import SlicedOrder, by_number

    failed = F.col("event_type") == "error"
    records = table(spark, sf, "events").select(
        "event_id",
        F.expr("concat('u', user_id)").alias("sender_id"),
        F.expr("concat('e', event_id)").alias("bundle_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.when(failed, "reject").otherwise("accept").alias("event"),
        F.when(failed, "not_text").alias("reject_reason"),
        F.when(failed, F.lit(0)).otherwise(F.expr("event_id % 9 + 1")).cast("long").alias("file_count"),
        F.octet_length("props").cast("long").alias("byte_count"),
        F.sha2("props", 256).alias("receipt_sha256"),
        F.expr("CASE WHEN event_id % 50 = 0 THEN 'unknown' ELSE concat('10.0.0.', event_id % 250) END").alias("remote_addr"),
    )
    order = SlicedOrder(("sender_id",), by_number("event_id", 100_000), ("event_id",))
    return order.position(records, "_at").withColumn("seq", F.col("_at") - 1).drop("_at")


SQL["heads"] = """
SELECT sender_id, seq, event_id,
  '{"ts":"' || ts_text || '","event":"' || event || '","sender_id":"' || sender_id || '","bundle_id":"' || bundle_id
  || '","remote_addr":"' || remote_addr || '","byte_count":' || byte_count || ',"file_count":' || file_count
  || ',"reject_reason":' || coalesce('"' || reject_reason || '"', 'null') || ',"receipt_sha256":"' || receipt_sha256 || '","prev_hash":"' AS head
FROM attempts"""
SQL["chain"] = """
SELECT sender_id, seq, event_id, repeat('0', 64) AS prev_hash, head || repeat('0', 64) || '"}' AS line FROM heads WHERE seq = 0
UNION ALL
SELECT h.sender_id, h.seq, h.event_id, sha256(c.line || chr(10)), h.head || sha256(c.line || chr(10)) || '"}'
FROM chain c JOIN heads h ON h.sender_id = c.sender_id AND h.seq = c.seq + 1"""
CHAIN_VIEWS = ("attempts", "heads", "chain")


def with_chain(body: str, *more: str) -> str:
    return with_views(body, *CHAIN_VIEWS, *more).replace("WITH ", "WITH RECURSIVE ", 1)


def built_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Audit logs as they are stored; what reads them twice does not build them twice."""
    return through_table(audit.build_chain(attempts(spark, sf), ["sender_id"]), "chain")


# -- backups ------------------------------------------------------------------
SQL["backups"] = """
SELECT 'c' || o_custkey AS location, o_orderkey AS id,
  CASE WHEN o_orderkey % 9 = 0 THEN 'notes-' || o_orderkey || '.txt' WHEN o_orderkey % 7 = 0 THEN 'v1.' || o_orderkey || '.tar.zst'
       ELSE 'backup-' || o_orderkey || '.tar.zst' END AS name,
  o_orderdate AS modified_time, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
  o_orderkey % 11 = 0 AS keep_forever
FROM orders"""


def backups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.expr("concat('c', o_custkey)").alias("location"),
        F.col("o_orderkey").alias("id"),
        F.expr(
            "CASE WHEN o_orderkey % 9 = 0 THEN concat('notes-', o_orderkey, '.txt') "
            "WHEN o_orderkey % 7 = 0 THEN concat('v1.', o_orderkey, '.tar.zst') "
            "ELSE concat('backup-', o_orderkey, '.tar.zst') END"
        ).alias("name"),
        F.col("o_orderdate").alias("modified_time"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"),
        F.expr("o_orderkey % 11 = 0").alias("keep_forever"),
    )


# -- two snapshots of one tree ------------------------------------------------
# The later snapshot renames every third file and edits every fifth.
SQL["snap_a"] = """
SELECT source AS profile, source || '/' || lang || '/' || doc_id || '.log' AS path, n_chars AS size_bytes,
  CAST(1706659200 - doc_id * 37 AS BIGINT) AS mtime, sha256(text) AS sha256
FROM documents"""
SQL["snap_b"] = """
SELECT source AS profile, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.log' END AS path,
  n_chars + CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 0 END AS size_bytes,
  CAST(1706659200 - doc_id * 37 + CASE WHEN doc_id % 5 = 0 THEN 60 - doc_id % 120 ELSE 0 END AS BIGINT) AS mtime,
  sha256(CASE WHEN doc_id % 5 = 0 THEN 'new' || text ELSE text END) AS sha256
FROM documents"""


def _snapshot(spark: SparkSession, sf: str, later: bool) -> DataFrame:
    changed = F.expr("doc_id % 5 = 0") if later else F.lit(False)
    renamed = F.expr("doc_id % 3 = 0") if later else F.lit(False)
    name = F.concat(F.col("doc_id").cast("string"), F.when(renamed, ".txt").otherwise(".log"))
    return table(spark, sf, "documents").select(
        F.col("source").alias("profile"),
        F.concat_ws("/", F.col("source"), F.col("lang"), name).alias("path"),
        (F.col("n_chars") + F.when(changed, 7).otherwise(0)).alias("size_bytes"),
        (F.expr("1706659200 - doc_id * 37") + F.when(changed, F.expr("60 - doc_id % 120")).otherwise(0))
        .cast("long")
        .alias("mtime"),
        F.sha2(F.when(changed, F.concat(F.lit("new"), "text")).otherwise(F.col("text")), 256).alias("sha256"),
    )


def snap_a(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshot(spark, sf, False)


def snap_b(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshot(spark, sf, True)


# -- senders ------------------------------------------------------------------
def senders(ids: DataFrame) -> DataFrame:
    """Sender table with token digests and signing pads, from sender ids."""
    rows = ids.select("sender_id").distinct().withColumns(
        {
            "token_sha": F.sha2(F.concat(F.lit("token-"), "sender_id"), 256),
            "secret": F.concat(F.lit("secret-"), "sender_id"),
        }
    )
    return digests.with_signing_pads(rows)


_PAD = "unhex(array_to_string(list_transform(range(0, 64), lambda i: printf('%02x', xor(CAST('0x' || substr(rpad(hex('secret-' || sender_id), 128, '0'), 2 * i + 1, 2) AS INTEGER), {mask}))), ''))"
SQL["pads"] = f"""
SELECT sender_id, {_PAD.format(mask=0x36)} AS ipad, {_PAD.format(mask=0x5C)} AS opad
FROM (SELECT DISTINCT sender_id FROM members)"""
