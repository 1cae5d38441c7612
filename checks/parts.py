"""Queries of bundles that are packed, listed and signed by many tasks each, and of files of any size."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from checks import views as V
from checks.arrival import KEYS, _sent, fresh_folder, with_sent
from checks.bundles import _MANIFESTS, _SIGNED, MEMBERS
from checks.registry import register

from stowage.operators import inventory, validate
from stowage.schemas import Limits
from stowage.sinks import bundle_parts
from stowage.sources import listing
from stowage.sources.archive_files import with_archives
from stowage.streaming import absence_stream

PART = 3


def _parts(spark, sf, codec="gzip"):
    """(index, folder): all bundles in parts of three members."""
    files = _sent(spark, sf).withColumn("relative_path", F.col("name"))
    folder = fresh_folder(spark, "parts")
    return bundle_parts.write_parts(files, folder, codec=codec, part_members=PART), folder


@register(
    "pack_parts",
    with_sent(
        f"""SELECT sender_id, bundle_id, CAST(member_idx // {PART} AS BIGINT) AS part, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes,
  CAST(sum(count(*)) OVER (PARTITION BY sender_id, bundle_id ORDER BY member_idx // {PART}) - count(*) AS BIGINT) AS first_member
FROM members GROUP BY sender_id, bundle_id, member_idx // {PART}"""
    ),
)
def pack_parts(spark, sf):
    """The index of all bundles packed in parts: a bundle is packed by as many tasks as it has parts."""
    index, _ = _parts(spark, sf)
    return bundle_parts.placed(index).select(*KEYS, "part", "n_files", "n_bytes", "first_member")


_READ = """SELECT sender_id, bundle_id, row_number() OVER (PARTITION BY sender_id, bundle_id ORDER BY member_idx) - 1 AS member_idx, name,
  'file' AS member_type, size_bytes, CASE WHEN size_bytes <= 2000 THEN sha256(content) END AS sha256 FROM members"""


@register("part_members", with_sent(_READ))
def part_members(spark, sf):
    """Members of parts, each part read by itself; oversize content is not kept."""
    index, folder = _parts(spark, sf, "zstd")
    members = bundle_parts.read_part_members(index, folder, codec="zstd", max_content_bytes=2000)
    return members.select(*KEYS, "member_idx", "name", "member_type", "size_bytes", F.sha2("content", 256).alias("sha256"))


@register(
    "archive_file_members",
    with_sent(f"SELECT * FROM ({_READ}) WHERE size_bytes <= 2000 AND starts_with(name, 'chat/')"),
)
def archive_file_members(spark, sf):
    """Archive files, one a bundle, read as a source; size and name are tested in the reader."""
    index, folder = _parts(spark, sf)
    name = F.concat_ws("--", "sender_id", "bundle_id")
    joined = bundle_parts.join_parts(index, folder, f"{folder}/joined", name)
    joined.write.format("noop").mode("overwrite").save()
    found = with_archives(spark).read.format("archive_members").load(f"{folder}/joined")
    label = F.split(F.regexp_extract("path", r"([^/]*)\.tar\.gz$", 1), "--")
    return found.filter((F.col("size_bytes") <= 2000) & F.col("name").startswith("chat/")).select(
        label[0].alias("sender_id"),
        label[1].alias("bundle_id"),
        "member_idx",
        "name",
        "member_type",
        "size_bytes",
        F.sha2("content", 256).alias("sha256"),
    )


@register(
    "manifest_chunks_signed",
    V.with_views(
        f"SELECT sender_id, bundle_id, n_files, CAST(strlen(manifest) AS BIGINT) AS n_bytes, {_SIGNED} AS signature FROM {_MANIFESTS} JOIN pads USING (sender_id)",
        *MEMBERS,
        "pads",
    ),
)
def manifest_chunks_signed(spark, sf):
    """Manifests written three entries at a time and signed as they stream by."""
    members = V.members(spark, sf)
    chosen = validate.checked_members(members).withColumn("mtime", F.expr("1706659200 - conv_id * 61 - member_idx"))
    chunks = bundle_parts.manifest_chunks(chosen, F.lit("2026-04-19T08:12:00Z"), F.lit("/var/log"), entries=PART)
    return bundle_parts.sign_chunks(chunks, V.senders(members))


_FILES = """SELECT p_partkey, p_type, p_size, 'brand ' || p_brand || '/' || CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END || 'p' || p_partkey
  || CASE WHEN p_partkey % 5 = 0 THEN '.txt' ELSE '.log' END AS relative_path,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN p_name || chr(0) || p_type ELSE repeat(p_name || chr(10), CAST(p_size AS INTEGER)) END AS body FROM part"""


def _written(spark, sf):
    """A folder with one file a part: some are empty, some hidden, some hold a zero byte; and a link."""
    folder = fresh_folder(spark, "tree")
    rows = V.table(spark, sf, "part").selectExpr(
        "concat('brand ', p_brand, '/', if(p_partkey % 7 = 0, '.', ''), 'p', p_partkey, if(p_partkey % 5 = 0, '.txt', '.log')) AS path",
        "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN concat(p_name, char(0), p_type) "
        "ELSE repeat(concat(p_name, char(10)), CAST(p_size AS INT)) END AS body",
    )
    top = folder.removeprefix("file:")

    def write(batches):
        for batch in batches:
            for path, body in zip(batch["path"], batch["body"]):
                os.makedirs(os.path.dirname(f"{top}/{path}"), exist_ok=True)
                with open(f"{top}/{path}", "wb") as out:
                    out.write(body.encode())
            yield batch[["path"]]

    rows.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


@register(
    "scanned_digests",
    f"""WITH files AS ({_FILES})
SELECT relative_path, CAST(strlen(body) AS BIGINT) AS size_bytes, sha256(body) AS sha256,
  CASE WHEN p_partkey % 5 = 0 THEN 'ext_not_allowed' WHEN strlen(body) > 1500 THEN 'file_too_large' WHEN contains(body, chr(0)) THEN 'not_text' ELSE 'ok' END AS preflight
FROM files""",
)
def scanned_digests(spark, sf):
    """Files that the query writes itself, listed exactly, read block by block and judged."""
    listed = listing.scan_roots(spark, [_written(spark, sf), "/no/such/folder"], with_content=False)
    checked = inventory.preflight(listing.with_digests(listed), Limits(max_file_bytes=1500))
    return checked.select("relative_path", "size_bytes", "sha256", "preflight")


@register(
    "silent_users",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS follows FROM (SELECT DISTINCT user_id, ts FROM events))
SELECT user_id, ts AS last_seen, ts + INTERVAL 2 DAY AS due FROM e
WHERE (follows IS NULL OR follows > ts + INTERVAL 2 DAY) AND ts + INTERVAL 2 DAY < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""",
)
def silent_users(spark, sf):
    """Users of whom nothing came for two days, raised by a stream as its watermark passes them."""
    root = fresh_folder(spark, "silence")
    V.table(spark, sf, "events").select("user_id", "ts").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("user_id bigint, ts timestamp").parquet(f"{root}/in")
    query = (
        absence_stream.missing(stream, "user_id", 2 * 86_400, "1 hour")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("user_id string, last_seen timestamp, due timestamp").parquet(f"{root}/out")
