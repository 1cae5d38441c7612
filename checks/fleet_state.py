"""Queries over declared instances, tunnels and their readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.backups import runs
from checks.registry import register
from stowage.operators import catalog, fleet
from stowage.session import through_table
from stowage.sources.logs import connections


@register("inventory_duplicates", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def inventory_duplicates(spark, sf):
    """Names that should be unique and are not."""
    return fleet.duplicates(V.table(spark, sf, "part").select(F.col("p_name").alias("name")), ["name"])


@register(
    "dangling_refs",
    "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT CASE WHEN s_acctbal > 2000 THEN s_nationkey ELSE -1 END FROM supplier)",
)
def dangling_refs(spark, sf):
    """Rows that refer to something that is not there."""
    there = V.table(spark, sf, "supplier").withColumn(
        "s_nationkey", F.expr("CASE WHEN s_acctbal > 2000 THEN s_nationkey ELSE -1 END")
    )
    return fleet.dangling(V.table(spark, sf, "customer"), there, "c_nationkey", "s_nationkey").select(
        "c_custkey", "c_nationkey"
    )


@register(
    "default_merge",
    """SELECT n_name AS name, CAST(n_nationkey AS INTEGER) AS port, false AS is_default FROM nation
UNION ALL SELECT r_name, CAST(r_regionkey AS INTEGER), true FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)""",
)
def default_merge(spark, sf):
    """Defaults in front of what is configured, unless it names them."""
    rows = V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("port"))
    default = V.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("port"))
    return fleet.with_default(rows, default)


@register(
    "ingress_per_tunnel",
    """SELECT tunnel, name, row_number() OVER (PARTITION BY tunnel ORDER BY ord) AS rule_no FROM (
  SELECT c_custkey AS ord, c_name AS name, 'nation' || c_nationkey AS tunnel FROM customer)
WHERE tunnel IN (SELECT 'nation' || s_nationkey FROM supplier)""",
)
def ingress_per_tunnel(spark, sf):
    """Instances of each known tunnel in inventory order."""
    instances = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.expr("concat('nation', c_nationkey)").alias("tunnel")
    )
    tunnels = V.table(spark, sf, "supplier").select(F.expr("concat('nation', s_nationkey)").alias("name"))
    return fleet.instances_per_tunnel(instances, tunnels, width=500).select("tunnel", "name", "rule_no")


# Scraped pages: some count connections, some hold odd text, some are silent.
_BODY = """CASE event_id % 6 WHEN 0 THEN '# HELP x' || chr(10) || 'cloudflared_tunnel_ha_connections ' || (event_id % 9) || chr(10) || 'cloudflared_tunnel_ha_connections 77'
  WHEN 1 THEN 'cloudflared_tunnel_ha_connections{a="b c"} ' || (event_id % 5) || '.0  ' || chr(13) || chr(10) || 'other 3'
  WHEN 2 THEN 'cloudflared_tunnel_ha_connections many' WHEN 3 THEN props
  WHEN 4 THEN 'up 1' || chr(10) || 'cloudflared_tunnel_ha_connections' || chr(9) || '4e0' ELSE '' END"""
_COUNT = "CAST(CASE event_id % 6 WHEN 0 THEN event_id % 9 WHEN 1 THEN event_id % 5 WHEN 4 THEN 4 ELSE 0 END AS BIGINT)"


def _body():
    e = F.col("event_id")
    metric = F.lit("cloudflared_tunnel_ha_connections")
    kind = e % 6
    return (
        F.when(kind == 0, F.concat(F.lit("# HELP x\n"), metric, F.lit(" "), (e % 9).cast("string"), F.lit("\n"), metric, F.lit(" 77")))
        .when(kind == 1, F.concat(metric, F.lit('{a="b c"} '), (e % 5).cast("string"), F.lit(".0  \r\nother 3")))
        .when(kind == 2, F.concat(metric, F.lit(" many")))
        .when(kind == 3, F.col("props"))
        .when(kind == 4, F.concat(F.lit("up 1\n"), metric, F.lit("\t4e0")))
        .otherwise("")
    )


@register("scrape_parse", f"SELECT event_id, {_COUNT} AS connections FROM events")
def scrape_parse(spark, sf):
    """Connection counts read from metrics pages."""
    return V.table(spark, sf, "events").select("event_id", connections(_body()).alias("connections"))


@register(
    "tunnel_health",
    f"""SELECT 't' || event_id AS name, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END AS active_state, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'running' END AS sub_state,
  event_id % 4 <> 0 AND event_id % 11 <> 0 AS metrics_ok, CASE WHEN event_id % 4 <> 0 THEN 'http://localhost:' || (9000 + event_id % 4) || '/metrics' END AS metrics_url,
  CASE WHEN event_id % 4 = 0 THEN 'no metrics_port configured' WHEN event_id % 11 = 0 THEN 'unreachable: refused' ELSE {_COUNT} || ' HA conns' END AS extra FROM events""",
)
def tunnel_health(spark, sf):
    """Unit state and metrics of every tunnel."""
    events = V.table(spark, sf, "events").withColumn("name", F.expr("concat('t', event_id)"))
    tunnels = events.select("name", F.expr("CASE event_id % 4 WHEN 0 THEN NULL ELSE 9000 + event_id % 4 END").alias("metrics_port"))
    units = events.select(
        F.expr("concat(CASE WHEN event_id % 7 = 0 THEN 'gone-' ELSE '' END, name)").alias("name"), F.col("event_type").alias("active_state"), F.lit("running").alias("sub_state")
    )
    quiet = V.hit("event_id", 11)
    scrapes = events.select(
        "name", F.when(~quiet, _body()).alias("body"), F.when(quiet, "refused").alias("error")
    )
    return fleet.tunnel_status(tunnels, units, scrapes)


# -- declared instances -------------------------------------------------------
_DECLARED = """(SELECT lower(p_type) AS type, CASE WHEN p_partkey % 300 = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN 'Bad_' || p_partkey ELSE 'svc-' || (p_partkey % 1900) END AS name,
  CASE WHEN p_partkey % 250 = 0 THEN NULL ELSE 5000 + p_partkey % 1990 END AS port,
  CASE p_partkey % 40 WHEN 0 THEN 'repo/img:latest' WHEN 1 THEN 'host:5000/img' ELSE 'img:' || p_size END AS image FROM part)"""


def _declared(spark, sf):
    return V.table(spark, sf, "part").select(
        F.lower("p_type").alias("type"),
        F.expr(
            "CASE WHEN p_partkey % 300 = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN concat('Bad_', p_partkey) "
            "ELSE concat('svc-', p_partkey % 1900) END"
        ).alias("name"),
        F.expr("CASE WHEN p_partkey % 250 = 0 THEN NULL ELSE 5000 + p_partkey % 1990 END").alias("port"),
        F.expr(
            "CASE p_partkey % 40 WHEN 0 THEN 'repo/img:latest' WHEN 1 THEN 'host:5000/img' ELSE concat('img:', p_size) END"
        ).alias("image"),
    )


@register(
    "instance_validation",
    f"""WITH d AS {_DECLARED}, needs AS (SELECT DISTINCT lower(p_type) AS type, lower(r_name) AS needs FROM part JOIN region ON p_size % 5 = r_regionkey
  UNION SELECT DISTINCT lower(p_type), CASE WHEN p_size % 2 = 0 THEN 'economy' ELSE 'promo' END FROM part)
SELECT type, name, 'duplicate name' AS problem FROM d WHERE name IS NOT NULL GROUP BY type, name HAVING count(*) > 1
UNION ALL SELECT NULL, 'port ' || port, 'port used twice' FROM d WHERE port IS NOT NULL GROUP BY port HAVING count(*) > 1
UNION ALL SELECT type, name, 'field missing' FROM d WHERE name IS NULL OR port IS NULL
UNION ALL SELECT type, name, 'bad name' FROM d WHERE NOT regexp_full_match(name, '[a-z0-9-]+')
UNION ALL SELECT type, name, 'floating image tag' FROM d WHERE image LIKE '%:latest' OR image = 'host:5000/img'
UNION ALL SELECT type, needs, 'dependency missing' FROM needs WHERE needs NOT IN (SELECT type FROM d)""",
)
def instance_validation(spark, sf):
    """All problems of a declared inventory."""
    declared = _declared(spark, sf)
    parts = V.table(spark, sf, "part").select(F.lower("p_type").alias("type"), "p_size")
    regions = V.table(spark, sf, "region").select(F.col("r_regionkey").alias("_r"), F.lower("r_name").alias("needs"))
    of_region = parts.join(regions, F.col("p_size") % 5 == F.col("_r")).select("type", "needs")
    of_kind = parts.select("type", F.expr("CASE WHEN p_size % 2 = 0 THEN 'economy' ELSE 'promo' END").alias("needs"))
    return fleet.validate_instances(declared, of_region.unionByName(of_kind).distinct())


@register(
    "version_drift",
    """SELECT name, declared_image, deployed_image, CASE WHEN deployed_image IS NULL THEN 'not deployed' WHEN declared_image IS NULL THEN 'not declared' ELSE 'version' END AS drift FROM (
  SELECT p_partkey || CASE WHEN p_type = 'PROMO' THEN '-next' ELSE '' END AS name, p_name || ':' || p_size AS declared_image FROM part) a
FULL JOIN (SELECT p_partkey || CASE WHEN p_type = 'ECONOMY' THEN '-old' ELSE '' END AS name, p_name || ':' || CASE WHEN p_size > 45 THEN 1 ELSE p_size END AS deployed_image FROM part) b USING (name)
WHERE declared_image IS DISTINCT FROM deployed_image""",
)
def version_drift(spark, sf):
    """Deployed images that are not the declared ones."""
    part = V.table(spark, sf, "part")
    named = "concat(p_partkey, CASE WHEN p_type = '{}' THEN '{}' ELSE '' END)"
    declared = part.select(
        F.expr(named.format("PROMO", "-next")).alias("name"), F.expr("concat(p_name, ':', p_size)").alias("image")
    )
    deployed = part.select(
        F.expr(named.format("ECONOMY", "-old")).alias("name"), F.expr("concat(p_name, ':', CASE WHEN p_size > 45 THEN 1 ELSE p_size END)").alias("image")
    )
    return fleet.version_drift(declared, deployed, ["name"])


@register(
    "orphan_volumes",
    "SELECT 'v' || c_custkey AS volume FROM customer WHERE c_custkey NOT IN (SELECT CASE o_orderstatus WHEN 'P' THEN o_custkey ELSE -o_custkey END FROM orders)",
)
def orphan_volumes(spark, sf):
    """Volumes nothing running uses."""
    volumes = V.table(spark, sf, "customer").select(F.expr("concat('v', c_custkey)").alias("volume"))
    used = V.table(spark, sf, "orders").select(
        F.expr("concat('v', CASE o_orderstatus WHEN 'P' THEN o_custkey ELSE -o_custkey END)").alias("volume")
    )
    return fleet.orphan_volumes(volumes, used)


@register(
    "outages",
    """WITH s AS (SELECT user_id, ts, event_id, event_type NOT IN ('error', 'view') AS up, max(ts) OVER (PARTITION BY user_id) AS last_ts FROM events),
c AS (SELECT *, lag(up) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s),
e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM c WHERE was IS NULL OR was <> up)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at, epoch_us(coalesce(next_ts, last_ts)) - epoch_us(ts) AS down_micros
FROM e WHERE NOT up AND epoch_us(coalesce(next_ts, last_ts)) - epoch_us(ts) > 36000000000""",
)
def outages(spark, sf):
    """Stretches down for more than ten hours, per target."""
    samples = V.table(spark, sf, "events").select(
        "user_id", "ts", F.col("event_id").alias("sample_id"), (~F.col("event_type").isin("error", "view")).alias("up")
    )
    found = fleet.outages(samples, ("user_id",), longer_than=36000, slice_seconds=86400, stage=through_table)
    return found.select("user_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "down_micros")


@register(
    "resource_alerts",
    """SELECT user_id, resource, count(*) AS readings, CAST(floor(max(reading) * 100) AS BIGINT) AS highest FROM (
  SELECT user_id, unnest(['cpu', 'memory', 'disk']) AS resource, unnest([value, value * 0.9, value * 0.8]) AS reading, unnest([90.0, 85.0, 80.0]) AS cap FROM events)
WHERE reading > cap GROUP BY ALL""",
)
def resource_alerts(spark, sf):
    """Readings above the limit of their resource."""
    samples = V.table(spark, sf, "events").select(
        "user_id", F.col("value").alias("cpu"), (F.col("value") * 0.9).alias("memory"), (F.col("value") * 0.8).alias("disk")
    )
    alerts = fleet.resource_alerts(samples, ["user_id"])
    return alerts.withColumn("highest", F.floor(F.col("highest") * 100))


@register(
    "stale_backups",
    """SELECT instance, problem FROM (
  SELECT instance, CASE WHEN finished_at IS NULL THEN 'no backup' WHEN NOT success THEN 'last backup failed' WHEN 996710400 - epoch(finished_at) > 15552000 THEN 'backup too old' END AS problem
  FROM (SELECT DISTINCT 'i' || c_custkey AS instance FROM customer UNION SELECT 'i-' || s_suppkey FROM supplier) LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY instance ORDER BY finished_at DESC, size_bytes DESC) AS rn FROM (
      SELECT 'i' || o_custkey AS instance, o_orderdate AS finished_at, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderstatus <> 'P' AS success FROM orders)
    QUALIFY rn = 1) USING (instance)) WHERE problem IS NOT NULL""",
)
def stale_backups(spark, sf):
    """Instances whose last backup is missing, failed or too old."""
    status = catalog.backup_status(runs(spark, sf), F.timestamp_seconds(F.lit(996710400)), ["instance"])
    instances = V.table(spark, sf, "customer").select(F.expr("concat('i', c_custkey)").alias("instance")).unionByName(
        V.table(spark, sf, "supplier").select(F.expr("concat('i-', s_suppkey)").alias("instance"))
    )
    return fleet.stale_backups(status, instances, ["instance"], 15552000)
