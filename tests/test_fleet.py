from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import rows
from stowage.operators import fleet
from stowage.sources.logs import connections

METRIC = "cloudflared_tunnel_ha_connections"


@pytest.mark.parametrize(
    ("body", "count"),
    [
        (f"# x\n{METRIC} 4\n{METRIC} 9\n", 4),
        (f"{METRIC}{{a=\"b c\"}} 2.0\r\nother 1", 2),
        (f"{METRIC} many", 0),
        ("nothing here", 0),
        ("", 0),
        (f"up 1\r{METRIC}\t3", 3),
        (f" {METRIC} 3", 0),
        (f"{METRIC} NaN", 0),
    ],
)
def test_scrape(spark, body, count):
    assert spark.createDataFrame([(body,)], "b string").select(connections(F.col("b"))).first()[0] == count


def test_duplicates_and_dangling(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    assert rows(fleet.duplicates(df, ["name"])) == [("a", 2)]
    instances = spark.createDataFrame([("i", "t1"), ("j", "gone"), ("k", "t1")], "name string, tunnel string")
    tunnels = spark.createDataFrame([("t1",)], "name string")
    assert rows(fleet.dangling(instances, tunnels, "tunnel", "name"), "name") == [("j",)]


def test_default_is_merged_only_when_absent(spark):
    default = spark.createDataFrame([("reports", "d")], "name string, endpoint string")
    rest = spark.createDataFrame([("x", "1")], "name string, endpoint string")
    assert rows(fleet.with_default(rest, default), "name", "is_default") == [("reports", True), ("x", False)]
    own = rest.unionByName(spark.createDataFrame([("reports", "mine")], "name string, endpoint string"))
    assert rows(fleet.with_default(own, default), "endpoint") == [("1",), ("mine",)]


def test_instances_keep_their_order(spark):
    data = [(i, f"i{i}", "hot" if i % 3 == 0 else f"t{i % 4}") for i in range(60)] + [(99, "lost", "none")]
    df = spark.createDataFrame(data, "ord long, name string, tunnel string")
    tunnels = spark.createDataFrame([("hot",), ("t0",), ("t1",), ("t2",), ("t3",)], "name string")
    got = fleet.instances_per_tunnel(df, tunnels, width=4).filter("tunnel = 'hot'").orderBy("rule_no").collect()
    assert [r.ord for r in got] == list(range(0, 60, 3)) and [r.rule_no for r in got] == list(range(1, 21))


def test_tunnel_status(spark):
    tunnels = spark.createDataFrame([("a", 9000), ("b", 9001), ("c", None)], "name string, metrics_port int")
    units = spark.createDataFrame([("a", "active", "running")], "name string, active_state string, sub_state string")
    scrapes = spark.createDataFrame([("a", f"{METRIC} 4", None), ("b", None, "refused")], "name string, body string, error string")
    got = rows(fleet.tunnel_status(tunnels, units, scrapes), "name", "active_state", "metrics_ok", "extra")
    assert got == [
        ("a", "active", True, "4 HA conns"),
        ("b", "unknown", False, "unreachable: refused"),
        ("c", "unknown", False, "no metrics_port configured"),
    ]


def test_instance_problems(spark):
    df = spark.createDataFrame(
        [
            ("postgres", "main", 5432, "pg:16"),
            ("postgres", "main", 5433, "pg:16"),
            ("redis", "cache", 5432, "redis:latest"),
            ("redis", None, 6380, "redis:8"),
            ("redis", "Bad_Name", 6381, "reg:5000/redis"),
            ("keycloak", "main", 8082, "kc:26"),
        ],
        "type string, name string, port int, image string",
    )
    needs = spark.createDataFrame([("keycloak", "postgres"), ("redis", "vault"), ("absent", "x")], "type string, needs string")
    got = rows(fleet.validate_instances(df, needs), "problem", "name")
    assert got == [
        ("bad name", "Bad_Name"),
        ("dependency missing", "vault"),
        ("duplicate name", "main"),
        ("field missing", None),
        ("floating image tag", "Bad_Name"),
        ("floating image tag", "cache"),
        ("port used twice", "port 5432"),
    ]


def test_drift_and_orphans(spark):
    schema = "name string, image string"
    declared = spark.createDataFrame([("a", "x:1"), ("b", "x:1"), ("c", "x:1")], schema)
    deployed = spark.createDataFrame([("a", "x:1"), ("b", "x:2"), ("d", "x:1")], schema)
    assert rows(fleet.version_drift(declared, deployed, ["name"]), "name", "drift") == [
        ("b", "version"), ("c", "not deployed"), ("d", "not declared"),
    ]
    volumes = spark.createDataFrame([("v1",), ("v2",)], "volume string")
    assert rows(fleet.orphan_volumes(volumes, volumes.filter("volume = 'v1'"))) == [("v2",)]


def test_outages(spark):
    t0 = datetime(2026, 1, 1)
    ups = {"a": "uuddduuddddd", "b": "uuuu", "c": "dddddddd"}
    data = [(k, t0 + timedelta(minutes=2 * i), i, s == "u") for k, states in ups.items() for i, s in enumerate(states)]
    df = spark.createDataFrame(data, "target string, ts timestamp_ntz, sample_id long, up boolean")
    for seconds in (120, 600, 10**6):
        got = rows(fleet.outages(df, ("target",), slice_seconds=seconds), "target", "down_micros")
        assert got == [("a", 360_000_000), ("a", 480_000_000), ("c", 840_000_000)]
    # Exactly five minutes is not longer than five minutes.
    edge = spark.createDataFrame([("x", t0, 0, False), ("x", t0 + timedelta(minutes=5), 1, True)], df.schema)
    assert fleet.outages(edge, ("target",)).count() == 0


def test_resource_and_backup_alerts(spark):
    df = spark.createDataFrame([("i", 90.0, 85.1, 10.0), ("i", 95.0, 1.0, 1.0)], "instance string, cpu double, memory double, disk double")
    assert rows(fleet.resource_alerts(df, ["instance"])) == [("i", "cpu", 1, 95.0), ("i", "memory", 1, 85.1)]
    status = spark.createDataFrame(
        [("ok", 1, True, 10), ("old", 1, True, 1000), ("bad", 1, False, 10)], "instance string, last_run int, success boolean, age_seconds long"
    )
    names = spark.createDataFrame([("ok",), ("old",), ("bad",), ("new",)], "instance string")
    assert rows(fleet.stale_backups(status, names, ["instance"], 100)) == [
        ("bad", "last backup failed"), ("new", "no backup"), ("old", "backup too old"),
    ]
