"""Queries over audit chains and audit records."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import register
from stowage.operators import audit
from stowage.session import through_table

CHAIN = ["sender_id"]
_SLICE = 16


@register(
    "audit_chain_build",
    V.with_chain("SELECT sender_id, seq, prev_hash, line, sha256(line || chr(10)) AS line_sha256 FROM chain"),
)
def audit_chain_build(spark, sf):
    """Audit lines of every chain, each naming the digest of the one before."""
    return audit.build_chain(V.attempts(spark, sf), CHAIN).select(*CHAIN, "seq", "prev_hash", "line", "line_sha256")


@register(
    "audit_chain_heads",
    V.with_chain(
        "SELECT sender_id, arg_max(sha256(line || chr(10)), seq) AS head_hash, CAST(sum(strlen(line) + 1) AS BIGINT) AS log_bytes FROM chain GROUP BY ALL"
    ),
)
def audit_chain_heads(spark, sf):
    """What the next record of each chain must name."""
    return audit.chain_heads(V.built_chain(spark, sf), CHAIN)


@register(
    "audit_chain_continue",
    V.with_chain("SELECT sender_id, seq, line FROM chain"),
)
def audit_chain_continue(spark, sf):
    """Chains built in two steps, the second from the heads of the first."""
    records = V.attempts(spark, sf)
    first = audit.build_chain(records.filter("seq < 15"), CHAIN)
    heads = audit.next_heads(None, first, CHAIN)
    second = audit.build_chain(records.filter("seq >= 15"), CHAIN, heads=heads)
    return first.unionByName(second).select(*CHAIN, "seq", "line")


# Chains as log files: every 25 lines a new file; the fourth is still active.
_FILED = """
SELECT sender_id AS chain_id, CAST(seq // 25 AS BIGINT) AS file_no, seq, line FROM chain"""
_TAMPERED = """
SELECT chain_id, file_no, seq, CASE WHEN hash_no % 97 = 0 THEN replace(line, '"remote_addr":"', '"remote_addr":"9') ELSE line END AS line
FROM (SELECT f.*, row_number() OVER (PARTITION BY chain_id ORDER BY seq) * 31 + length(chain_id) * 7 + strlen(line) AS hash_no FROM filed f)
WHERE hash_no % 89 <> 0"""
V.SQL["filed"] = _FILED
V.SQL["tampered"] = _TAMPERED


def _filed(spark, sf):
    return V.built_chain(spark, sf).select(
        F.col("sender_id").alias("chain_id"),
        F.expr("seq div 25").alias("file_no"),
        "seq",
        "line",
    )


def _as_logs(lines):
    """Log rows: zero-padded names sort by age, the file past the third is active."""
    return lines.select(
        "chain_id",
        F.lpad(F.col("file_no").cast("string"), 6, "0").alias("file_id"),
        (F.col("file_no") >= 3).alias("active"),
        "seq",
        "line",
    )


def _tampered(spark, sf):
    mark = F.expr("(seq + 1) * 31 + length(chain_id) * 7 + octet_length(line)")
    edited = F.replace("line", F.lit('"remote_addr":"'), F.lit('"remote_addr":"9'))
    return (
        _filed(spark, sf)
        .withColumn("_m", mark)
        .filter("_m % 89 <> 0")
        .withColumn("line", F.when(F.col("_m") % 97 == 0, edited).otherwise(F.col("line")))
        .drop("_m")
    )


_LINKS = """
SELECT chain_id, seq, json_extract_string(line, '$.prev_hash') AS named,
  coalesce(lag(sha256(line || chr(10))) OVER (PARTITION BY chain_id ORDER BY seq), repeat('0', 64)) AS expected, lpad(CAST(file_no AS VARCHAR), 6, '0') AS file_id
FROM """


@register(
    "audit_chain_verify",
    V.with_chain("SELECT chain_id, count(*) AS n_lines, CAST(0 AS BIGINT) AS n_broken, true AS ok FROM filed GROUP BY chain_id", "filed"),
)
def audit_chain_verify(spark, sf):
    """Verification of whole chains, over files and slices."""
    rows = _as_logs(_filed(spark, sf))
    return audit.verify_chains(rows, audit.audit_order(_SLICE)).select("chain_id", "n_lines", "n_broken", "ok")


@register(
    "audit_chain_tamper",
    V.with_chain(f"SELECT chain_id, file_id, seq, named, expected FROM ({_LINKS} tampered) WHERE named <> expected", "filed", "tampered"),
)
def audit_chain_tamper(spark, sf):
    """Every link broken by edited and deleted lines."""
    rows = _as_logs(_tampered(spark, sf))
    return audit.broken_links(rows, audit.audit_order(_SLICE)).select("chain_id", "file_id", "seq", "named", "expected")


@register(
    "audit_chain_first_break",
    V.with_chain(
        f"""SELECT chain_id, count(*) AS n_lines, CAST(count(*) FILTER (named <> expected) AS BIGINT) AS n_broken, count(*) FILTER (named <> expected) = 0 AS ok,
  min(seq) FILTER (named <> expected) AS broken_seq FROM ({_LINKS} tampered) GROUP BY chain_id""",
        "filed",
        "tampered",
    ),
)
def audit_chain_first_break(spark, sf):
    """Per chain whether it is whole, and where it first breaks."""
    rows = _as_logs(_tampered(spark, sf))
    return audit.verify_chains(rows, audit.audit_order(_SLICE)).drop("broken_file")


@register(
    "audit_offsets",
    V.with_chain(
        """SELECT sender_id, seq, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY sender_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS audit_log_offset FROM chain"""
    ),
)
def audit_offsets(spark, sf):
    """Log size before each record."""
    return audit.byte_offsets(V.built_chain(spark, sf), tuple(CHAIN), _SLICE).select(*CHAIN, "seq", "audit_log_offset")


_SEAL = """SELECT sender_id, sha256(string_agg(line || chr(10), '' ORDER BY seq)) AS seal_hash,
  sha256(arg_max(line, seq) || chr(10)) AS prev_hash, count(*) AS n_lines FROM chain GROUP BY sender_id"""


@register(
    "audit_seal",
    V.with_chain(
        f"""SELECT sender_id, seal_hash, prev_hash, n_lines,
  '{{"ts":"2024-02-01T00:00:00Z","event":"seal","prev_hash":"' || prev_hash || '","seal_hash":"' || seal_hash || '"}}' AS line FROM ({_SEAL})"""
    ),
)
def audit_seal(spark, sf):
    """Seal of each sender's log: digest of the whole file in order."""
    return audit.seal_files(V.built_chain(spark, sf), ["sender_id"], F.lit("2024-02-01T00:00:00Z"))


@register(
    "audit_seal_check",
    V.with_chain(
        """SELECT sender_id AS chain_id, NOT (sender_id LIKE '%1' AND bool_or(seq = 5)) AND sender_id NOT LIKE '%2' AND sender_id NOT LIKE '%3' AS seal_ok
FROM chain GROUP BY sender_id"""
    ),
)
def audit_seal_check(spark, sf):
    """Seals recomputed over files; some lost a line later, some got a copy of their seal."""
    lines = _filed(spark, sf).select("chain_id", "seq", "line")
    sealed = audit.rotate(lines, F.lit("2024-02-01T00:00:00Z"), F.lit("sealed"))
    chosen = F.col("chain_id").endswith("1")
    seals = sealed.filter(F.col("line").contains('"seal"'))
    after = seals.filter(F.col("chain_id").endswith("2")).withColumn("seq", F.col("seq") + 1)
    before = seals.filter(F.col("chain_id").endswith("3")).withColumn("seq", F.lit(-1).cast("long"))
    lacking = sealed.filter(~(chosen & (F.col("seq") == 5) & ~F.col("line").contains('"seal"')))
    return audit.verify_seals(lacking.unionByName(after).unionByName(before)).select("chain_id", "seal_ok")


@register(
    "audit_rotate_continue",
    V.with_views(
        """SELECT chain_id, n_lines, CAST(broken_seq IS NOT NULL AS BIGINT) AS n_broken, broken_seq IS NULL AS ok,
  CASE broken_seq WHEN 15 THEN '000001' WHEN 30 THEN '000002' END AS broken_file, broken_seq
FROM (SELECT sender_id AS chain_id,
    CASE WHEN sender_id LIKE '%1' THEN 0 ELSE least(n, 15) + 1 END
    + CASE WHEN n <= 15 OR sender_id LIKE '%2' THEN 0 ELSE least(n, 30) - 14 END + greatest(n - 30, 0) AS n_lines,
    CASE WHEN sender_id LIKE '%1' AND n > 15 THEN CAST(15 AS BIGINT) WHEN sender_id LIKE '%2' AND n > 30 THEN CAST(30 AS BIGINT) END AS broken_seq
  FROM (SELECT sender_id, count(*) AS n FROM attempts GROUP BY sender_id))
WHERE n_lines > 0""",
        "attempts",
    ),
)
def audit_rotate_continue(spark, sf):
    """Logs rotated twice, each file starting from the seal before; some sealed files are lost."""
    records = V.attempts(spark, sf)
    seal = F.lit("2024-02-01T00:00:00Z")
    heads, files = None, []
    for number, upto in enumerate((15, 30)):
        part = records.filter(F.col("seq").between(upto - 15, upto - 1))
        lines = through_table(audit.build_chain(part, CHAIN, heads=heads), "rotated")
        named = lines.withColumnRenamed("sender_id", "chain_id")
        files.append(audit.rotate(named, seal, F.lit(f"{number:06d}")).withColumn("active", F.lit(False)))
        heads = audit.heads_after_seal(audit.seal_files(lines, CHAIN, seal), CHAIN)
    last = audit.build_chain(records.filter("seq >= 30"), CHAIN, heads=heads)
    active = last.select(
        F.col("sender_id").alias("chain_id"), "seq", "line", F.lit("000002").alias("file_id"), F.lit(True).alias("active")
    )
    lost = (F.col("chain_id").endswith("1") & (F.col("file_id") == "000000")) | (
        F.col("chain_id").endswith("2") & (F.col("file_id") == "000001")
    )
    logs = files[0].unionByName(files[1]).unionByName(active)
    return audit.verify_chains(logs.filter(~lost), audit.audit_order(_SLICE))


@register(
    "audit_log_status",
    V.with_chain(
        """SELECT sender_id, CAST(sum(strlen(line) + 1) AS BIGINT) AS audit_bytes, count(*) AS n_lines, max(json_extract_string(line, '$.ts')) AS last_ts FROM chain GROUP BY sender_id"""
    ),
)
def audit_log_status(spark, sf):
    """Size, lines and last time of each log."""
    return audit.log_status(V.built_chain(spark, sf), ["sender_id"])


def _records(spark, sf):
    return V.attempts(spark, sf)


@register(
    "metric_bundles_received",
    V.with_views("SELECT sender_id, event AS outcome, count(*) AS bundles FROM attempts GROUP BY ALL", "attempts"),
)
def metric_bundles_received(spark, sf):
    return audit.intake_metrics(_records(spark, sf))["bundles_received"]


@register(
    "metric_bytes_received",
    V.with_views("SELECT sender_id, CAST(sum(byte_count) AS BIGINT) AS bytes FROM attempts GROUP BY ALL", "attempts"),
)
def metric_bytes_received(spark, sf):
    return audit.intake_metrics(_records(spark, sf))["bytes_received"]


@register(
    "metric_rejected",
    V.with_views("SELECT reject_reason AS reason, count(*) AS bundles FROM attempts WHERE event = 'reject' GROUP BY ALL", "attempts"),
)
def metric_rejected(spark, sf):
    return audit.intake_metrics(_records(spark, sf))["rejected"]


@register(
    "metric_last_accept",
    V.with_views("SELECT sender_id, max(ts_text) AS last_accept_ts FROM attempts WHERE event = 'accept' GROUP BY ALL", "attempts"),
)
def metric_last_accept(spark, sf):
    return audit.intake_metrics(_records(spark, sf))["last_accept"]


@register(
    "outcome_list",
    V.with_views(
        "SELECT sender_id, bundle_id, ts_text AS ts, event FROM attempts WHERE ts_text >= '2024-01-10' AND ts_text < '2024-01-20' AND event = 'reject'",
        "attempts",
    ),
)
def outcome_list(spark, sf):
    """Outcomes in a date range, newest first."""
    rows = audit.filter_outcomes(_records(spark, sf), "2024-01-10", "2024-01-20", "reject")
    return rows.select("sender_id", "bundle_id", "ts", "event")


@register(
    "last_outcomes",
    V.with_views("SELECT event_id, event, bundle_id FROM attempts ORDER BY event_id DESC LIMIT 5", "attempts"),
)
def last_outcomes(spark, sf):
    """The five newest outcomes."""
    return audit.last_outcomes(_records(spark, sf), 5, "event_id").select("event_id", "event", "bundle_id")
