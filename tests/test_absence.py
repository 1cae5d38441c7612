import random

from pyspark.sql import functions as F

from stowage.streaming import absence_stream

HOUR = 3600


def test_settling_does_not_depend_on_batches():
    """Any cut into batches with a rising watermark finds the silences that the whole list has."""
    rng = random.Random(1)
    for _ in range(300):
        times = sorted(rng.sample(range(1000), rng.randint(1, 30)))
        limit, end = rng.randint(5, 80), rng.randint(0, 1200)
        want = [t for t, n in zip(times, [*times[1:], None], strict=True) if end > t + limit and (n is None or n > t + limit)]
        held, told, found, watermark = [], False, [], 0
        for t in [*times, None]:
            if t is not None and t <= end:
                last = held[0] if held else None
                held = sorted({*held, t})
                told = told and held[0] == last
            watermark = max(watermark, end if t is None else min(end, t))
            held, told, new = absence_stream.settle(held, told, watermark, limit)
            found += new
        inside = [t for t in want if t <= end]
        assert found == inside


def test_silent_and_late_senders(spark, tmp_path):
    """b stops, c pauses, d is late within the delay; what comes far too late changes nothing."""
    batches = [
        [("a", 0), ("b", 0), ("c", 0), ("d", 0)],
        [("a", 50), ("c", 20), ("d", 110)],
        [("a", 100), ("d", 55)],
        [("a", 150), ("c", 160), ("d", 160)],
        [("a", 200), ("c", 210), ("d", 210), ("b", 5)],
        [("a", 250), ("c", 250), ("d", 250)],
    ]
    landing = f"{tmp_path}/in"
    spark.createDataFrame([], "sender string, ts timestamp").write.parquet(landing)

    def start():
        stream = spark.readStream.schema("sender string, ts timestamp").parquet(landing)
        alerts = absence_stream.missing(stream, "sender", 60 * 60, "60 minutes")
        query = (
            alerts.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    for batch in batches:
        rows = [(s, (1000 + m) * 60) for s, m in batch]
        spark.createDataFrame(rows, "sender string, s long").select("sender", F.timestamp_seconds("s").alias("ts")).coalesce(
            1
        ).write.mode("append").parquet(landing)
        start()
    found = spark.read.parquet(f"{tmp_path}/out").select("sender", (F.unix_seconds("last_seen") / 60 - 1000).cast("int").alias("m"))
    # The watermark ends at 190: only b, last seen at 0, and c, silent from 20 to 160, were missed.
    assert sorted(map(tuple, found.collect())) == [("b", 0), ("c", 20)]
