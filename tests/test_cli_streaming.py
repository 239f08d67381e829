from pyspark.sql import functions as F

from thermocline import cli
from thermocline.streaming.monthly import windowed


def test_bad_settings_and_names_exit_with_two(tmp_path, capsys):
    assert cli.main(["--config", str(tmp_path / "none.toml"), "download"]) == 2
    assert cli.main(["query", "nothing", "a", "b"]) == 2
    assert cli.main(["list"]) == 0 and "unit_anomaly" in capsys.readouterr().out


def test_stream_windows_equal_batch_groups(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.select("ts", "event_type", "value").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in")), "ts", ["event_type"], "value")
    run = stream.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {(str(r["start"])[:10], r["event_type"]): r["n"] for r in spark.table("days").collect()}
    want = {(str(r["d"]), r["event_type"]): r["count"] for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()}
    assert got == want
