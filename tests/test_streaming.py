import time

from pyspark.sql import functions as F

from meridian.operators.geocode import ReverseGeocoder
from meridian.plans.derived import RADIUS, points, probes, zones
from meridian.plans.queries import reverse_geocode_fold
from meridian.streaming.enrich import enrich, windowed_counts, windowed_summary


def test_stream_gives_what_the_table_gives(spark, sf_dir, tmp_path):
    asked = probes(spark, sf_dir).select("req_id", "lat", "lon")
    source = str(tmp_path / "in")
    asked.repartition(3).write.parquet(source)
    coder = ReverseGeocoder(points(spark, sf_dir), zones(spark, sf_dir).select("zone_id", "zone_type", "name", "polygon"), search_radius=RADIUS)
    seen = []
    sinks = [lambda df, n: df.write.mode("append").parquet(str(tmp_path / "a")), lambda df, n: seen.append(df.count())]
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(source)
    enrich(stream, coder, ["req_id"], sinks, str(tmp_path / "c")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "a")), reverse_geocode_fold(spark, sf_dir)
    assert sum(seen) == want.count() and len(seen) == 3
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_windows_count_all_rows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_windows_drop_late_rows(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "ts timestamp, event_type string, value double"
    for times in (["10:00", "10:30", "12:30"], ["12:35"], ["12:36"], ["10:05", "12:40"]):  # 10:05 comes after its hour has closed
        rows = spark.createDataFrame([(t, "a", 1.0) for t in times], "t string, event_type string, value double")
        rows.selectExpr("to_timestamp('2024-01-01 ' || t || ':00') AS ts", "event_type", "value").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.start.hour, r.n) for r in spark.table("late").orderBy("start").collect()] == [(10, 2)]


def test_summary_of_samples(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(120).selectExpr("timestamp_seconds(1704067200 + id) AS ts", "id AS heap_alloc", "CAST(id % 10 AS DOUBLE) AS cpu_percent").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, heap_alloc long, cpu_percent double").parquet(source)
    windowed_summary(stream).writeStream.outputMode("complete").format("memory").queryName("peaks").trigger(availableNow=True).start().awaitTermination()
    assert [(r.samples, r.peak_heap_alloc, r.avg_cpu) for r in spark.table("peaks").orderBy("start").collect()] == [(60, 59, 4.5), (60, 119, 4.5)]
