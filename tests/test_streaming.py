from pyspark.sql import functions as F

from quarry.operators.history import HistorySpec, with_history
from quarry.streaming.history import stream_history


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("rid"), F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 3) * 60).alias("ts"), (F.col("id") % 4).cast("string").alias("e"), (F.col("id") * 7 % 11).cast("double").alias("v"))
    last = spark.createDataFrame([(10_000 + k, k, "0", 0.0) for k in range(1)], "rid long, k long, e string, v double").select("rid", F.timestamp_seconds(F.lit(1_700_900_000)).alias("ts"), "e", "v")
    for k, part in enumerate((rows.where("rid < 150"), rows.where("rid >= 150"), last, last.withColumn("rid", F.col("rid") + 1))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream_history(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "e", "ts", "v", "rid", "1 minute").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["rid"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    names = {a: HistorySpec(("e",), a, None if a in ("count", "time_since") else "v") for a in ("count", "sum", "mean", "std", "last", "deviation", "time_since")}
    want = with_history(rows.withColumn("t", F.unix_micros("ts") / 1e6), names.values(), "t", "rid", names={s: a for a, s in names.items()}).collect()
    assert len(want) == 300
    for r in want:
        for a in names:
            assert abs(got[r["rid"]][f"hist_{a}"] - r[a]) < 1e-6, (r["rid"], a)
