from datetime import datetime, timedelta

from burstframe.session import ensure_checkpoint_dir
from burstframe.streaming import live


def test_sessions_and_ticks(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = [0, 1, 2, 60, 61, 500]
    kind = "photo_id bigint, camera string, captured_at timestamp"
    spark.createDataFrame([(i, "c", t + timedelta(seconds=s)) for i, s in enumerate(at)], kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    live.into_parquet(live.sessions(stream, 10, 5), str(tmp_path / "out"), f"{ensure_checkpoint_dir(spark)}/s").awaitTermination()
    assert sorted(r["photos"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]
    log = [("r", 1, "tick", "scan", 5), ("r", 3, "tick", "scan", 9), ("r", 4, "stage", "rank", 0)]
    spark.createDataFrame(log, "run_id string, seq bigint, kind string, stage string, done bigint").write.parquet(str(tmp_path / "log"))
    ticks = live.latest_ticks(spark.readStream.schema("run_id string, seq bigint, kind string, stage string, done bigint").parquet(str(tmp_path / "log")))
    q = ticks.writeStream.format("memory").queryName("ticks").outputMode("complete").option("checkpointLocation", f"{ensure_checkpoint_dir(spark)}/t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("ticks").collect()] == [("r", "scan", 3, 9)]
