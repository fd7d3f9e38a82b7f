"""Live, stale and evicted instances by the stream's own time, over a stop in the middle."""

import pandas as pd
from pyspark.sql import functions as F

from quarry.streaming import watch

SF = "/root/testdata/sf0.001"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STALE, EVICTED = 6 * 3600, 12 * 3600


def test_statuses_survive_a_stop(spark, tmp_path):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values("ts")[["user_id", "ts"]]
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, result = str(tmp_path / "beats"), str(tmp_path / "result")

    def run(part):
        frame = spark.createDataFrame(pd.DataFrame({"id": part.user_id.astype("int64"), "ms": part.ts.astype("datetime64[ms]").astype("int64")}))
        frame.select("id", F.timestamp_millis("ms").alias("at")).coalesce(1).write.mode("append").parquet(folder)
        told = watch.statuses(watch.file_stream(spark, folder, "id long, at timestamp"), STALE, EVICTED)
        keep = lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(result)
        q = told.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    def seen():
        order = "CASE status WHEN 'live' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END"
        rows = spark.read.parquet(result).groupBy("id").agg(F.expr(f"max_by(struct(last_heartbeat, status), struct(last_heartbeat, {order})) AS x"))
        return {r.id: tuple(r.x) for r in rows.collect()}

    def want(part):
        last = part.groupby("user_id").ts.max().astype("datetime64[ms]").astype("int64")
        age = last.max() - last
        return {i: (int(ms // 1000), "live" if age[i] < STALE * 1000 else "evicted" if age[i] > EVICTED * 1000 else "stale") for i, ms in last.items()}

    try:
        half = events.ts.quantile(0.5)
        first, rest = events[events.ts <= half], events[events.ts > half]
        run(first)
        assert seen() == want(first)
        run(rest)
        assert seen() == want(events)
        assert {s for _, s in seen().values()} == {"live", "stale", "evicted"}
    finally:
        spark.conf.set(PROVIDER, before)
