"""The stream gives what the batch gives, over several triggers."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlens.operators.windows import DAY, Measure, account_windows
from ledgerlens.streaming.scorer import streaming_windows

SCHEMA = "txn_id long, timestamp timestamp_ntz, from_account_key string, to_account_key string, amount_paid_usd double"


def test_parity_with_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=7 * i), "ABC"[i % 3], "BCA"[(i * 2) % 3], float(i)) for i in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_windows(stream, days=(1, 7), lateness="30 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["account_key"], r["timestamp"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = account_windows(spark.createDataFrame(rows, SCHEMA), [Measure("n", "count", "out", DAY), Measure("s", "sum", "in", 7 * DAY), Measure("d", "distinct", "out", 7 * DAY)]).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[(r["account_key"], r["timestamp"])]
        assert (g["out_1d_count"], g["in_7d_amount_usd"], g["out_7d_distinct_counterparties"]) == (r["n"], r["s"], r["d"])
    assert F is not None
