"""The files that the stream queries read."""

from pathlib import Path

from pyspark.sql import functions as F

from faultweave.queries import catalog


def test_every_task_writes_its_part_of_both_halves(spark, tmp_path):
    rows = spark.range(0, 4000, numPartitions=8).select(F.col("id").alias("k"))
    catalog._halves(rows, f"{tmp_path}/inbox", "k")
    halves = sorted(Path(f"{tmp_path}/inbox").glob("half=*"))
    assert [h.name for h in halves] == ["half=0", "half=1"]
    assert all(len(list(h.glob("*.parquet"))) == 8 for h in halves)
    sizes = []
    for half in range(2):
        feed = catalog._feed(spark, rows.schema, f"{tmp_path}/inbox", half)

        def note(batch, batch_id):
            sizes.append(batch.count())

        writer = feed.writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == 2 and sum(sizes) == 4000 and min(sizes) > 1500
