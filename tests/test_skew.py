"""Heavy keys and salted joins."""

import pytest
from pyspark.sql import functions as F

from faultweave.operators import skew


def skewed(spark, n=40_000):
    """94 % of the rows have one key, as in the worst portfolio of the reference figures; some have none."""
    rows = spark.range(n)
    key = F.when(F.col("id") % 100 < 94, F.lit("HOT")).when(F.col("id") % 100 == 94, F.lit(None)).otherwise(F.concat(F.lit("K"), F.col("id") % 977))
    return rows.select("id", key.alias("key"))


def test_heavy_keys_are_exact(spark):
    found = {r.key: (r.n, r.share) for r in skew.heavy_keys(skewed(spark), ["key"], 0.005).collect()}
    assert found == {"HOT": (37_600, 0.94), None: (400, 0.01)}
    many = spark.range(50_000).select(F.when(F.col("id") % 50 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("c"))
    assert [tuple(r) for r in skew.heavy_keys(many, ["k", "c"], 0.02).collect()] == [(-1, "x", 1000, 0.02)]
    assert skew.heavy_keys(many.limit(0), ["k"], 0.5).count() == 0
    with pytest.raises(ValueError):
        skew.heavy_keys(many, ["k"], 1e-6)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_equal_plain_joins(spark, how):
    left = skewed(spark, 5000)
    names = spark.createDataFrame([("HOT", 1), ("HOT", 2), ("K95", 3), (None, 4)], "key string, v long")
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(skew.skewed_join(left, names, ["key"], how, spread=["id"])) == rows(left.join(names, ["key"], how))
    with pytest.raises(ValueError):
        skew.skewed_join(left, names, ["key"], "full")


def test_no_task_has_twice_the_median(spark):
    left = skewed(spark)
    right = spark.range(977).select(F.concat(F.lit("K"), "id").alias("key"), "id").withColumnRenamed("id", "v")
    right = right.unionByName(spark.createDataFrame([("HOT", -1)], "key string, v long"))
    confs = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        sizes = {}
        for name, df in (
            ("plain", left.join(right, ["key"], "left")),
            ("salted", skew.skewed_join(left, right, ["key"], "left", spread=["id"])),
        ):
            counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            sizes[name] = sorted([r["count"] for r in counts])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sizes["plain"][-1] >= 37_600
    assert len(sizes["salted"]) == 8 and sizes["salted"][-1] <= 2 * sizes["salted"][3]
