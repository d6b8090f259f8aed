"""Inputs of the queries are spread by their rows."""

from paperloom import samples


def test_partitions_grow_with_the_rows(spark):
    df = spark.range(25_000).coalesce(1)
    assert samples.spread(df).rdd.getNumPartitions() == 3
    assert samples.spread(df, "id", rows=5_000).rdd.getNumPartitions() == 5
    assert samples.spread(df.limit(0)).rdd.getNumPartitions() == 1
