from pyspark.sql import functions as F

from tidemark.llm import store


def test_hot_keys_are_joined_like_others(spark):
    left = store.kept(spark.range(500).select((F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 40)).alias("k"), F.col("id").alias("v")))
    right = store.kept(left.groupBy("k").agg(F.count("*").alias("copies"), F.max("v").alias("m")).where("k <> 7"))
    want = sorted(map(tuple, left.join(right, "k", "left").select("k", "v", "copies", "m").collect()), key=str)
    for share in (1, 3, 40, 1000):
        got = store.with_hot_keys(left, right, "k", "copies", 500, share).select("k", "v", "copies", "m")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_groups_grow_with_the_bytes(spark):
    few = store.dealt(spark, 10)
    assert few == store.dealt(spark, None) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert store.dealt(spark, 1 << 40) == (1 << 18) + 1


def test_written_tables_are_read_again(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert sorted(map(tuple, store.written(df).collect())) == sorted(map(tuple, df.collect()))


def test_samples_of_tiny_shares_still_draw(spark):
    keys = spark.range(200_000).select(F.xxhash64("id").alias("h"), "id")
    assert keys.where(store.drawn(F.col("h"), 1.0)).count() == 200_000
    assert abs(keys.where(store.drawn(F.col("h"), 0.01)).count() - 2000) < 300
    least = keys.agg(F.min(F.shiftrightunsigned("h", 2)).alias("m")).first().m
    share = (least + 4096) / (1 << 62)  # below one in a hundred thousand
    assert share < 1e-5 and keys.where(store.drawn(F.col("h"), share)).count() == 1
    bound = spark.range(1).select((F.lit(1000 / 1e11) * float(1 << 62)).cast("long").alias("b")).first().b
    assert bound > 1 << 35
