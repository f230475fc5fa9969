"""Shape of physical plans: what is cut or combined before a shuffle, and how a hot key is split."""

from pyspark.sql import functions as F

from recallgrid.operators import dialogs, ranking
from recallgrid.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(ranking.last_per_key(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], "id"))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_spread_top_k_equals_plain(spark):
    df = spark.range(5000).withColumn("k", (F.col("id") % 3 == 0).cast("int")).withColumn("v", F.col("id") % 97)
    order = [F.col("v").desc(), F.col("id")]
    plain = ranking.top_k(df, ["k"], order, 30)
    spread = ranking.top_k(df, ["k"], order, 30, spread=F.col("id"), salts=7)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))


def test_no_cross_joins(spark):
    for name in ("vector_topk", "text_search", "threshold_sweep", "point_lookup", "booking_create", "session_expiry", "trim_history"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text, name


def test_stored_ids_read_one_column(spark, tmp_path):
    from recallgrid.sources import tables

    path = str(tmp_path / "index")
    df = spark.createDataFrame([("a", 2013, 1, [1.0])], "flight_id string, year int, month int, embedding array<double>")
    tables.append_index(df, path, 1)
    assert "ReadSchema: struct<flight_id:string>" in plan(tables.stored_ids(spark, path, df.schema))


def test_hot_join_key_is_split(spark):
    """Requests joined to one row per key: AQE splits the hot side."""
    keep = {k: spark.conf.get(k) for k in (
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    try:
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.2")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        big = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.uuid().alias("v"))
        small = spark.range(60_000).withColumnRenamed("id", "k").withColumn("w", F.lit(1))
        joined = big.join(small, "k")
        assert len(joined.collect()) == 60_000
        assert "(skew=true)" in plan(joined)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_sessions_combine_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") * 0).alias("u"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"))
    text = plan(dialogs.idle_sessions(df, "u", "ts"))
    last_exchange = text.rindex("Exchange hashpartitioning")
    assert "partial_count" in text[last_exchange:]
