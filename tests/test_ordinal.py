"""Dense ordinals across many partitions equal a plain sorted enumeration."""

import random

from pyspark.sql import functions as F

from knowtrace.operators.requests import hash_id, with_ordinal


def test_ordinal_many_partitions(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 50), rnd.random(), i) for i in range(20000)]
    df = spark.createDataFrame(rows, "k int, v double, id long").repartition(37)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = with_ordinal(df, [F.col("k").asc(), F.col("v").desc(), F.col("id").asc()], "pos")
        got = {r.id: r.pos for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = {row[2]: i for i, row in enumerate(sorted(rows, key=lambda r: (r[0], -r[1], r[2])))}
    assert got == want


def test_hash_id_stable(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "n string, d int")
    ids = [r.h for r in df.select(hash_id("n", "d").alias("h")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 32
