from pyspark.sql import functions as F

from attestor.llm import common as c


def test_the_prefilter_finds_each_bit_and_is_broadcast_as_bits(spark):
    ids = spark.range(0, 4000, 2).withColumnRenamed("id", "k")
    table = spark.range(4000).withColumnRenamed("id", "k")
    bit = F.pmod(F.xxhash64("k"), F.lit(c.FILTER_BITS)) + 1
    maps = c._bitmaps(ids, bit).select(F.size("_map").alias("n"), F.aggregate("_map", F.lit(0), lambda s, x: s + F.bit_count(x)).alias("ones")).collect()
    assert {r["n"] for r in maps} == {512}  # 4 KB a bitmap; they were twice that
    assert sum(r["ones"] for r in maps) == ids.select(bit).distinct().count()
    bits = {r[0] for r in ids.select(bit).collect()}
    want = {r["k"] for r in table.select("k", bit.alias("b")).collect() if r["b"] in bits}
    assert {r["k"] for r in c.only(table, ids, "k").collect()} == want >= set(range(0, 4000, 2))
