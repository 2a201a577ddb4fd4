"""First rows in hash order: equal to ranking whole strata, without a task that ranks one."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvoice.operators import sampling


@pytest.mark.parametrize("want", [1, 7, 400, None])
def test_slots_give_the_ranks_of_whole_strata(spark, want):
    rows = spark.range(6000).select((F.col("id") % 2500).alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("s"), "id")
    rows = rows.withColumn("k", F.when(F.col("id") != 17, F.col("k")))
    got = sampling.first_in_hash_order(rows, "k", 4, "s", F.lit(want).cast("int"), ["k", "id"])
    order = Window.partitionBy("s").orderBy(F.asc_nulls_last(F.md5(F.concat(F.lit("4|"), F.col("k").cast("string")))), F.asc_nulls_last("k"), "id")
    full = rows.withColumns({"have": F.count(F.lit(1)).over(Window.partitionBy("s")), "nth": F.row_number().over(order)})
    full = full.where(F.col("nth") <= want) if want else full
    assert sorted(map(repr, got.select("s", "k", "id", "have", "nth").collect())) == sorted(map(repr, full.select("s", "k", "id", "have", "nth").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    (window,) = [x for x in plan.splitlines() if "Window [row_number" in x]
    assert "_slot" in window  # not by stratum alone
