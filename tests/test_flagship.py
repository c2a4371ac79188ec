"""The flagship query keeps its run."""
from pyspark.sql import functions as F

from catalog import modelling


def test_flagship_keeps_what_it_made(spark, tmp_path, monkeypatch):
    orders = spark.range(300).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 20).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (F.pmod(F.xxhash64("id"), F.lit(400_000)) * 1.0).alias("o_totalprice"),
        F.expr("cast(date_add(date'1995-01-01', cast(id as int)) as timestamp_ntz)").alias("o_orderdate"), F.concat(F.lit("p"), F.col("id") % 3).alias("o_orderpriority"))
    customers = spark.range(20).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), (F.col("id") % 5).cast("int").alias("c_nationkey"),
                                       (F.pmod(F.xxhash64("id"), F.lit(10_000)) * 1.0).alias("c_acctbal"), F.concat(F.lit("m"), F.col("id") % 2).alias("c_mktsegment"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    runs, run = [], modelling.automl.run
    monkeypatch.setitem(modelling.STANDARD, "models", ["decision_tree"])
    monkeypatch.setattr(modelling.automl, "run", lambda *a, **k: runs.append((run(*a, **k), k)) or runs[-1][0])
    assert modelling.flagship(spark, str(tmp_path)).count()
    (result, asked), = runs
    assert "saving" in result.report.steps
    keyed = modelling._orders(spark, str(tmp_path)).withColumn(modelling.automl.KEY, F.col("o_orderkey"))
    one, two = (r.predict(keyed).select(modelling.automl.KEY, "predicted").collect() for r in (result, modelling.automl.load_run(spark, asked["folder"])))
    assert sorted(one) == sorted(two) and len(one) == 300
