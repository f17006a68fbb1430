"""A projection's versions: only changed subjects are built, readers see whole versions, a rebuild that dies leaves the last one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memlake.operators import projections


def test_rebuild_by_difference(spark, tmp_path):
    path, built = str(tmp_path / "p"), []

    def build(facts):
        built.append(facts.select("who").distinct().count())
        return facts.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))

    first = spark.range(5000).select((F.col("id") % 500).alias("who"), F.col("id").alias("x"), F.when(F.col("id") % 7 > 0, "a").alias("note"))
    assert projections.rebuild(first, "who", build, path) == (1, 500)
    # ten subjects change: three have other rows, three fewer, two are new, two are gone
    second = first.withColumn("x", F.when((F.col("who") < 3), F.col("x") + 1).otherwise(F.col("x"))).filter("not (who in (10, 11, 12) and x < 1000) and who not in (20, 21)")
    second = second.unionByName(spark.createDataFrame([(900, 1, None), (901, 2, "a")], "who long, x long, note string"))
    assert projections.rebuild(second, "who", build, path) == (2, 10)
    assert built == [500, 8]
    expected = {(r.who, r.n, r.total) for r in second.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")).collect()}
    now = projections.current(spark, path, "who")
    assert {(r.who, r.n, r.total) for r in now.collect()} == expected
    assert {r.version: r["count"] for r in now.groupBy("version").count().collect()} == {1: 492, 2: 8}
    assert projections.current(spark, path, "who", 1).count() == 500
    assert projections.rebuild(second.repartition(7), "who", build, path) == (3, 0)

    def dies(facts):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        projections.rebuild(first, "who", dies, path)
    assert {(r.who, r.n, r.total) for r in projections.current(spark, path, "who").collect()} == expected
    assert projections.rebuild(first, "who", build, path) == (4, 10)  # back again
    assert projections.current(spark, path, "who").count() == 500
