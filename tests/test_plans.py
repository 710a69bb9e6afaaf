"""Plans that must not grow: what is sorted, joined or rounded."""

import duckdb
from pyspark.sql import functions as F

from lexloom.operators import dataset, media, qc


def test_only_rows_that_can_be_first_are_ranked(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 30, "rare").otherwise("hot").alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    kept = dataset.within(rows, ["k"], "h", 100)
    found = {r["k"]: r["n"] for r in kept.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found["rare"] == 30 and 100 <= found["hot"] < 400
    first = lambda df: [r["h"] for r in df.where("k = 'hot'").orderBy("h").limit(100).collect()]
    assert first(kept) == first(rows)


def test_levels_above_a_node_need_no_join(spark, sf):
    assert "Join" not in qc.cefr_qc_probe(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_route_figures_round_halves_as_sql_does(spark, tmp_path):
    # 0.125 MB and 0.375 MB: exact halves of a hundredth.
    spark.createDataFrame([(1, 1, 131072 / 2000), (2, 1, 393216 / 2000)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = {(r["id"], r["route"], r["figures"]) for r in media.media_route(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(media.ORACLES["media_route"]).fetchall())
