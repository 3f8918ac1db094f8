"""weighted_score adds a game's scores in the order of the stored rows, as its SQL does in one thread."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from newsdesk.operators.ratings import weighted_score


def test_weighted_score_of_many_files_has_the_rows_of_its_sql(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").repartition(12).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["weighted_score"]).fetchall()
    got = __spark_entry__.queries()["weighted_score"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_weighted_score_in_order_does_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("g"), "id", (F.col("id") * 37 % 50 + 0.1).alias("s"), (F.col("id") * 11 % 13 / 10).alias("w"))
    made = [sorted(map(tuple, weighted_score(rows.repartition(n), "g", F.col("s"), F.lit(50.0), F.col("w"), F.col("id") % 3 > 0, [F.col("id")]).collect())) for n in (1, 9)]
    assert made[0] == made[1] and len(made[0]) == 7
    assert [r[:2] for r in made[0]] == sorted(map(tuple, rows.filter("id % 3 > 0").groupBy("g").count().collect()))
