import pytest
from pyspark.sql import functions as F

from loomwork.operators import mine
from loomwork.operators.describe import describe, identifier, schema_text, typescript
from loomwork.operators.profile import percentage, profile, shape_of
from loomwork.plans.syntax import parse


def test_profile(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("few"), (F.col("id") * 0.25).alias("x"), F.concat(F.lit("u"), "id", F.lit("@example.com")).alias("mail"), F.when(F.col("id") > 5, "2024-05-06").alias("day"), F.array("id").alias("xs"), F.struct("id").alias("st"))
    p = profile(df)
    assert p["id"].unique and not p["few"].unique and [v for v, _ in p["few"].options] == [0, 1, 2] and p["few"].even
    assert p["x"].places == 2 and p["x"].type == "decimal" and p["mail"].format == "email" and p["day"].type == "date" and p["day"].nullable
    assert (p["xs"].low, p["xs"].high) == (1, 1) and p["st"].nested["id"].unique
    assert p["id"].shape[0] == "uniform"


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None)], "a int, b string")
    assert profile(df)["a"].present == 0 and profile(df.limit(0)).rows == 0
    assert parse("\n".join(schema_text("A", profile(df))))


def test_shapes():
    from statistics import NormalDist

    assert shape_of([0.1] * 10, 0, 1, (0.5, 0.29, 0, -1.2)) == ("uniform", pytest.approx(1.0))
    falling = [2.0**-i for i in range(1, 11)]
    mean = sum(s * (i + 0.5) for i, s in enumerate(falling)) / sum(falling)
    assert shape_of([s / sum(falling) for s in falling], 0, 10, (mean, 1.4, 2, 6))[0] == "exponential"
    bell = [NormalDist(5, 1.5).cdf(i + 1) - NormalDist(5, 1.5).cdf(i) for i in range(10)]
    assert shape_of(bell, 0, 10, (5, 1.5, 0, 0))[0] == "gaussian"
    two = [0.15, 0.2, 0.15, 0, 0, 0, 0, 0.15, 0.2, 0.15]
    assert shape_of(two, 0, 10, (5, 3.6, 0, -1.9))[0] == "bimodal"
    assert shape_of([0.5, 0, 0.1, 0, 0, 0.4, 0, 0, 0, 0], 0, 10, (2.5, 2.2, 0, -1))[0] == "unknown"


def test_percentages():
    assert percentage(100, 100, 90, 100, 0) == ("decimal", 0.9) and percentage(100, 3, 2, 100, 80) == ("percent", 0.8)
    assert percentage(100, 100, 0, 100, 0) is None and percentage(100, 20, 20, 90, 80) is None and percentage(1, 1, 1, 1, 0) is None


def test_parts_and_formats_of_repeated_values(spark):
    df = spark.range(400).selectExpr("concat('a', id % 5, '@example.com') AS mail", "concat('b', id, '@example.com') AS own", "'2024-05-06' AS day", "id * 0.5 AS x", "cast(null as string) AS none")
    p = profile(df)
    assert p["mail"].format == p["own"].format == "email" and p["day"].type == "date" and (p["day"].low, p["day"].has_time) == (2024, False) and p["none"].format is None
    q = profile(df, parts=set())
    assert (q["x"].low, q["x"].high, q["x"].places) == (0.0, 199.5, 1) and q["mail"].format is None and q["x"].shape is None and q["mail"].options is None
    with pytest.raises(ValueError):
        profile(df, parts={"more"})


def test_mining(spark):
    df = spark.range(300).select((F.col("id") % 17 + 1).alias("quantity"), (F.col("id") % 23 + 2).cast("double").alias("unit_price"), F.to_date(F.lit("2024-01-01")).alias("start_date"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("end_date"))
    df = df.withColumn("total", F.col("quantity") * F.col("unit_price")).withColumn("items", F.transform(F.sequence(F.lit(1), F.col("quantity").cast("int")), lambda i: F.struct(i.alias("n"))))
    found = {(r.kind, r.target, r.text) for r in mine.mine(df)}
    assert ("product", "total", "quantity * unit_price") in found and ("ordering", "start_date", "assume start_date <= end_date") in found and ("aggregate", "quantity", "count(items)") in found


def test_round_trip(spark):
    from loomwork.operators.check import Checker
    from loomwork.operators.generate import generate

    df = spark.range(60).select((F.col("id") + 100).alias("id"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("kind"), (F.col("id") % 7 / 4).alias("rate"))
    text = describe({"orders": df})
    assert "unique int in 100..159" in text and '"a" | "b"' in text
    made = generate(spark, text, seed=3)["orders"]
    assert made.count() == 60 and made.select("id").distinct().count() == 60 and Checker(text).collection(made, "Order").valid


def test_names(spark):
    assert identifier("Total Price-2") == "total_price_2" and identifier("date") == "date_" and identifier("1st") == "_1st"
    assert "id: number;" in typescript("A", profile(spark.range(3)))


def test_mining_counts_all_rows_of_a_wide_table(spark):
    """A relation whose columns are null in the first thousands of rows."""
    df = spark.range(0, 20000, 1, 1).selectExpr("id % 97 + 2.0 AS a", "id % 89 + 3.0 AS b", "id % 83 + 5.0 AS c", "id % 79 * 7.5 AS d")
    df = df.selectExpr("*", "CASE WHEN monotonically_increasing_id() >= 5000 THEN a * b END AS t")
    assert any(r.kind == "product" and r.target == "t" and r.text == "a * b" and r.support == 1.0 for r in mine.mine(df))
