import random

from pyspark.sql import functions as F

from tidemark.operators import statistics as st


def test_a_condition_that_always_holds_is_positive_in_no_third(spark):
    """Its mean is zero by construction; the sign of what rounding leaves depends on the order of rows."""
    draw = random.Random(1)
    rows = spark.createDataFrame([("a", t, draw.uniform(-1, 1)) for t in range(3000)], "k string, t long, y double").repartition(7)
    conditions = {"long": (F.lit(True), F.lit(1)), "short": (F.lit(True), F.lit(-1)), "up": (F.col("y") > 0, F.lit(1))}
    got = {r["name"]: r.positive_thirds for r in st.conditions_outcome(rows, conditions, "y", ["k"], 1, 2).collect()}
    assert got == {"long": 0, "short": 0, "up": 3}
