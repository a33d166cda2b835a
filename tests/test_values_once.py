"""Costly expressions of recorded values are computed once a row."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cinderframe.functions import scalars as sc


def test_scalar_fields_compute_their_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def text(number):
        seen.add(1)
        return "0x%d" % number + "0" * 40

    made = F.udf(text, StringType()).asNondeterministic()
    rows = spark.range(8, numPartitions=1).select("id", sc.scalar_fields(made("id")).alias("s")).select("id", "s.kind", "s.digits").collect()
    assert [(r["kind"], r["digits"]) for r in rows] == [("int", str(int("0x%d" % r["id"], 16) << 160)) for r in rows]
    assert seen.value == 8


def test_wide_radix_literals_are_folded_once(spark):
    """The limbs of a literal are one fold in the expression, not one for each of its uses."""
    plan = spark.range(1).select(sc.integer_digits(F.concat(F.lit("0x"), F.col("id").cast("string"))).alias("d"))._jdf.queryExecution().analyzed().toString()
    one = spark.range(1).select(sc._radix_digits(F.col("id").cast("string")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert one.count("aggregate(transform(") == len(sc._STEPS) and plan.count("aggregate(transform(") == len(sc._STEPS)
