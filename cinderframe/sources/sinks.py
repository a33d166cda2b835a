"""Data sets that are added to and corrected: appended batches, upserted records, debug records, nested summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from cinderframe.session import written
from cinderframe.sources.reports import tri_state
from cinderframe.sources.telemetry import record_json

# Parts of an upserted data set; an upsert reads and rewrites only the parts its keys fall into.
PARTS = 64


def append_batch(lines: DataFrame, path: str, batch: int | str) -> None:
    """Text lines (`value`) as batch `batch` of a data set; the same batch written again replaces itself, so a replay adds nothing."""
    lines.select("value").write.mode("overwrite").text(f"{path}/batch={batch}")


def start_appending(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of typed events as JSON lines, one batch of the data set for each micro-batch, keyed by its id."""

    def add(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch.select(record_json(batch).alias("value")), path, batch_id)

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def upsert_json(records: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Replace the records of the given `keys` in a JSON data set and add new ones; all others stay.

    Records are dealt to `parts` by a hash of their keys. Only the parts that `records` touch are read, put together anew beside the
    data set and then overwritten, partition by partition. One writer at a time; `keys` are unique in `records`.
    """
    spark = records.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")
    fresh = written(records.select("*", part), "upsert")
    merged = fresh
    if _exists(spark, path):
        touched = fresh.select("part").distinct()
        kept = read_upserted(spark, path, records.schema, True).join(touched, "part", "left_semi")
        condition = [F.col(f"kept.{k}").eqNullSafe(F.col(f"fresh.{k}")) for k in [*keys, "part"]]
        kept = kept.alias("kept").join(fresh.select(*keys, "part").alias("fresh"), condition, "left_anti")
        # the parts are read to the end before any of them is overwritten
        merged = written(fresh.unionByName(kept.select(*fresh.columns)), "upsert")
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").json(path)


def read_upserted(spark: SparkSession, path: str, schema: StructType, with_part: bool = False) -> DataFrame:
    found = spark.read.schema(StructType([*schema.fields]).add("part", IntegerType())).json(path)
    return found if with_part else found.drop("part")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def debug_records(verdicts: DataFrame, candidate: Column, trace: Column, site: Column) -> DataFrame:
    """One text block (`value`) per checked candidate: outcome of each check as yes, no or not-evaluated, site and first trace.

    `verdicts` come from `evidence.verdict` with `status` kept; `site` is `struct<path, name, off>` or NULL.
    """
    decided = lambda check: F.when(F.col(check) != "missing_evidence", F.col(check) == "match")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    place = F.coalesce(F.concat(site["path"], F.lit("+"), site["off"]), F.lit("not-found"))
    block = F.concat_ws(
        "\n",
        F.lit("===== candidate ====="),
        field("candidate", candidate.cast("string")),
        field("execution_return_code", F.coalesce(F.col("status").cast("string"), F.lit("not-evaluated"))),
        field("returned_77", tri_state(F.col("status") == 77)),
        field("crash_pattern_matched", tri_state(decided("check_signature"))),
        field("dynamic_crash_site_found", tri_state(F.when(F.col("check_library_site").isNotNull(), F.col("check_library_site") != "missing_evidence"))),
        field("dynamic_crash_site_matched", tri_state(decided("check_library_site"))),
        field("dynamic_crash_site", place),
        F.lit("first_stack_trace:"),
        F.coalesce(trace, F.lit("<no-first-stack-trace-found>")),
        F.lit("===== end candidate ====="),
    )
    return verdicts.select(block.alias("value"))
