"""Access to the driver tables and the comparison of a Spark result with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Give a table of fewer splits than cores to all cores, before costly work on each row.

    `keys` should be what the next step groups or joins by, so that it needs no further shuffle. A
    table with enough splits stays as it is. With `rows`, there are tasks enough for about `rows` rows each, so that what a
    task holds does not grow with the table.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        tasks = max(tasks, -(-df.count() // rows))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *keys)


def oracle_rows(folder: str, sql: str):
    """Rows of an oracle query as a pandas frame."""
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(float(value)) if isinstance(value, float) else str(value)
    return str(value)


def normal_rows(names, rows) -> tuple[list[str], list[tuple]]:
    """Columns in name order, rows in value order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)
