"""Results kept by content: a key's result is written once, whatever is run again.

A cache is a folder of Parquet parts, one a batch: `<path>/batch=<id>`. A batch writes only keys that no earlier batch holds, and writes its own part anew when it is run again, so a batch that failed halfway or is replayed
after a restart leaves each key once. A part counts once Spark has marked it as whole (_SUCCESS). All of a run's batches must come one after another, as those of a stream do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _parts(spark: SparkSession, path: str) -> dict[int, str]:
    """The whole parts of a cache by batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    found = {}
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found[int(name.removeprefix("batch="))] = s.getPath().toString()
    return found


def cached(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """What a cache holds, of batches before one if that is given; no rows of a cache that isn't there."""
    parts = [p for i, p in sorted(_parts(spark, path).items()) if before is None or i < before]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, batch: int, work: Callable[[DataFrame], DataFrame], schema: str, key: str = "file_md5", order: str = "pos") -> None:
    """Writes work(rows) for the keys of rows that no earlier batch holds. Of rows with one key the first by order is worked on; rows without a key are left out."""
    new = rows.where(F.col(key).isNotNull()).join(cached(rows.sparkSession, path, schema, batch).select(key).distinct(), key, "left_anti")
    columns = [c for c in rows.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*").select(*rows.columns)
    names = [c.strip().split()[0] for c in schema.split(",")]
    work(first).select(*names).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def fill(rows: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], schema: str, key: str = "file_md5", order: str = "pos") -> StreamingQuery:
    """Runs a stream of rows through upsert() until all that is there is done; a restart goes on with the batch that didn't end."""
    return rows.writeStream.foreachBatch(lambda df, i: upsert(df, path, i, work, schema, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
