"""Reports in folders, one folder a group: written, and read back with the group from the folder's name."""

from __future__ import annotations

import glob
import os
import uuid
from contextlib import contextmanager
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.assemble import shared_folder

#: What Spark's writer escapes in the name of a folder, and its name for a group that is null or empty.
_ESCAPED = {i: f"%{i:02X}" for i in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}
_NO_GROUP = "__HIVE_DEFAULT_PARTITION__"


def _store(batches, folder: str, name: str, run: str):
    """Writes lines (folder's value, line), sorted by value, to a file for each value; the files get their names when all of the task's are whole, the same ones if the task is run again."""
    task = TaskContext.get()
    final, hidden = f"part-{task.partitionId():05d}-{run}.json", f".part-{task.partitionId():05d}-{run}-{task.taskAttemptId()}"
    places, out, last = [], None, None
    try:
        for batch in batches:
            for value, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), lambda r: r[0]):
                if out is None or value != last:
                    if out is not None:
                        out.close()
                    place = f"{folder}/{name.translate(_ESCAPED)}={value.translate(_ESCAPED)}"
                    os.makedirs(place, exist_ok=True)
                    out, last = open(f"{place}/{hidden}", "w", encoding="utf-8", newline="\n"), value  # noqa: SIM115
                    places.append(place)
                out.writelines(f"{line}\n" for _, line in rows)
    except BaseException:
        for place in places:
            os.remove(f"{place}/{hidden}")
        raise
    finally:
        if out is not None:
            out.close()
    for place in places:
        os.replace(f"{place}/{hidden}", f"{place}/{final}")
    return iter(())


def write(rows: DataFrame, path: str, group: str = "group_name") -> None:
    """Appends rows to JSON Lines files under path, in a folder for each group.

    On a local or mounted file system tasks write the files themselves, with the same names of folders: Hadoop starts processes there to set the permissions of each file and of its checksum, and most files hold few rows."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    others = [c for c in rows.columns if c != group]
    if fs.getUri().getScheme() != "file" or not others:
        return rows.write.mode("append").partitionBy(group).json(path)
    local, run = fs.makeQualified(folder).toUri().getPath(), uuid.uuid4().hex
    os.makedirs(local, exist_ok=True)
    value = F.coalesce(F.nullif(F.make_valid_utf8(F.col(group).cast("string")), F.lit("")), F.lit(_NO_GROUP)).alias("value")
    lines = rows.select(value, F.to_json(F.struct(*others)).alias("line")).sortWithinPartitions("value")
    try:
        lines.mapInArrow(lambda batches: _store(batches, local, group, run), "done int").write.format("noop").mode("overwrite").save()
    except BaseException:
        for file in glob.iglob(f"{glob.escape(local)}/*/part-*-{run}.json"):
            os.remove(file)
        raise


@contextmanager
def _many_files(spark: SparkSession):
    """Settings for many small files: tasks list many folders each and open many files each."""
    settings = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(8 * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": "1m"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def _lines(spark: SparkSession, path: str, files: str) -> DataFrame:
    """Lines of path/<folder>/<files>. All folders are listed together."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(f"{path}/*")
    depth = len([x for x in spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().split("/") if x]) + 2
    inner = F.regexp_replace("_metadata.file_path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "")
    return lines.where(F.size(F.split(inner, "/+")) == depth)


def read(spark: SparkSession, path: str, files: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Rows of all reports path/<group>/<files>, and the lines that are none.

    Rows have the union of the files' columns (a file without a column has nulls there), group_name from the folder's name (the value, where it is written as name=value) and file, the
    path. Rejected lines are rows too: group_name, file and line. A column of a report that is named group_name or file gives way.

    The reports are listed and opened once: their lines go to a table in the shared folder, from which columns, rows and rejected lines are told."""
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    place = F.col("_metadata.file_path")
    folder = decoded(F.element_at(F.split(place, "/"), -2))
    named = F.when(folder.rlike("^[^=]+="), decoded(F.regexp_replace(folder, "^[^=]+=", ""))).otherwise(folder)
    table = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    with _many_files(spark):
        found = _lines(spark, path.rstrip("/"), files).where("trim(value) <> ''").select("value", named.alias("group_name"), decoded(place).alias("file"))
        # most lines are in few files, and those are read by few tasks
        found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "value").write.parquet(table)
    lines = spark.read.schema(found.schema).parquet(table)
    schema = spark.read.option("mode", "DROPMALFORMED").json(lines.select("value").rdd.map(lambda r: r.value)).schema
    is_row = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    columns = [c for c in schema.names if c not in ("group_name", "file")]
    rows = lines.where(is_row).withColumn("row", F.from_json("value", schema))
    return rows.select(*[F.col("row")[c].alias(c) for c in columns], "group_name", "file"), lines.where(~is_row).select("group_name", "file", F.col("value").alias("line"))
