"""Sinks: append-once tables, replaced partitions, snapshots behind a pointer, text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder ``path``."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in the folder ``path``, none if there is no such folder."""
    if not exists(spark, path):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]


class CollisionError(ValueError):
    """Rows of equal identity and different content."""


def append_once(new: DataFrame, path: str, key: str, content: str) -> int:
    """Appends the rows of ``new`` whose ``key`` is not in the table yet; the number appended.

    Equal keys with unequal ``content`` are an error, before anything is written."""
    spark = new.sparkSession
    rows = new.dropDuplicates([key, content])
    twice = rows.groupBy(key).count().where("count > 1").limit(1).count()
    held = spark.read.parquet(path).select(key, F.col(content).alias("_held")) if exists(spark, f"{path}/_SUCCESS") else None
    if held is not None:
        twice = twice or rows.join(held, key).where(~F.col(content).eqNullSafe(F.col("_held"))).limit(1).count()
        rows = rows.join(held.select(key), key, "left_anti")
    if twice:
        raise CollisionError(f"{key} with different {content}")
    number = rows.count()
    rows.write.mode("append").parquet(path)
    return number


def replace_partitions(new: DataFrame, path: str, *by: str) -> None:
    """Overwrites the partitions that ``new`` has rows for, and no others."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in folder_names(spark, f"{root}/pointers") if n.isdigit() and exists(spark, f"{root}/pointers/{n}/_SUCCESS"))


def publish(tables: dict[str, DataFrame], root: str, version: str, problems: DataFrame) -> str:
    """Writes a snapshot of ``tables`` below ``root``/``version`` and then a pointer to it.

    Pointers are numbered and never changed: readers follow the greatest complete one, so they see the
    old snapshot or the new one, never a mixture and never none.  Of two who publish at once one fails.
    Refuses if ``problems`` has rows."""
    spark = problems.sparkSession
    if problems.limit(1).count():
        raise ValueError("not published: there are problems")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    number = max(_pointers(spark, root), default=0) + 1
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("errorifexists").json(f"{root}/pointers/{number:08d}")
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version that the greatest complete pointer names, None before the first."""
    known = _pointers(spark, root)
    return spark.read.schema("version string").json(f"{root}/pointers/{known[-1]:08d}").first()["version"] if known else None


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` of the snapshot that the pointer names."""
    return spark.read.parquet(f"{root}/{current_version(spark, root)}/{name}")


def append_usage(rows: DataFrame, path: str) -> None:
    """Appends ``rows`` to a ledger of JSON lines; nulls are left out of the lines."""
    rows.write.mode("append").json(path)


def write_chapters(chapters: DataFrame, path: str) -> None:
    """One text file per chapter of ``chapters(chapter, title, header, text)``, header lines as quotes."""
    head = F.array_join(F.transform(F.map_entries("header"), lambda e: F.concat(F.lit("> "), e["key"], F.lit(": "), e["value"])), "\n")
    page = F.concat(F.lit("# "), "title", F.lit("\n\n"), head, F.lit("\n\n"), "text")
    chapters.select("chapter", page.alias("value")).repartition("chapter").write.mode("overwrite").partitionBy("chapter").text(path, lineSep="\n")
