"""Session settings, table access and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lectern", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the operators expect."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/lectern-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    The folder is the session's ``spark.checkpoint.dir``; a folder of our own is made only in
    local mode where that is unset.  Losing an executor afterwards costs nothing but a re-read.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut(df)`` and aggregates over its rows, taken by the job that writes them."""
    seen = Observation()
    kept = cut(df.observe(seen, *(c.alias(name) for name, c in counts.items())))
    return kept, {name: seen.get[name] or 0 for name in counts}


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores where it comes in fewer partitions than there are.

    For scans of few files that feed much work a row; an input of more partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, whose lineage should be cut, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def distinct_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION (set semantics) by column name."""
    for other in others:
        first = first.unionByName(other)
    return first.distinct()


def column_or_null(df: DataFrame, name: str, kind: str):
    """``df[name]`` if the column is there, else a typed null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def counted(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): how many rows each of the checks found."""
    out = None
    for name, rows in checks.items():
        part = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = part if out is None else out.unionByName(part)
    return out
