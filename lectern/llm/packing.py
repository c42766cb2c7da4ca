"""Filling fixed-capacity containers with items (problem 6).

Items arrive in hash order, spread over partitions.  Each partition keeps ``OPEN`` containers of
each kind open; an item goes into the one it leaves least room in (best fit), and where none has
room the fullest is closed and a new one opened.  At the end the containers still open are merged:
those of ``MERGED`` partitions at a time are packed as items themselves, fullest first.

An item over the capacity is split into full containers and a rest; no other item is split.  A row
is sent on as soon as its place is known, so memory holds the open containers' free room only,
however many items go into one.  Only (id, size) rows are shuffled; texts are read once, for sizes.

Nulls: a null or empty text, or a null size, has no tokens and still gets a place; a null id is kept.  Repeated
rows are items of their own.  A kind with a null or non-positive capacity is left out.  Empty
input gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.batches import emit
from lectern.llm.tokens import VOCABULARY, with_tokens
from lectern.session import cut, table

#: Containers of a kind that a partition keeps open, and partitions whose leftovers are merged together.
OPEN, MERGED = 64, 64

_PLACED = pa.schema(
    [("container_kind", pa.string()), ("capacity", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("start_token", pa.int64()), ("tokens", pa.int64()), ("container_id", pa.string()), ("left", pa.int64())]
)
_PLACED_DDL = "container_kind string, capacity bigint, doc_id bigint, piece bigint, start_token bigint, tokens bigint, container_id string, left bigint"


class Shelf:
    """The open containers of one kind: (free room, number), least room first."""

    def __init__(self, capacity: int, keep: int):
        self.capacity, self.keep, self.free, self.made = capacity, keep, [], 0

    def place(self, size: int) -> int:
        """The number of the container that takes an item of ``size``, which fits the capacity."""
        at = bisect_left(self.free, (size, -1))
        if at == len(self.free):
            if len(self.free) >= self.keep:
                self.free.pop(0)
            number, room = self.made, self.capacity
            self.made += 1
        else:
            room, number = self.free.pop(at)
        insort(self.free, (room - size, number))
        return number


def _pack(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shelves = TaskContext.get().partitionId(), {}

        def rows():
            for batch in batches:
                for kind, capacity, doc, piece, start, size in zip(*(batch.column(c).to_pylist() for c in range(6))):
                    if kind not in shelves:
                        shelves[kind] = Shelf(capacity, keep)
                    yield kind, capacity, doc, piece, start, size, f"{kind}-{part}-{shelves[kind].place(size)}", None
            for kind, shelf in shelves.items():
                for room, number in shelf.free:
                    yield kind, shelf.capacity, None, None, None, shelf.capacity - room, f"{kind}-{part}-{number}", part

        return emit(rows(), _PLACED)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New container ids of leftovers that come fullest first within (group, kind)."""
    schema = pa.schema([("container_id", pa.string()), ("merged_id", pa.string())])

    def rows():
        at, shelf, first = None, None, {}
        for batch in batches:
            for group, kind, capacity, name, used in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if (group, kind) != at:
                    at, shelf, first = (group, kind), Shelf(capacity, 1 << 60), {}
                yield name, first.setdefault(shelf.place(used), name)

    return emit(rows(), schema)


def pack(items: DataFrame, capacities: dict[str, int], partitions: int | None = None) -> DataFrame:
    """Places ``items(doc_id, tokens)`` into containers of each kind in ``capacities``.

    Out: container_kind, container_id, capacity, doc_id, piece, start_token, tokens; one row per
    item and kind, or one per piece of an item over the capacity."""
    spark = items.sparkSession
    kinds = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(capacities.items()) if c and c > 0))
    each = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("size"), F.explode(kinds).alias("k")).select("k.*", "doc_id", "size")
    last = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / F.col("capacity"))
    parts = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "container_kind",
        "capacity",
        "doc_id",
        "piece",
        (F.col("piece") * F.col("capacity")).alias("start_token"),
        F.least("capacity", F.col("size") - F.col("piece") * F.col("capacity")).alias("tokens"),
    )
    parts = cut(parts)
    # Rows are numbered, for items may share an id and no two pieces a full container.
    full = parts.where("tokens = capacity").withColumn("container_id", F.concat_ws("-", "container_kind", F.lit("full"), F.monotonically_increasing_id()))
    number = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("doc_id", "container_kind")
    placed = cut(
        parts.where("tokens < capacity")
        .repartition(number, spread)
        .sortWithinPartitions(spread, "container_kind", "doc_id", "tokens")
        .mapInArrow(_pack(OPEN), _PLACED_DDL)
    )
    open_ones = placed.where("left is not null").select(F.floor(F.col("left") / MERGED).alias("group"), "container_kind", "capacity", "container_id", F.col("tokens").alias("used"))
    merged = (
        open_ones.repartition("group", "container_kind")
        .sortWithinPartitions("group", "container_kind", F.desc("used"), "container_id")
        .mapInArrow(_merge, "container_id string, merged_id string")
    )
    rows = placed.where("left is null").join(merged, "container_id", "left").withColumn("container_id", F.coalesce("merged_id", "container_id"))
    columns = ("container_kind", "container_id", "capacity", "doc_id", "piece", "start_token", "tokens")
    return rows.select(*columns).unionByName(full.select(*columns))


def _packed(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    capacities = {r.container_kind: r.capacity_tokens for r in table(spark, sf_dir, "containers").collect()}
    return pack(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=vocabulary).select("doc_id", "tokens"), capacities)


def p6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in containers of each kind."""
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_kind, containers, documents, tokens, fill): how full the containers are."""
    return (
        _packed(spark, sf_dir)
        .groupBy("container_kind", "capacity", "container_id")
        .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
        .groupBy("container_kind", "capacity")
        .agg(F.count("*").alias("containers"), F.sum("documents").alias("pieces"), F.sum("tokens").alias("tokens"))
        .withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
    )


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check, violations): what the assignment must keep, counted over all of it."""
    capacities = {r.container_kind: r.capacity_tokens for r in table(spark, sf_dir, "containers").collect()}
    sizes = cut(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "tokens"))
    placed = cut(pack(sizes, capacities))
    full = placed.groupBy("container_kind", "container_id", "capacity").agg(F.sum("tokens").alias("used"))
    each = placed.groupBy("container_kind", "capacity", "doc_id").agg(F.sum("tokens").alias("got"), F.count("*").alias("pieces"))
    both = each.join(sizes, "doc_id")
    loose = full.groupBy("container_kind", "capacity").agg((F.sum("used") / (F.count("*") * F.first("capacity"))).alias("fill")).where("fill < 0.95")
    kinds = len([c for c in capacities.values() if c and c > 0])
    lost = sizes.agg(F.count("*").alias("n")).join(each.agg(F.count("*").alias("m"))).where(F.col("n") * kinds != F.col("m"))
    checks = {"container over its capacity": full.where("used > capacity"), "document with tokens lost": both.where("got <> tokens"), "document split below the capacity": both.where("pieces > 1 and tokens <= capacity"), "documents missing": lost, "kind filled below 95 %": loose}
    out = None
    for name, rows in checks.items():
        part = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {"p6_assignment": p6_assignment, "p6_fill": p6_fill, "p6_checks": p6_checks}
ORACLE: dict[str, str] = {
    "p6_checks": """SELECT * FROM (VALUES ('container over its capacity', 0::BIGINT), ('document with tokens lost', 0), ('document split below the capacity', 0), ('documents missing', 0), ('kind filled below 95 %', 0)) AS t("check", violations)""",
}
