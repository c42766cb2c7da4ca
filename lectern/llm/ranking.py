"""One ranking from several differently-scaled scores (problem 1).

Every score stands on the scale of its group and channel (here: turn and table).  It is centred on
the median and divided by 1.4826 times the median absolute deviation of its group and channel, so
that range and units vanish and outliers do not move the scale; the logistic function squashes it
into (0, 1); an item's squashed scores are joined by their weighted geometric mean.

Where more than half of the values tie, the median absolute deviation is zero and the mean
absolute deviation (times 1.2533) stands in; where all tie, every score is 0.5.

Medians and ranks come from a distributed numbering: rows are range-partitioned and sorted by
(group, value, id), numbered inside each partition, and shifted by the counts of the group's
earlier partitions.  A group may span any number of partitions, so no task ever holds a whole
group; what is broadcast has one row per partition boundary, whatever the data.

Defined results: null and NaN scores are missing; an item without any score has no fused score and
ranks after all others.  Infinite scores squash to 0 or 1.  Repeated rows count once; of rows that
differ in the score only, the latest by time, then the greatest score.  Ties are broken by the
mean standard score, channel and id.  Rows with a null group or id are no hits and left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import cut, table

CHANNELS = {
    "statement": ("retrieved_statements", "statement_revision_id"),
    "evidence": ("retrieved_evidence", "evidence_revision_id"),
    "composition": ("retrieved_compositions", "composition_revision_id"),
}


def _number_groups(group: list[str]):
    """A mapInArrow function: ``_at`` numbers the rows of each group inside a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(batch.schema.get_field_index(c)) for c in group]
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = [k[0].as_py() for k in keys] != last
            for k in keys:
                if batch.num_rows > 1:
                    fresh[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(fresh)
            position = np.arange(batch.num_rows, dtype=np.int64)
            begin = np.zeros(batch.num_rows, np.int64)
            begin[starts] = starts
            begin = np.maximum.accumulate(begin)
            at = position - begin + 1
            if not fresh[0]:
                at[: starts[0] if len(starts) else None] += seen
            last, seen = [k[-1].as_py() for k in keys], int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "_at"])

    return run


def _numbered_parts(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted, with ``_part`` and the row's ``_at`` in its part's group."""
    ranged = (
        df.repartitionByRange(*(F.col(c) for c in group), *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    schema = T.StructType([*ranged.schema.fields, T.StructField("_at", T.LongType())])
    return cut(ranged.mapInArrow(_number_groups(group), schema))


def _pieces(parts: DataFrame, group: list[str]) -> DataFrame:
    """(*group, _pieces): each group's parts and sizes; as many at most as there are partitions."""
    sizes = parts.groupBy(*group, "_part").agg(F.max("_at").alias("_size"))
    return sizes.groupBy(*group).agg(F.collect_list(F.struct("_part", "_size")).alias("_pieces"))


def _before(piece: Column) -> Column:
    earlier = F.filter("_pieces", lambda y: y["_part"] < piece["_part"])
    return F.aggregate(earlier, F.lit(0).cast("long"), lambda total, y: total + y["_size"])


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... in ``order`` within each group.

    ``order`` must be total within a group; group columns must not be null."""
    parts = _numbered_parts(df, group, order)
    # Only groups that cross a partition boundary need a shift: two pieces a partition at most.
    crossing = _pieces(parts, group).where(F.size("_pieces") > 1)
    shifts = crossing.select(*group, F.inline(F.transform("_pieces", lambda x: F.struct(x["_part"].alias("_part"), _before(x).alias("_shift")))))
    shifted = parts.join(F.broadcast(shifts), [*group, "_part"], "left")
    return shifted.withColumn(name, F.col("_at") + F.coalesce("_shift", F.lit(0))).drop("_part", "_at", "_shift")


def _median(df: DataFrame, group: list[str], value: str, tie: str) -> DataFrame:
    """(*group, median) of the non-null values."""
    parts = _numbered_parts(df.where(F.col(value).isNotNull()).select(*group, value, tie), group, [F.col(value), F.col(tie)])
    whole = F.aggregate("_pieces", F.lit(0).cast("long"), lambda total, y: total + y["_size"])
    middle = F.array_distinct(F.array(F.floor((whole + 1) / 2), F.floor((whole + 2) / 2)))
    wanted = (
        _pieces(parts, group)
        .select(*group, "_pieces", F.explode(middle).alias("_n"))
        .select(*group, "_n", F.inline(F.transform("_pieces", lambda x: F.struct(x["_part"].alias("_part"), x["_size"].alias("_size"), _before(x).alias("_shift")))))
        .where("_n > _shift and _n <= _shift + _size")
        .select(*group, "_part", (F.col("_n") - F.col("_shift")).alias("_at"))
    )
    # The place inside a part makes the key unique: no group, however large, meets in one task.
    found = parts.join(wanted, [*group, "_part", "_at"])
    low, high = F.min(value), F.max(value)
    return found.groupBy(*group).agg(F.when(low == high, low).otherwise(low / 2 + high / 2).alias("median"))


def standardise(scores: DataFrame, group: list[str], item: str = "item", score: str = "score") -> DataFrame:
    """``scores`` with ``z``: the robust standard score within each group; null for no score."""
    known = scores.withColumn(score, F.when(~F.isnan(score), F.col(score)))
    centre = cut(_median(known, group, score, item))
    off = known.join(centre, group, "left").withColumn("_off", F.when(F.col(score) == F.col("median"), 0.0).otherwise(F.abs(F.col(score) - F.col("median"))))
    finite = F.when(F.col("_off") < float("inf"), F.col("_off"))
    spread = _median(off, group, "_off", item).withColumnRenamed("median", "_mad")
    mean = off.groupBy(*group).agg(F.avg(finite).alias("_mean"))
    wide = off.join(spread.join(mean, group), group, "left")
    scale = F.when((F.col("_mad") > 0) & (F.col("_mad") < float("inf")), 1.4826 * F.col("_mad")).otherwise(1.2533 * F.col("_mean"))
    z = F.when(F.col(score).isNull(), None).when(F.col(score) == F.col("median"), 0.0).when(scale > 0, (F.col(score) - F.col("median")) / scale)
    z = F.when(F.col(score).isNotNull(), F.coalesce(z, F.signum(F.col(score) - F.col("median")) * float("inf")))
    return wide.select(*scores.columns, F.round(z, 9).alias("z"))


def fuse(scores: DataFrame, group: str, weights: dict[str, float]) -> DataFrame:
    """(group, kind, item, fused, z): one row per item from rows (group, kind, item, channel, score).

    ``kind`` names the item's own table; ``channel`` the scale the score stands on.  Channels
    without a weight weigh 1.  An item with no score keeps its row, with null ``fused``."""
    z = standardise(scores.withColumn("_key", F.concat_ws("\u0001", "kind", "item")), [group, "channel"], "_key")
    weight = F.coalesce(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("channel")], F.lit(1.0)) if weights else F.lit(1.0)
    weight = F.when(F.col("z").isNotNull(), weight)
    # ln(1 / (1 + exp(-z))), without overflow at either end
    log_squashed = F.when(F.col("z") >= 0, -F.log1p(F.exp(-F.col("z")))).otherwise(F.col("z") - F.log1p(F.exp("z")))
    return z.groupBy(group, "kind", "item").agg(
        F.round(F.exp(F.sum(weight * log_squashed) / F.sum(weight)), 12).alias("fused"), F.round(F.sum(weight * F.col("z")) / F.sum(weight), 8).alias("z")
    )


def rank(fused: DataFrame, group: str) -> DataFrame:
    """``fused`` with ``rank``: 1 for the best item of each group."""
    order = [F.desc_nulls_last("fused"), F.desc_nulls_last("z"), F.col("kind"), F.col("item")]
    return numbered(fused, [group], order, "rank")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(turn_id, kind, item, score): every hit of a turn once."""
    parts = []
    for kind, (name, key) in CHANNELS.items():
        rows = table(spark, sf_dir, name).select("turn_id", F.col(key).alias("item"), "score", "retrieved_at")
        rows = rows.where("turn_id is not null and item is not null").withColumn("score", F.when(~F.isnan("score"), F.col("score")))
        newest = F.max(F.struct("retrieved_at", "score"))["score"]
        parts.append(rows.groupBy("turn_id", "item").agg(newest.alias("score")).select("turn_id", F.lit(kind).alias("kind"), "item", "score"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _result(ranked: DataFrame) -> DataFrame:
    return ranked.select("turn_id", F.col("kind").alias("record"), F.col("item").alias("hit_id"), F.round("fused", 6).alias("fused_score"), F.col("rank").cast("long"))


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per turn, one ranking of all hits by their own scores."""
    scores = cut(hits(spark, sf_dir)).withColumn("channel", F.col("kind"))
    return _result(rank(fuse(scores, "turn_id", {}), "turn_id"))


def p1_ranking_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p1_ranking``, but a statement or composition also takes, at half weight, the best score
    among the evidence hits of its turn that it cites."""
    own = cut(hits(spark, sf_dir))
    evidence = own.where("kind = 'evidence'").select("turn_id", F.col("item").alias("cited"), "score")
    links = None
    for kind in ("statement", "composition"):
        name, key = CHANNELS[kind]
        part = table(spark, sf_dir, name).select("turn_id", F.lit(kind).alias("kind"), F.col(key).alias("item"), F.explode("evidence_revision_ids").alias("cited"))
        links = part if links is None else links.unionByName(part)
    support = (
        links.where("turn_id is not null and item is not null").join(evidence, ["turn_id", "cited"]).groupBy("turn_id", "kind", "item").agg(F.max("score").alias("score"))
    )
    scores = own.withColumn("channel", F.col("kind")).unionByName(support.withColumn("channel", F.lit("cited evidence")))
    return _result(rank(fuse(scores, "turn_id", {"cited evidence": 0.5}), "turn_id"))


QUERIES = {"p1_ranking": p1_ranking, "p1_ranking_supported": p1_ranking_supported}


def _hits_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT turn_id, '{kind}' AS kind, {key} AS item,
        arg_max(CASE WHEN isnan(score) THEN NULL ELSE score END, (retrieved_at, coalesce(CASE WHEN isnan(score) THEN NULL ELSE score END, '-infinity'::DOUBLE))) AS score
        FROM {name} WHERE turn_id IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2, 3"""
        for kind, (name, key) in CHANNELS.items()
    )


def _ranking_sql(scores: str, weight: str) -> str:
    return f"""
WITH own AS ({_hits_sql()}),
scores AS ({scores}),
m AS (SELECT *, median(score) OVER (PARTITION BY turn_id, channel) AS med FROM scores),
d AS (SELECT *, median(abs(score - med)) OVER (PARTITION BY turn_id, channel) AS mad, avg(abs(score - med)) OVER (PARTITION BY turn_id, channel) AS mean FROM m),
z AS (SELECT *, round(CASE WHEN score IS NULL THEN NULL WHEN score = med THEN 0 ELSE (score - med) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE 1.2533 * mean END END, 9) AS z,
  {weight} AS w FROM d),
s AS (SELECT turn_id, kind, item, sum(w * z) / sum(CASE WHEN z IS NOT NULL THEN w END) AS zz,
  exp(sum(w * CASE WHEN z >= 0 THEN -ln(1 + exp(-z)) ELSE z - ln(1 + exp(z)) END) / sum(CASE WHEN z IS NOT NULL THEN w END)) AS fused FROM z GROUP BY 1, 2, 3)
SELECT turn_id, kind AS record, item AS hit_id, round(fused, 6) AS fused_score,
  row_number() OVER (PARTITION BY turn_id ORDER BY round(fused, 12) DESC NULLS LAST, round(zz, 8) DESC NULLS LAST, kind, item) AS rank FROM s"""


ORACLE = {
    "p1_ranking": _ranking_sql("SELECT *, kind AS channel FROM own", "1.0"),
    "p1_ranking_supported": _ranking_sql(
        """SELECT *, kind AS channel FROM own UNION ALL
  SELECT l.turn_id, l.kind, l.item, max(o.score), 'cited evidence' FROM (
    SELECT turn_id, 'statement' AS kind, statement_revision_id AS item, unnest(evidence_revision_ids) AS cited FROM retrieved_statements
    UNION ALL SELECT turn_id, 'composition', composition_revision_id, unnest(evidence_revision_ids) FROM retrieved_compositions) l
  JOIN own o ON o.kind = 'evidence' AND o.turn_id = l.turn_id AND o.item = l.cited
  WHERE l.item IS NOT NULL GROUP BY 1, 2, 3""",
        "CASE WHEN channel = 'cited evidence' THEN 0.5 ELSE 1.0 END",
    ),
}
