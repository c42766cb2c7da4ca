"""Mixing sources to target weights (problem 7).

The tokens of each source, its records in a pseudorandom order, form a stream that is cut into
blocks of one length: as many as ``BLOCK`` tokens a block ask for, their ends at equal parts of the
stream, so that the last block is as long as the others.  The mixture is a number of slots, each
filled with one block.  It is as large as the scarcest source allows, no block being used more than
``max_repeats`` times; each source gets the slots whose tokens come nearest to its share.

Slots are grouped into output shards.  The counts of each shard are multinomial draws given the
totals (multivariate hypergeometric), so every shard is a random mixture and the totals are met
exactly.  They are drawn where they are needed: the range of shards is halved again and again, each
half's counts being drawn from a seed of the range itself, so a task finds the counts of its own
shards without those of others.  Slot number i of a source with B blocks takes block p(i mod B) where
p is a pseudorandom permutation of that source and pass i div B; no block is used twice before all
are used once.  Blocks and slots meet in an equi-join by index.

Running sums over a stream are taken in two levels, by equal ranges of the hash that orders it, so
that a source of any size is spread over many tasks.

Nulls: records with a null source, a source without target or without tokens are not candidates.
Source names are compared in lower case, trimmed, with runs of other signs as one underscore.  A
target that is null or not positive, or without any record, is left out and the other shares are
scaled to sum to one.  Repeated rows are records of their own.  Empty input gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.batches import emit
from lectern.llm.tokens import VOCABULARY, with_tokens
from lectern.session import cut, table

#: Tokens of a block, blocks of an output shard, records meant for a range of the hash, and the seed.
BLOCK, SHARD, RANGE_ROWS, SEED = 512, 1024, 1 << 20, 17
#: Slots that are dealt out at random together; the draws of the library are exact below 10^9.
STRATUM = 1 << 29


def source_key(column):
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def stream(records: DataFrame, range_rows: int = RANGE_ROWS, seed: int = SEED) -> DataFrame:
    """``records(source_name, doc_id, tokens)`` with ``start``, the tokens before each in its stream."""
    rows = cut(records.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "source_name")))
    # So many equal ranges of the hash that even a source of all records has few to a range.
    ranges = max(16, -(-rows.count() // range_rows))
    rows = rows.withColumn("_range", F.floor((F.col("_hash").cast("double") / 2.0**63 + 1) / 2 * ranges))
    sums = rows.groupBy("source_name", "_range").agg(F.sum("tokens").alias("_sum"))
    earlier = Window.partitionBy("source_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source_name", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source_name", "_range").orderBy("_hash", "doc_id", "tokens", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return placed.join(base, ["source_name", "_range"]).select("source_name", "doc_id", "tokens", (F.col("_base") + F.col("_inner")).alias("start"))


def blocks_of(tokens: int, block: int = BLOCK) -> int:
    return -(-tokens // block)


def slot_totals(sizes: dict[str, int], targets: dict[str, tuple[float, int]], block: int = BLOCK) -> dict[str, int]:
    """Slots of each source of ``sizes`` tokens: shares of the greatest mixture that the caps on repeats allow.

    A source's tokens differ from its share by half a block at most."""
    usable = {s: t for s, t in targets.items() if sizes.get(s) and t[0] and t[0] > 0 and t[1] and t[1] > 0}
    if not usable:
        return {}
    scale = sum(share for share, _ in usable.values())
    whole = min(repeats * sizes[s] / (share / scale) for s, (share, repeats) in usable.items())
    slots = {}
    for s, (share, repeats) in usable.items():
        blocks = blocks_of(sizes[s], block)
        slots[s] = min(floor(whole * share / scale * blocks / sizes[s] + 0.5), repeats * blocks)
    return slots


def _strata(totals: list[int], shard: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first shard, end, first slots, counts): the totals in proportional parts of ``STRATUM`` slots at most."""
    parts, begin = max(1, -(-sum(totals) // STRATUM)), 0
    for k in range(parts):
        first = np.array([n * k // parts for n in totals], np.int64)
        counts = np.array([n * (k + 1) // parts for n in totals], np.int64) - first
        end = begin + -(-int(counts.sum()) // shard)
        yield begin, end, first, counts
        begin = end


def shards_of(totals: list[int], shard: int = SHARD) -> int:
    return max(end for _, end, _, _ in _strata(totals, shard))


def shard_counts(totals: list[int], low: int, high: int, shard: int = SHARD, seed: int = SEED) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source's place, first slot, slots) of the shards from ``low`` to before ``high``.

    The same whatever range is asked for; a range costs its own shards and the halvings above it."""

    def halve(begin: int, end: int, first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        if end <= low or begin >= high:
            return
        if end - begin == 1:
            yield from ((begin, k, int(first[k]), int(n)) for k, n in enumerate(counts) if n)
            return
        middle = (begin + end) // 2
        random = np.random.default_rng((seed, begin, end))
        left = random.multivariate_hypergeometric(counts, (middle - begin) * shard, method="marginals")
        yield from halve(begin, middle, first, left)
        yield from halve(middle, end, first + left, counts - left)

    for begin, end, first, counts in _strata(totals, shard):
        if end > begin:
            yield from halve(begin, end, first, counts)


def _permuted(index, size, *key):
    """A pseudorandom permutation of 0 .. size - 1: four Feistel rounds over the least square grid
    that holds them, walked on until inside.  A column expression; ``size`` may be a column."""
    side = F.ceil(F.sqrt(size.cast("double"))).cast("long")

    def once(value):
        left, right = F.floor(value / side), value % side
        for turn in range(4):
            left, right = right, (left + F.pmod(F.xxhash64(F.lit(turn), right, *key), side)) % side
        return left * side + right

    # The grid exceeds size by less than 2 * side + 1 places, so up to size 961 no walk is longer than
    # 64 steps; beyond, one in 10^76 would be, and is an error rather than a lost slot.
    steps = F.sequence(F.lit(1), F.lit(64))
    inside = F.aggregate(steps, once(index), lambda value, _: F.when(value < size, value).otherwise(once(value)))
    return F.when(inside < size, inside).otherwise(F.raise_error(F.lit("a walk of the permutation did not end")).cast("long"))


_DRAWN = pa.schema([("shard", pa.int64()), ("source_name", pa.string()), ("first", pa.int64()), ("count", pa.int64()), ("blocks", pa.int64())])


def block_uses(spark: SparkSession, blocks: dict[str, int], totals: dict[str, int], shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(source_name, block, shard, slot): the block in every slot of the mixture."""
    names = sorted(totals)
    slots, made = [totals[n] for n in names], [blocks[n] for n in names]
    number = shards_of(slots, shard) if names else 0
    parts = max(1, min(number, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                ids = batch.column(0).to_numpy()
                if len(ids):
                    for k, at, first, count in shard_counts(slots, int(ids[0]), int(ids[-1]) + 1, shard, seed):
                        yield k, names[at], first, count, made[at]

        return emit(rows(), _DRAWN)

    drawn = spark.range(0, number, 1, parts).mapInArrow(draw, "shard long, source_name string, first long, count long, blocks long")
    each = drawn.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    turn, index = F.floor(F.col("slot") / F.col("blocks")), F.col("slot") % F.col("blocks")
    block = _permuted(index, F.col("blocks"), turn, F.col("source_name"), F.lit(seed))
    return each.select("source_name", block.alias("block"), "shard", "slot")


def in_blocks(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """``records(source_name, start, tokens, ...)`` once for each block they reach into, with ``block`` and
    the tokens there as ``part``; ``sizes(source_name, total, blocks)``."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    joined = records.join(F.broadcast(sizes), "source_name").withColumn("_last", F.col("start") + F.col("tokens") - 1)
    # Block j holds the tokens from floor(j * total / blocks) on.
    joined = joined.withColumns({"_total": wide("total"), "_blocks": wide("blocks"), "_from": wide("start"), "_to": wide("_last")})
    at = "cast(((cast({} + 1 AS decimal(19,0)) * _blocks - 1) div _total) AS bigint)"
    pieces = joined.withColumn("block", F.explode(F.sequence(F.expr(at.format("_from")), F.expr(at.format("_to")))))
    begin, end = F.expr("cast((cast(block AS decimal(19,0)) * _total) div _blocks AS bigint)"), F.expr("cast((cast(block + 1 AS decimal(19,0)) * _total) div _blocks AS bigint)")
    part = F.least(F.col("_last") + 1, end) - F.greatest(F.col("start"), begin)
    return pieces.select(*records.columns, "block", part.alias("part"))


class Mixture:
    """The mixture of the documents under ``sf_dir``: its records, slots and targets."""

    def __init__(self, spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY, block: int = BLOCK):
        targets = {r.source_name: (r.target_share, r.max_repeats) for r in table(spark, sf_dir, "mix_targets").collect()}
        names = {name.strip().lower(): name for name in targets}
        documents = table(spark, sf_dir, "documents").select("doc_id", "text", source_key(F.col("source")).alias("source_name")).where(F.col("source_name").isin(*names))
        sized = with_tokens(documents, vocabulary=vocabulary).select("doc_id", "source_name", "tokens").where("tokens > 0")
        self.records = cut(stream(sized))
        # One row per source of the fixed table.
        sizes = {r.source_name: r.total for r in self.records.groupBy("source_name").agg(F.sum("tokens").alias("total")).collect()}
        blocks = {s: blocks_of(n, block) for s, n in sizes.items()}
        self.targets = {k: targets[v] for k, v in names.items()}
        self.sizes = spark.createDataFrame([(s, n, blocks[s]) for s, n in sizes.items()], "source_name string, total bigint, blocks bigint")
        self.slots = block_uses(spark, blocks, slot_totals(sizes, self.targets, block))

    def selected(self) -> DataFrame:
        """(source_name, doc_id, tokens, repeats, tokens_used); a record counts as used as often as the
        most used of the blocks that it lies in."""
        used = self.slots.groupBy("source_name", "block").agg(F.count("*").alias("uses"))
        return (
            in_blocks(self.records, self.sizes)
            .join(used, ["source_name", "block"])
            .groupBy("source_name", "doc_id", "start", "tokens")
            .agg(F.max("uses").alias("repeats"), F.sum(F.col("uses") * F.col("part")).alias("tokens_used"))
            .drop("start")
        )

    def shares(self, selected: DataFrame) -> DataFrame:
        wanted = selected.sparkSession.createDataFrame([(k, v[0], v[1]) for k, v in self.targets.items()], "source_name string, target_share double, max_repeats int")
        sums = selected.groupBy("source_name").agg(F.count("*").alias("records"), F.sum("tokens_used").alias("tokens_used"), F.max("repeats").alias("most_repeats"))
        whole = Window.partitionBy()  # one row per source
        return wanted.join(sums, "source_name", "left").withColumn("actual_share", F.col("tokens_used") / F.sum("tokens_used").over(whole))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_name, doc_id, tokens, repeats, tokens_used): the records of the mixture."""
    return Mixture(spark, sf_dir).selected()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_name, target_share, actual_share, records, tokens_used, most_repeats, max_repeats)."""
    mixture = Mixture(spark, sf_dir)
    return mixture.shares(mixture.selected())


def p7_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, source_name, slot, block): what fills each slot of each output shard."""
    return Mixture(spark, sf_dir).slots.select("shard", "source_name", "slot", "block")


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check, violations): what the mixture must keep, counted over all of it."""
    mixture = Mixture(spark, sf_dir)
    selected, slots = cut(mixture.selected()), cut(mixture.slots)
    shares = mixture.shares(selected)
    total = F.sum("tokens_used").over(Window.partitionBy())
    off = shares.withColumn("off", F.abs(F.coalesce("tokens_used", F.lit(0)) - F.col("target_share") * total)).where(F.col("off") > BLOCK)
    caps = selected.join(F.broadcast(shares.select("source_name", "max_repeats")), "source_name").where("repeats > max_repeats")
    passes = slots.join(F.broadcast(mixture.sizes), "source_name").groupBy("source_name", F.floor(F.col("slot") / F.col("blocks")).alias("pass"), "block").count().where("count > 1")
    sizes = slots.groupBy("shard").count()
    last = slots.agg(F.max("shard").alias("last"))
    short = sizes.join(F.broadcast(last)).where((F.col("count") > SHARD) | ((F.col("shard") < F.col("last")) & (F.col("count") < SHARD)))
    twice = slots.groupBy("source_name", "slot").count().where("count > 1")
    checks = {"share off by more than a block": off, "record above its cap": caps, "block twice in a pass": passes, "shard of another size": short, "slot filled twice": twice}
    out = None
    for name, rows in checks.items():
        part = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (p7_selection, p7_shares, p7_slots, p7_checks)}
ORACLE: dict[str, str] = {
    "p7_checks": """SELECT * FROM (VALUES ('share off by more than a block', 0::BIGINT), ('record above its cap', 0), ('block twice in a pass', 0), ('shard of another size', 0), ('slot filled twice', 0)) AS t("check", violations)""",
}
