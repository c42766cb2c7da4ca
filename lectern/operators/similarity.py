"""Grouping of near-equal strings, by verified MinHash or by an exact similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import cut, cut_counting, spread

#: Cells in which grams are counted to order them; the order matters for speed only.
CELLS = 1 << 14


def components(links: DataFrame) -> DataFrame:
    """(node, group) of the nodes in ``links(a, b)``: the least node that each is linked to, near or far.

    Large-star and small-star rounds: each joins a node's neighbours to the least of them, so the
    number of rounds is logarithmic and no task holds more than one row per link."""
    # Rounds are compared by the number of links and the sum of their hashes.
    mark = {"rows": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges, seen = cut_counting(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), **mark)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), "m").where("a <> m").select("a", F.col("m").alias("b")).distinct()
        before, (edges, seen) = seen, cut_counting(small, **mark)
        if seen == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct()
            )


def similar_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all pairs of ``sets(id, grams)`` whose Jaccard similarity reaches ``similarity``.

    A prefix-filter join.  Grams are ordered from rare to frequent, by counts in ``CELLS`` cells; two
    sets that are similar share one of their first ``n - similarity * n + 1`` grams and meet there.  What
    meets is sifted in the join by bounds that every similar pair keeps (the grams from the first
    shared one on, and the bits in which the parities of the sets' hashes differ), and what is left
    is compared gram by gram.  Keys are rare grams; adaptive skew handling splits the hot ones.
    """
    spark = sets.sparkSession
    cell = F.pmod("gram", F.lit(CELLS)).alias("cell")
    counts = spark.range(CELLS).withColumnRenamed("id", "cell").join(sets.select(F.explode("grams").alias("gram")).groupBy(cell).agg(F.count("*").alias("n")), "cell", "left")
    counts = cut(counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", F.coalesce("n", F.lit(0)).alias("n")))), lambda c: c["n"]).alias("counts")))
    ordered = F.array_sort(F.transform("grams", lambda g: F.struct(F.get("counts", F.pmod(g, F.lit(CELLS)).cast("int")).alias("n"), g.alias("gram"))))
    first = F.size("grams") - F.ceil(similarity * F.size("grams") - 1e-9).cast("int") + 1
    parity = F.expr("aggregate(grams, 0L, (bits, g) -> bits ^ shiftleft(1L, cast(g & 63 AS int)))")
    keys = (
        sets.join(F.broadcast(counts))
        .select("id", F.size("grams").alias("n"), parity.alias("parity"), F.posexplode(F.slice(ordered, F.lit(1), first)).alias("at", "key"))
        .select("id", "n", "parity", "at", F.col("key.gram").alias("gram"))
    )
    a, b = keys.alias("a"), keys.alias("b")
    both = F.col("a.n") + F.col("b.n")
    most = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    need = F.ceil(similarity / (1 + similarity) * both - 1e-9)
    bounds = (most >= need) & (F.bit_count(F.col("a.parity").bitwiseXOR(F.col("b.parity"))) <= both - 2 * need)
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")) & bounds)
    return _verified(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), sets, similarity)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` whose ``sets(id, grams)`` reach ``similarity``."""
    one, other = sets.select(F.col("id").alias("a"), F.col("grams").alias("_one")), sets.select(F.col("id").alias("b"), F.col("grams").alias("_other"))
    shared = F.size(F.array_intersect("_one", "_other"))
    return pairs.join(one, "a").join(other, "b").where(shared >= similarity * (F.size("_one") + F.size("_other") - shared) - 1e-9).select("a", "b")


def similar_groups(texts: DataFrame, column: str, grams: int = 3, similarity: float = 0.8) -> DataFrame:
    """(column, group): distinct strings, those linked by similarity, near or far, in one group.

    A link is a pair whose character n-grams have a Jaccard similarity of at least ``similarity``; none
    is left out.  The group is named by its least string."""
    base = _gram_sets(texts, column, grams)
    grouped = components(similar_pairs(base, similarity)).withColumnRenamed("node", "id")
    return base.select("id").join(grouped, "id", "left").select(F.col("id").alias(column), F.coalesce("group", "id").alias("group"))


#: Bands of a signature and hashes in each: of pairs at a similarity of 0.8 four in a million share no band.
BANDS, HASHES = 24, 4


def _buckets(bands: int, hashes: int):
    """A mapInArrow function from (id, grams) to the id's buckets, one for each band of its signature."""
    factors = np.random.default_rng(11).integers(1, 1 << 62, (bands, hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            grams = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.cumsum(sizes) - sizes
            for band in range(bands):
                key = np.full(len(sizes), band, np.uint64)
                for factor in factors[band]:
                    mixed = (grams ^ (grams >> np.uint64(29))) * factor
                    least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
                    key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key.view(np.int64))], names=["id", "bucket"])

    return run


def minhash_pairs(sets: DataFrame, similarity: float, bands: int = BANDS, hashes: int = HASHES) -> DataFrame:
    """(a, b), a < b: pairs of ``sets(id, grams)`` that share a band of their signatures and are verified to reach
    ``similarity``.

    Of what meets in a bucket the join lets through only pairs within the bounds that every similar pair keeps, by
    their sizes and by the parities of their hashes; those are compared gram by gram.  A bucket holds distinct
    sets that are alike to begin with; adaptive skew handling splits the hot ones."""
    parity = F.expr("aggregate(grams, 0L, (bits, g) -> bits ^ shiftleft(1L, cast(g & 63 AS int)))")
    schema = T.StructType([sets.schema["id"], T.StructField("bucket", T.LongType())])
    placed = spread(sets.select("id", "grams").where(F.size("grams") > 0)).mapInArrow(_buckets(bands, hashes), schema)
    shared = placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    # Most buckets hold one set; what is left is small beside the signatures.
    keys = cut(placed.join(shared, "bucket", "left_semi").join(sets.select("id", F.size("grams").alias("n"), parity.alias("parity")), "id"))
    one, other = keys.alias("a"), keys.alias("b")
    both = F.col("a.n") + F.col("b.n")
    need = F.ceil(similarity / (1 + similarity) * both - 1e-9)
    bounds = (F.least("a.n", "b.n") >= need) & (F.bit_count(F.col("a.parity").bitwiseXOR(F.col("b.parity"))) <= both - 2 * need)
    met = one.join(other, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") < F.col("b.id")) & bounds)
    return _verified(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), sets, similarity)


def _gram_sets(texts: DataFrame, column: str, grams: int) -> DataFrame:
    """(id, grams): the distinct strings and the hashes of their n-grams."""
    padded = F.concat(F.lit(" " * (grams - 1)), F.col(column), F.lit(" " * (grams - 1)))
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - grams + 1), lambda i: F.substring(padded, i, grams)))
    base = texts.select(column).where(F.col(column).isNotNull()).distinct()
    return cut(base.select(F.col(column).alias("id"), F.transform(shingles, lambda s: F.xxhash64(s)).alias("grams")))


def minhash_groups(texts: DataFrame, column: str, grams: int = 3, similarity: float = 0.8) -> DataFrame:
    """As ``similar_groups``, the pairs being proposed by MinHash and verified; ``similar_groups`` is the exact way."""
    base = _gram_sets(texts, column, grams)
    grouped = components(minhash_pairs(base, similarity)).withColumnRenamed("node", "id")
    return base.select("id").join(grouped, "id", "left").select(F.col("id").alias(column), F.coalesce("group", "id").alias("group"))
