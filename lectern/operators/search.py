"""Ranked retrieval for many queries at once: lexical, set-cosine, vector, fused and re-ranked.

Every ranking has a total order: score, then a tie value, then id.  Scores are rounded to six places
before they are compared, so that the order does not depend on the order of summation.

The set of queries is cut into blocks of a bounded size (``QUERY_BLOCK`` queries and
``QUERY_TERMS`` query terms), each of which is sent to the tasks once.  A task compares its own items
with a block in numpy, batch by batch, and keeps the k best of each query as it goes; what leaves it
is k rows a query, however many items it read.  Pairs of a query and an item are never rows, items
are never shuffled, and a word that all items share costs no more than its own occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.terms import search_terms, token_set
from lectern.session import cut, spread

RRF_K = 60
#: Queries, and terms of all its queries together, in a block that is broadcast.
QUERY_BLOCK, QUERY_TERMS = 4096, 4_000_000
#: Scores held at a time in a task.
SCORES = 4_000_000


def _found(queries: DataFrame, items: DataFrame) -> str:
    """The columns of what a task found; ids are strings or whole numbers, as they are in the inputs."""
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {items.schema['id'].dataType.simpleString()}, score double, tie double"


def _ids(array: pa.Array) -> np.ndarray:
    """Ids as an array that sorts: strings of fixed width or whole numbers."""
    values = array.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values.astype(np.int64)


class Best:
    """The ``k`` best (score, tie, id) of each query out of scores that come in batches."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.score, self.tie, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), None

    def add(self, scores: np.ndarray, which: np.ndarray, ties: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of items (rows) for the queries numbered ``which`` (columns); -inf is no hit."""
        floor = self.least[which]
        if len(ids) > self.k:
            floor = np.maximum(floor, -np.partition(-scores, self.k - 1, axis=0)[self.k - 1])
        at, column = np.nonzero((scores >= floor) & (scores > -np.inf))
        query = np.concatenate([self.query, which[column]])
        score, tie = np.concatenate([self.score, scores[at, column]]), np.concatenate([self.tie, ties[at]])
        key = ids[at] if self.id is None else np.concatenate([self.id, ids[at]])
        order = np.lexsort((key, tie, -score, query))
        query, score, tie, key = query[order], score[order], tie[order], key[order]
        fresh = np.ones(len(query), bool)
        fresh[1:] = query[1:] != query[:-1]
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(fresh, np.arange(len(query)), 0))
        kept = place < self.k
        self.query, self.score, self.tie, self.id = query[kept], score[kept], tie[kept], key[kept]
        full = place[kept] == self.k - 1
        self.least[self.query[full]] = self.score[full]

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        ids = np.zeros(0, np.int64) if self.id is None else self.id
        return pa.RecordBatch.from_arrays([pa.array(query_ids[self.query]), pa.array(ids.tolist() if ids.dtype.kind == "U" else ids), pa.array(self.score), pa.array(self.tie)], names=["query_id", "id", "score", "tie"])


def top(scored: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The best ``k`` rows of each ``group`` with their ``rank``."""
    window = Window.partitionBy(group).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, number: int) -> Iterator[pa.Table]:
    for k in range(number):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == k) if number > 1 else queries
        table = block.toArrow()
        if table.num_rows:
            yield table


def _over_blocks(queries: DataFrame, number: int, search: Callable[[pa.Table], DataFrame], k: int, columns: str) -> DataFrame:
    """The results of ``search`` for each block of queries, ranked."""
    found = None
    for block in _blocks(queries, number):
        part = search(block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], columns)
    return top(found, "query_id", k, F.desc("score"), "tie", "id").select("query_id", "id", "score", "rank")


def _tags(column: str | None, name: str) -> Column:
    return (F.col(column) if column else F.lit(None)).cast("bigint").alias(name)


def _ties(batch: pa.RecordBatch) -> np.ndarray:
    """The tie values of a batch; null comes last."""
    return np.asarray(pc.fill_null(batch.column("tie"), np.inf).to_numpy(zero_copy_only=False), np.float64)


class _Allowed:
    """Which queries take items of which tag; a query without tags takes all items."""

    def __init__(self, tags: list[list[int] | None]):
        self.every = np.array([t is None for t in tags])
        self.by_tag: dict[int, np.ndarray] = {}
        for place, own in enumerate(tags):
            for tag in own or ():
                self.by_tag.setdefault(tag, np.zeros(len(tags), bool))[place] = True

    def queries(self, tag: int | None) -> np.ndarray:
        """The numbers of the queries that take items of ``tag``."""
        named = self.by_tag.get(tag) if tag is not None else None
        return np.flatnonzero(self.every if named is None else self.every | named)

    def groups(self, tags: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of items, numbers of queries), the items of one tag at a time."""
        if self.every.all():
            yield np.arange(len(tags)), np.arange(len(self.every))
            return
        coded = pc.dictionary_encode(tags, null_encoding="encode")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        for code, tag in enumerate(coded.dictionary.to_pylist()):
            which = self.queries(tag)
            if len(which) and ends[code] < ends[code + 1]:
                yield order[ends[code] : ends[code + 1]], which


# --- lexical search and set cosine: queries as postings by term


def postings(items: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term, tf): the inverted index."""
    return items.select(key, F.explode(search_terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(items: DataFrame, terms: Column | None = None) -> DataFrame:
    """(term, df) of ``items(text)``; ``terms`` are the terms of a text, as search_terms has them."""
    words = search_terms(F.col("text")) if terms is None else terms
    return spread(items).select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


class _Postings:
    """A block of queries by term: for each term of the vocabulary the queries that have it and its weight there."""

    def __init__(self, block: pa.Table):
        ids = block.column("query_id").combine_chunks().dictionary_encode()
        terms = block.column("term").combine_chunks().dictionary_encode()
        self.ids, self.vocabulary = ids.dictionary.to_numpy(zero_copy_only=False), terms.dictionary
        query, term = ids.indices.to_numpy(zero_copy_only=False), terms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order].astype(np.int64), block.column("weight").to_numpy()[order]
        self.number = np.bincount(term, minlength=len(self.vocabulary))
        self.start = np.cumsum(self.number) - self.number
        first = np.unique(query, return_index=True)[1]
        self.allowed = _Allowed(block.column("tags").take(pa.array(first)).to_pylist())
        self.size = block.column("size").to_numpy()[first].astype(np.float64)
        self.boosts = [_Allowed([x or [] for x in block.column(c).take(pa.array(first)).to_pylist()]) for c in block.column_names if c.startswith("boost_")]
        self.phrases: dict[str, list[int]] = {}
        if "phrases" in block.column_names:
            for place, phrases in enumerate(block.column("phrases").take(pa.array(first)).to_pylist()):
                for phrase in dict.fromkeys(phrases or ()):
                    self.phrases.setdefault(phrase, []).append(place)


def _finder(phrases: dict[str, list[int]]):
    """A function from a text to the phrases it holds, all looked for in one pass where the library is there."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [p for p in phrases if p in text]
    machine = ahocorasick.Automaton()
    for phrase in phrases:
        machine.add_word(phrase, phrase)
    machine.make_automaton()
    return lambda text: {phrase for _, phrase in machine.iter(text)}


def _compare_terms(shared, k: int, cosine: bool, amounts: tuple[float, ...] = (), alone: bool = False, phrase: float = 0.0):
    """Scores of items (id, tie, tag, terms, boost_..., text) against a broadcast block of queries.

    Items gain ``amounts`` where their boost is among the query's, and ``phrase`` where they hold one of its
    phrases; only such as share a term with the query, unless ``alone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Postings = shared.value
        best, queries, find = Best(len(block.ids), k), len(block.ids), None
        rows = max(1, SCORES // queries)
        for whole in batches:
            for begin in range(0, whole.num_rows, rows):
                batch = whole.slice(begin, rows)
                lists = batch.column("terms")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                at = pc.fill_null(pc.index_in(lists.flatten(), value_set=block.vocabulary), -1).to_numpy(zero_copy_only=False)
                item = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
                met, times = np.unique(item * len(block.vocabulary) + at[at >= 0], return_counts=True)
                item, term = met // len(block.vocabulary), met % len(block.vocabulary)
                weight = np.ones(len(times)) if cosine else 1 + np.log(times)
                scores = _sums(block, item, term, weight, batch.num_rows, queries)
                if cosine:
                    scores /= np.sqrt(np.maximum(sizes, 1)[:, None] * block.size[None, :])
                met_one, scores = scores > 0, np.round(scores, 6)
                for number, amount in enumerate(amounts):
                    for places, which in block.boosts[number].groups(batch.column(f"boost_{number}")):
                        scores[np.ix_(places, which)] += amount
                if block.phrases and phrase:
                    find = find or _finder(block.phrases)
                    for place, text in enumerate(batch.column("text").to_pylist()):
                        which = sorted({q for found in (find(text) if text else ()) for q in block.phrases[found]})
                        scores[place, which] += phrase
                scores = np.where((scores > 0) & (met_one | alone), np.round(scores, 6), -np.inf)
                ids, ties = _ids(batch.column("id")), _ties(batch)
                for places, which in block.allowed.groups(batch.column("tag")):
                    best.add(scores[np.ix_(places, which)], which, ties[places], ids[places])
        yield best.rows(block.ids)

    return run


def _sums(block: _Postings, item: np.ndarray, term: np.ndarray, weight: np.ndarray, items: int, queries: int) -> np.ndarray:
    """Sums of weights over the postings of each item's terms: (items, queries)."""
    scores = np.zeros(items * queries)
    number = block.number[term]
    ends = np.cumsum(number)
    begin = 0
    while begin < len(term):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + SCORES, "right")))
        part = slice(begin, end)
        own = number[part]
        before = np.cumsum(own) - own
        at = np.repeat(block.start[term[part]] - before, own) + np.arange(own.sum())
        cells = np.repeat(item[part] * queries, own) + block.query[at]
        low = int(item[begin]) * queries
        sums = np.bincount(cells - low, weights=np.repeat(weight[part], own) * block.weight[at])
        scores[low : low + len(sums)] += sums
        begin = end
    return scores.reshape(items, queries)


def _term_search(items: DataFrame, asked: DataFrame, terms: Column, k: int, cosine: bool, same: str | None, tie: str | None, boosts: tuple[tuple[str, float], ...] = (), alone: bool = False, phrase: float = 0.0) -> DataFrame:
    spark, asked = items.sparkSession, cut(asked)
    more = [F.xxhash64(c).alias(f"boost_{n}") for n, (c, _) in enumerate(boosts)] + [F.lower("text").alias("text")] * bool(phrase)
    held = items.select("id", (F.col(tie) if tie else F.lit(0)).cast("double").alias("tie"), _tags(same, "tag"), terms.alias("terms"), *more)
    extent = asked.agg(F.count("*").alias("n"), F.approx_count_distinct("query_id").alias("queries")).first()
    number = max(1, -(-extent["n"] // QUERY_TERMS), -(-extent["queries"] // QUERY_BLOCK))
    columns = _found(asked, held)

    def search(block: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(_Postings(block))
        return held.mapInArrow(_compare_terms(shared, k, cosine, tuple(a for _, a in boosts), alone, phrase), columns)

    return _over_blocks(asked, number, search, k, columns)


def _tag_list(same: str | None) -> Column:
    return (F.when(F.col(same).isNotNull(), F.array(F.col(same).cast("bigint"))) if same else F.lit(None).cast("array<bigint>")).alias("tags")


def lexical_search(items: DataFrame, queries: DataFrame, k: int = 8, same: str | None = None, tie: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the sum over query terms, repeated ones as often as they occur, of
    (1 + ln tf) * (ln((N + 1) / (df + 1)) + 1).

    ``items(id, text)``, ``queries(query_id, text)``; ``same`` names a column of both that must be equal
    unless the query has none, while N and df stay those of all items.  Ties go to the least ``tie``,
    nulls last, then the least id."""
    terms, items = search_terms(F.col("text")), spread(items)
    asked = queries.select("query_id", _tag_list(same), F.explode(terms).alias("term")).groupBy("query_id", "tags", "term").agg(F.count("*").alias("times"))
    known = items.select(F.explode(F.array_distinct(terms)).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    weight = known.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(items.agg(F.count("*").alias("n"))))
    idf = weight.select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighed = asked.join(idf, "term").select("query_id", "tags", "term", (F.col("times") * F.col("idf")).alias("weight"), F.lit(0).alias("size"))
    return _term_search(items, weighed, terms, k, False, same, tie)


def set_search(
    items: DataFrame,
    queries: DataFrame,
    k: int = 8,
    same: str | None = None,
    tie: str | None = None,
    boosts: tuple[tuple[str, str, float], ...] = (),
    alone: bool = False,
    phrases: tuple[str, float] | None = None,
) -> DataFrame:
    """(query_id, id, score, rank) by the cosine of the sets of tokens; arguments as ``lexical_search``.

    ``boosts`` are (column of items, array column of queries, amount): what an item gains whose value is
    among the query's.  ``phrases`` are (array column of queries, amount), gained by the items that hold one
    of the phrases, case aside.  Items that share no token with the query are left out unless ``alone``."""
    items = spread(items)
    more = [F.transform(c, lambda x: F.xxhash64(x)).alias(f"boost_{n}") for n, (_, c, _) in enumerate(boosts)]
    if phrases:
        more.append(F.transform(phrases[0], lambda x: F.lower(x)).alias("phrases"))
    sets = queries.select("query_id", _tag_list(same), token_set(F.col("text")).alias("t"), *more)
    asked = sets.select("query_id", "tags", F.explode("t").alias("term"), F.lit(1.0).alias("weight"), F.size("t").alias("size"), *sets.columns[3:])
    return _term_search(items, asked, token_set(F.col("text")), k, True, same, tie, tuple((c, a) for c, _, a in boosts), alone, phrases[1] if phrases else 0.0)


# --- vector search, exact and by an index of cells


def _matrix(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows of unit length) of the vectors that have ``dimension`` numbers; others are passed over."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(sizes == dimension)
    chosen = lists if len(places) == len(lists) else lists.take(pa.array(places))
    rows = chosen.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(places), dimension)
    lengths = np.linalg.norm(rows, axis=1)
    return places, rows / np.where(lengths == 0, 1.0, lengths)[:, None]


class _Vectors:
    def __init__(self, block: pa.Table):
        lists = block.column("vector").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.dimension = int(np.bincount(sizes[~np.isnan(sizes.astype(float))].astype(np.int64)).argmax()) if lists.null_count < len(lists) else 0
        places, self.rows = _matrix(lists, self.dimension)
        self.ids = block.column("query_id").to_numpy()[places]
        self.allowed = _Allowed(block.column("tags").take(pa.array(places)).to_pylist())


def _compare_vectors(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Vectors = shared.value
        if not len(block.ids):
            return
        best, rows = Best(len(block.ids), k), max(1, SCORES // len(block.ids))
        for whole in batches:
            for begin in range(0, whole.num_rows, rows):
                batch = whole.slice(begin, rows)
                held, vectors = _matrix(batch.column("vector"), block.dimension)
                if not len(held):
                    continue
                ids, ties = _ids(batch.column("id"))[held], _ties(batch)[held]
                for places, which in block.allowed.groups(batch.column("tag").take(pa.array(held))):
                    best.add(np.round(vectors[places] @ block.rows[which].T, 6), which, ties[places], ids[places])
        yield best.rows(block.ids)

    return run


def vector_search(items: DataFrame, queries: DataFrame, k: int = 10, tag: str | None = None, tags: str | None = None, tie: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) by cosine; a vector of norm zero counts as of norm one.

    ``items(id, vector)``, ``queries(query_id, vector)``; null vectors and those of another length than the
    block's queries mostly have are passed over.  With ``tag`` (a column of items) and ``tags`` (an array
    column of queries) a query is compared with the items of its tags only, or with all where it has none."""
    spark = items.sparkSession
    held = items.select("id", "vector", (F.col(tie) if tie else F.lit(0)).cast("double").alias("tie"), _tags(tag, "tag"))
    asked = queries.select("query_id", "vector", (F.col(tags) if tags else F.lit(None)).cast("array<bigint>").alias("tags"))

    columns = _found(asked, held)

    def search(block: pa.Table) -> DataFrame:
        return held.mapInArrow(_compare_vectors(spark.sparkContext.broadcast(_Vectors(block)), k), columns)

    return _over_blocks(asked, max(1, -(-asked.count() // QUERY_BLOCK)), search, k, columns)


class CellIndex:
    """An index of vectors by cells: every vector belongs to the cell of its nearest centre.

    The centres are fitted, by spherical k-means, on a sample of at most ``sample`` vectors, the ones of
    least hash of their ids; every row is indexed.  A query looks into the ``probes`` cells whose centres
    are nearest, as few as find ``recall`` of the true neighbours of sampled vectors within the sample."""

    def __init__(self, items: DataFrame, sample: int = 1 << 15, cells: int | None = None, recall: float = 0.97, k: int = 10, rounds: int = 10, seed: int = 7):
        chosen = items.where("vector is not null").select("id", "vector").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
        sizes = pc.list_value_length(chosen).to_numpy(zero_copy_only=False)
        self.dimension = int(np.bincount(sizes.astype(np.int64)).argmax()) if len(sizes) else 0
        rows = _matrix(chosen, self.dimension)[1] if len(sizes) else np.zeros((0, 1))
        number = max(1, min(cells or int(np.sqrt(len(rows))), len(rows) or 1))
        random = np.random.default_rng(seed)
        self.centres = rows[random.choice(len(rows), number, replace=False)] if len(rows) else np.zeros((1, 1))
        for _ in range(rounds if len(rows) else 0):
            own = np.argmax(rows @ self.centres.T, axis=1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, rows)
            lengths = np.linalg.norm(sums, axis=1)
            # An empty cell keeps its centre.
            self.centres = np.where(lengths[:, None] > 0, sums / np.where(lengths == 0, 1.0, lengths)[:, None], self.centres)
        self.probes = self._probes(rows, recall, k) if len(rows) else 1

    def _probes(self, rows: np.ndarray, recall: float, k: int) -> int:
        asked = rows[:: max(1, len(rows) // 256)]
        near = np.argsort(-(asked @ rows.T), axis=1)[:, :k]
        cell = np.argmax(rows @ self.centres.T, axis=1)[near]
        order = np.argsort(np.argsort(-(asked @ self.centres.T), axis=1), axis=1)
        depth = np.sort(np.take_along_axis(order, cell, axis=1).ravel())
        return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1

    def assign(self, items: DataFrame) -> DataFrame:
        """All rows of ``items`` with their ``cell``, null where there is no vector of the dimension."""
        centres, dimension = self.centres, self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, vectors = _matrix(batch.column("vector"), dimension)
                cells = np.full(batch.num_rows, -1, np.int64)
                cells[held] = np.argmax(vectors @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, mask=cells < 0)], names=[*batch.schema.names, "cell"])

        return items.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("cell", T.LongType())]))

    def search(self, indexed: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) among the rows of ``assign`` in the cells nearest to each query."""
        centres, dimension, number = self.centres, self.dimension, probes or self.probes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, vectors = _matrix(batch.column("vector"), dimension)
                near = np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :number]
                cells: list = [None] * batch.num_rows
                for place, own in zip(held, near.tolist()):
                    cells[place] = own
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

        asked = queries.select("query_id", "vector").where("vector is not null")
        return vector_search(indexed, asked.mapInArrow(run, T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])).where("cells is not null"), k, tag="cell", tags="cells")


# --- fusion and re-ranking


def reciprocal_rank_fusion(lists: dict[str, tuple[DataFrame, float]], k: int = 8, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, <name>_rank ..., rank): ranked lists (query_id, key, rank) fused.

    Each list adds weight / (rrf_k + rank); lists of weight 0 or less are skipped.  Ties go to the
    better rank in the lists as they are given, a missing one counting as the last, then to the key."""
    used = {name: (df, w) for name, (df, w) in lists.items() if w > 0}
    parts = None
    for name, (df, weight) in used.items():
        part = df.select("query_id", "key", "rank", F.lit(name).alias("list"), F.lit(float(weight)).alias("w"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", "key").agg(
        F.round(F.sum(F.col("w") / (max(1, rrf_k) + F.col("rank"))), 6).alias("score"),
        *(F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in used),
    )
    return top(fused, "query_id", k, F.desc("score"), *(F.asc_nulls_last(f"{name}_rank") for name in used), "key")


def rerank(hits: DataFrame) -> DataFrame:
    """``hits(query_id, id, score, rank, query_text, text)`` re-ordered by whole-phrase match, then
    the share of query words present, then score, then the rank they had.  The texts are left out."""
    asked, held = F.array_distinct(search_terms(F.col("query_text"))), F.array_distinct(search_terms(F.col("text")))
    phrase = F.trim(F.regexp_replace(F.lower("query_text"), r"\s+", " "))
    text = F.regexp_replace(F.lower("text"), r"\s+", " ")
    scored = hits.withColumns(
        {
            "overlap": F.round(F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1)), 6),
            "phrase": F.when((F.length(phrase) > 0) & text.contains(phrase), 1).otherwise(0),
        }
    )
    scored = scored.withColumn("new_score", F.round(F.col("score") + F.col("overlap") + F.col("phrase"), 6)).drop("query_text", "text")
    order = Window.partitionBy("query_id").orderBy(F.desc("phrase"), F.desc("overlap"), F.desc("score"), "rank", "id")
    return scored.withColumn("new_rank", F.row_number().over(order))
