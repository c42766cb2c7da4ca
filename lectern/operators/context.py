"""Packing ranked passages into a token budget.

The ranking is cut to the passages that could be used before it is folded, so what one question
brings into one task is bounded by its top k.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lectern.operators.passages import shortened, tokens_of


def pack_context(hits: DataFrame, budget: int = 8000, per_chapter: int = 3) -> DataFrame:
    """The hits that fit ``budget`` tokens, best first.

    ``hits(query_id, rank, key, chapter, text)``: of equal keys the best is kept, of a chapter at
    most ``per_chapter``; a passage that does not fit is passed over, but the first is shortened."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows, seen, chapters, used = [], set(), {}, 0
        for hit in group.sort_values("rank").itertuples():
            if hit.key in seen or chapters.get(hit.chapter, 0) >= per_chapter or budget <= 0:
                continue
            text, size, cut = hit.text, tokens_of(hit.text), False
            if used + size > budget:
                if rows:
                    continue
                text = shortened(text, budget)
                size, cut = tokens_of(text), True
            seen.add(hit.key)
            chapters[hit.chapter] = chapters.get(hit.chapter, 0) + 1
            used += size
            rows.append((hit.query_id, len(rows) + 1, hit.key, hit.chapter, size, cut, text))
        return pd.DataFrame(rows, columns=["query_id", "position", "key", "chapter", "tokens", "truncated", "text"])

    schema = "query_id bigint, position int, key string, chapter int, tokens int, truncated boolean, text string"
    return hits.select("query_id", "rank", "key", "chapter", "text").groupBy("query_id").applyInPandas(fold, schema)


def pack_layers(hits: DataFrame, budget: int = 8000, per_chapter: int = 3) -> DataFrame:
    """As ``pack_context`` over ``layer`` 0, 1, 2 (overview, artifact, raw) in turn: each passage is
    shortened to the room left, and only raw ones are held to the limit per chapter, which counts all."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows, seen, chapters, used = [], set(), {}, 0
        for hit in group.sort_values(["layer", "rank"]).itertuples():
            if used >= budget or (hit.layer, hit.key) in seen or (hit.layer == 2 and chapters.get(hit.chapter, 0) >= per_chapter):
                continue
            text = hit.text if tokens_of(hit.text) <= budget - used else shortened(hit.text, budget - used)
            seen.add((hit.layer, hit.key))
            chapters[hit.chapter] = chapters.get(hit.chapter, 0) + 1
            used += tokens_of(text)
            rows.append((hit.query_id, len(rows) + 1, hit.layer, hit.key, hit.chapter, tokens_of(text), len(text) < len(hit.text), text))
        return pd.DataFrame(rows, columns=["query_id", "position", "layer", "key", "chapter", "tokens", "truncated", "text"])

    schema = "query_id bigint, position int, layer int, key string, chapter int, tokens int, truncated boolean, text string"
    return hits.select("query_id", "layer", "rank", "key", "chapter", "text").groupBy("query_id").applyInPandas(fold, schema)


def render(rows: Iterator[tuple[str, str]]) -> str:
    """(header, text) pairs as one text, divided by rules."""
    return "\n\n---\n\n".join(f"[{header}]\n{text}" for header, text in rows)
