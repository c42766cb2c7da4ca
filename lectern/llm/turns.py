"""The valid rows of chat_turns, which several operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_turns(turns: DataFrame, *columns: str) -> DataFrame:
    """One row per ``id``: that with the greatest ``ingested_at``.

    A null ``ingested_at`` counts as the earliest.  Of rows that tie, the one that sorts last over
    the chosen columns is taken, so that repeated runs agree.  Rows with a null ``id`` have no
    states to choose from and are left out.  The rank filter is applied before the shuffle too,
    so an ``id`` with very many states sends a few rows only.
    """
    kept = turns.select(*dict.fromkeys(("id", "ingested_at", *columns))).where("id is not null")
    order = Window.partitionBy("id").orderBy(
        F.desc_nulls_last("ingested_at"), *(F.desc_nulls_last(c) for c in kept.columns if c not in ("id", "ingested_at"))
    )
    return kept.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
