"""Models are plugged in. A scorer or embedder is any function from a table to a table; replays make runs repeatable."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Embedder(Protocol):
    def __call__(self, texts: DataFrame) -> DataFrame:
        """(key, text) to (key, v ARRAY<DOUBLE>)."""


class Scorer(Protocol):
    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(query_id, id) to (query_id, id, score)."""


class Replay:
    """A model whose answers were recorded: joined on the keys; pairs without an answer come out with nulls."""

    def __init__(self, table: DataFrame, on: list[str]) -> None:
        self.table, self.on = table, on

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, self.on, "left")
