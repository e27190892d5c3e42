"""Price sources by id, and their joint run."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Feed:
    """What a source delivers: observations in the common shape, and what it could not match.

    ``captured_at`` may be a time or the date as written; checks see an unreadable one.
    """

    observations: DataFrame
    suggestions: DataFrame | None = None


class Source(Protocol):
    """A price source.

    ``read`` plans the work; nothing is read until a table is written from the feed.
    """

    id: str
    name: str
    automatable: bool
    chains: tuple[str, ...]

    def read(self, spark: SparkSession, run_at: datetime) -> Feed: ...


@dataclass(frozen=True)
class Outcome:
    """Feed of a source, or the error that kept it out."""

    source: Source
    feed: Feed | None
    error: str | None = None


@dataclass
class Registry:
    """Sources in the order in which they run."""

    sources: list[Source] = field(default_factory=list)

    def chosen(self, only: str | None = None) -> list[Source]:
        """All sources, or the one asked for."""
        if only is None:
            return list(self.sources)
        found = [s for s in self.sources if s.id == only]
        if not found:
            raise KeyError(f"no source {only!r}; there are {[s.id for s in self.sources]}")
        return found

    def read(self, spark: SparkSession, run_at: datetime, only: str | None = None) -> list[Outcome]:
        """Every chosen source; one that fails does not stop the others."""
        outcomes = []
        for source in self.chosen(only):
            try:
                outcomes.append(Outcome(source, source.read(spark, run_at)))
            except Exception as error:  # any failure of a source is a line of the run log
                outcomes.append(Outcome(source, None, str(error).splitlines()[0]))
        return outcomes


def union_all(tables: Iterable[DataFrame]) -> DataFrame:
    """Rows of all tables, by column name."""
    iterator = iter(tables)
    union = next(iterator)
    for table in iterator:
        union = union.unionByName(table, allowMissingColumns=True)
    return union


def covered_stores(observations: DataFrame) -> DataFrame:
    """Stores each source covers."""
    return observations.select("source", "store_id").distinct()


def shown_suggestions(suggestions: DataFrame, shown: int) -> DataFrame:
    """Suggestions of all sources, as many as a report shows."""
    return suggestions.orderBy(F.desc("veces"), "source", "clave").limit(shown)


def moment(value: datetime) -> Column:
    """Time of a run as a column."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
