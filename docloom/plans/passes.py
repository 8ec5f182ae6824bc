"""Passes over a set of document tables, each with what it requires and provides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DocSet:
    """The tables of documents and what passes have provided for them."""

    tables: dict[str, DataFrame]
    has: frozenset[str] = frozenset()
    reports: tuple[tuple[str, str], ...] = ()

    def with_tables(self, **tables: DataFrame) -> DocSet:
        return replace(self, tables={**self.tables, **tables})


@dataclass(frozen=True)
class Pass:
    name: str
    run: Callable[[DocSet], DocSet]
    requires: frozenset[str] = field(default_factory=frozenset)
    provides: frozenset[str] = field(default_factory=frozenset)


def fingerprint(rows: DataFrame) -> str:
    """Hash of a table that does not depend on the order of rows or columns."""
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    x = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{x.n}:{x.h}"


def run_passes(docs: DocSet, passes: list[Pass]) -> DocSet:
    """Runs passes in order; one whose result is there already is skipped, one whose needs are not met is an error. All stays lazy."""
    for p in passes:
        if p.provides and p.provides <= docs.has:
            docs = replace(docs, reports=(*docs.reports, (p.name, "skipped")))
            continue
        if missing := p.requires - docs.has:
            raise ValueError(f"{p.name} needs {sorted(missing)}")
        docs = p.run(docs)
        docs = replace(docs, has=docs.has | p.provides, reports=(*docs.reports, (p.name, "ran")))
    return docs
