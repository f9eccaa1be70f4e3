"""Building blocks of text stages. A stage maps a column to a column; stages run one ``withColumn`` each.

Nesting many stages in one expression would repeat each input several times over, so ``run`` gives every stage its own
projection: the plan grows by a node a stage, and nothing is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[Column], Column]

#: Unicode classes, and only a newline ends a line.
FLAGS = "(?Ud)"


def flagged(pattern: str) -> str:
    """The pattern with the usual flags, unless it brings its own."""
    return pattern if pattern.startswith("(?U") else FLAGS + pattern


def run(df: DataFrame, col: str, stages: Iterable[Stage]) -> DataFrame:
    for stage in stages:
        df = df.withColumn(col, stage(F.col(col)))
    return df


class Steps:
    """Projections that are recorded in place of a table's, and replayed on any table.

    Making a stage's expressions takes many calls into the JVM, applying them takes one; so a chain is made once per set of
    options. It stands for the table in the functions that build it.
    """

    def __init__(self) -> None:
        self._steps: list[Callable[[DataFrame], DataFrame]] = []

    def _then(self, step: Callable[[DataFrame], DataFrame]) -> Steps:
        self._steps.append(step)
        return self

    def withColumns(self, columns: dict[str, Column]) -> Steps:  # noqa: N802
        return self._then(lambda df: df.withColumns(columns))

    def withColumn(self, name: str, column: Column) -> Steps:  # noqa: N802
        return self.withColumns({name: column})

    def withColumnRenamed(self, name: str, to: str) -> Steps:  # noqa: N802
        return self._then(lambda df: df.withColumnRenamed(name, to))

    def drop(self, *names: str) -> Steps:
        return self._then(lambda df: df.drop(*names))

    def on(self, df: DataFrame) -> DataFrame:
        for step in self._steps:
            df = step(df)
        return df


def gateway() -> int:
    """Names the JVM that expressions belong to."""
    return id(SparkContext._gateway)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sub(pattern: str, replacement: str, has: str | None = None) -> Stage:
    """Replaces all matches; ``has``: text without which there is none."""
    p = flagged(pattern)
    one = lambda c: F.regexp_replace(c, F.lit(p), F.lit(replacement))
    return one if has is None else lambda c: F.when(c.contains(has), one(c)).otherwise(c)


def each(pattern: str, change: Stage, has: str | None = None) -> Stage:
    """Replaces every match by a function of it. Matches must not be empty."""
    p = flagged(pattern)

    def stage(c: Column) -> Column:
        pieces = F.zip_with(F.split(c, p, -1), F.regexp_extract_all(c, F.lit(p), F.lit(0)), lambda gap, m: F.concat(gap, F.coalesce(change(m), F.lit(""))))
        there = F.rlike(c, F.lit(p)) if has is None else c.contains(has) & F.rlike(c, F.lit(p))
        return F.when(there, F.array_join(pieces, "")).otherwise(c)

    return stage


def literal(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    return "".join(c if c.isalnum() or c == " " or ord(c) > 127 else "\\" + c for c in text)


def any_of(words: Iterable[str]) -> str:
    """Alternatives, longer ones first."""
    return "|".join(literal(w) for w in sorted(words, key=lambda w: (-len(w), w)))
