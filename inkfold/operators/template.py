"""Operators declared as SQL over named relations."""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Operator:
    """SQL text whose ``{name}`` fields are relations; call it with DataFrames of those names.

    ``/*deal a, b*/`` after a SELECT deals its rows by these columns to as many tasks as a shuffle has:
    adaptive execution would put rows of few bytes into one task, whatever work they make.
    """

    text: str

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(self.text) if name))

    def __call__(self, **frames: DataFrame) -> DataFrame:
        missing = [n for n in self.inputs if n not in frames]
        if missing:
            raise TypeError(f"relations missing: {missing}")
        session = next(iter(frames.values())).sparkSession
        tasks = session.conf.get("spark.sql.shuffle.partitions")
        return session.sql(re.sub(r"/\*deal ([^*]+)\*/", rf"/*+ REPARTITION({tasks}, \1) */", self.text), **{n: frames[n] for n in self.inputs})

    def ansi(self) -> str:
        """The text with relations as plain names; ``/*g*/`` marks a replacement of all matches, Spark's default."""
        return self.text.format(**{n: n for n in self.inputs}).replace("/*g*/", ", 'g'")
