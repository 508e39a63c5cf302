"""Table functions for SQL: symbols, imports, matching lines and search terms of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Symbols:
    """symbols(text): the symbols of a Python text; none if it does not parse."""

    def eval(self, text: str) -> Iterator[tuple]:
        from veinstone.sources.symbols import parse

        for s in (parse(text or "") or ([],))[0]:
            yield s["name"], s["kind"], s["start"], s["stop"], s["exported"]


class Grep:
    """grep(text, pattern): matching lines with their numbers, at most 100."""

    def eval(self, text: str, pattern: str) -> Iterator[tuple]:
        found, asked = 0, re.compile(pattern)
        for n, line in enumerate((text or "").split("\n"), 1):
            if found < 100 and asked.search(line):
                found += 1
                yield n, line


class Lines:
    """read_lines(text, first, last): numbered lines."""

    def eval(self, text: str, first: int, last: int) -> Iterator[tuple]:
        for n, line in enumerate((text or "").split("\n"), 1):
            if first <= n <= last:
                yield n, line


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL, for use with LATERAL."""
    spark.udtf.register("symbols", udtf(Symbols, returnType="name string, kind string, start int, stop int, exported boolean"))
    spark.udtf.register("grep", udtf(Grep, returnType="line int, text string"))
    spark.udtf.register("read_lines", udtf(Lines, returnType="line int, text string"))
