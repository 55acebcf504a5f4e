"""Regular-expression spans as native column expressions.

A pattern's matches and the texts between them give every offset in code points:
``regexp_extract_all`` finds leftmost non-overlapping matches, ``split`` by the same
pattern the pieces around them, and a running sum of lengths places each match. Patterns
must not match the empty string. Where a run of characters must begin a match, the
patterns say so by ``\\G`` (end of the previous match) or a look-behind, which finds the
same matches and keeps the search linear on very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<m:string,start:int,end:int,before:string,after:string>>"
CHUNK = 256


def add_matches(df: DataFrame, text: str, patterns: dict[str, str], needs: dict[str, str] | None = None) -> DataFrame:
    """The rows with, per name, array<struct<m,start,end,before,after>> of the pattern's matches; empty for null text.

    needs: per name, a cheap pattern that every text with a match holds; other texts are not searched.

    ``before`` and ``after`` are up to 80 code points around a match that no other match
    covers. Each step is a projection of its own so that no search runs twice. Running sums
    go over chunks first and then inside each chunk, so a text with very many matches costs
    little more per match than one with few.
    """
    kept = df.columns

    def put(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
        return rows.select("*", *[c.alias(n) for n, c in made.items()])

    col, needs = F.col, needs or {}
    flags = {p: f"__n_{k}" for k, p in enumerate(dict.fromkeys(needs.values()))}
    rows = put(df, {f: col(text).rlike(p) for p, f in flags.items()})
    search = {n: F.regexp_extract_all(col(text), F.lit(p), F.lit(0)) for n, p in patterns.items()}
    rows = put(rows, {f"__f_{n}": F.when(col(flags[needs[n]]), c).otherwise(F.array().cast("array<string>")) if n in needs else c for n, c in search.items()})
    rows = put(rows, {f"__p_{n}": F.when(F.size(f"__f_{n}") > 0, F.split(text, p, -1)) for n, p in patterns.items()})
    rows = put(
        rows,
        {
            f"__z_{n}": F.arrays_zip(
                col(f"__f_{n}").alias("m"), F.slice(f"__p_{n}", 1, F.size(f"__f_{n}")).alias("p"), F.slice(f"__p_{n}", 2, F.size(f"__f_{n}")).alias("q")
            )
            for n in patterns
        },
    )
    rows = put(
        rows,
        {
            f"__c_{n}": F.when(
                F.size(f"__z_{n}") > 0,
                F.transform(F.sequence(F.lit(0), F.floor((F.size(f"__z_{n}") - 1) / CHUNK).cast("int")), _chunk(f"__z_{n}")),
            )
            for n in patterns
        },
    )
    rows = put(
        rows,
        {
            f"__o_{n}": F.aggregate(
                F.transform(f"__c_{n}", lambda ch: F.aggregate(ch, F.lit(0), lambda acc, x: acc + F.char_length(x["p"]) + F.char_length(x["m"]))),
                F.array(F.lit(0)),
                lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
            )
            for n in patterns
        },
    )
    placed = {
        n: F.coalesce(
            F.flatten(
                F.transform(
                    F.arrays_zip(col(f"__c_{n}").alias("c"), F.slice(f"__o_{n}", 1, F.size(f"__c_{n}")).alias("o")),
                    lambda z: F.aggregate(z["c"], F.struct(z["o"].alias("at"), F.array().cast(SPANS).alias("out")), _step)["out"],
                )
            ),
            F.array().cast(SPANS),
        )
        for n in patterns
    }
    return rows.select(*kept, *[c.alias(n) for n, c in placed.items()])


def _chunk(name: str):
    return lambda c: F.slice(name, c * CHUNK + 1, CHUNK)


def _step(acc: Column, x: Column) -> Column:
    start = acc["at"] + F.char_length(x["p"])
    end = start + F.char_length(x["m"])
    one = F.struct(
        x["m"].alias("m"), start.alias("start"), end.alias("end"), F.right(x["p"], F.lit(80)).alias("before"), F.left(x["q"], F.lit(80)).alias("after")
    )
    return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))


def chunks(items: Column) -> Column:
    """An array cut into arrays of at most CHUNK."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))).otherwise(
        F.slice(F.array(items), 1, 0)
    )


def keep_by(found: Column, spans: Column, keep) -> Column:
    """The spans of found (in order of start) for which keep(one, nearby spans) holds; nearby: those that meet the range of one's chunk.

    Each chunk looks through all spans once and each of its members through the nearby ones only.
    """
    near = F.transform(
        chunks(found),
        lambda ch: F.struct(ch.alias("own"), F.filter(spans, lambda s: (s["start"] < F.element_at(ch, -1)["end"]) & (s["end"] > F.element_at(ch, 1)["start"])).alias("near")),
    )
    return F.flatten(F.transform(near, lambda z: F.filter(z["own"], lambda one: keep(one, z["near"]))))


def outside(found: Column, spans: Column) -> Column:
    """The found spans that meet none of the others."""
    return keep_by(found, spans, lambda one, near: ~F.exists(near, lambda s: (s["start"] < one["end"]) & (s["end"] > one["start"])))


def add_merged(df: DataFrame, name: str, spans: Column) -> DataFrame:
    """The rows with a column of the spans' union as sorted, disjoint array<struct<start,end>>; spans that only touch stay apart."""
    kept = df.columns
    rows = df.select("*", F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("__s"))
    rows = rows.select("*", chunks(F.col("__s")).alias("__c"))
    before = F.aggregate(
        F.transform("__c", lambda ch: F.array_max(F.transform(ch, lambda s: s["end"]))), F.array(F.lit(-1)), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x)))
    )
    rows = rows.select("*", before.alias("__b"))
    # Largest end of a span and all before it.
    reach = F.transform(
        "__c",
        lambda ch, k: F.slice(F.aggregate(ch, F.array(F.get("__b", k)), lambda acc, s: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), s["end"])))), F.lit(2), F.size(ch)),
    )
    rows = rows.select("*", F.flatten(reach).alias("__r"))
    first = F.filter(
        F.transform("__s", lambda s, k: F.when((k == 0) | (s["start"] >= F.get("__r", k - 1)), F.struct(s["start"].alias("start"), k.alias("k")))), lambda x: x.isNotNull()
    )
    rows = rows.select("*", first.alias("__f"))
    out = F.transform(
        "__f", lambda x, k: F.struct(x["start"].alias("start"), F.get("__r", F.coalesce(F.get("__f", k + 1)["k"], F.size("__s")) - 1).alias("end"))
    )
    return rows.select(*kept, out.alias(name))


def of_kind(found: Column, kind: str) -> Column:
    """array<struct<kind,start,end>> of matches."""
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
