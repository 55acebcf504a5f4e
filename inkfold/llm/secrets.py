"""Secrets by base patterns and sliding-window entropy, all in DataFrame functions.

Candidate strings are runs of key-like characters. A window slides over each, its
per-character counts kept up to date by adding the entering and removing the leaving
character, so the Shannon entropy sum changes by four table look-ups a step. A run is a
secret if its highest window entropy reaches the bound of its character class and no
allow-list rule knows it. Base matches stay whatever their entropy; a secret run that
reaches beyond them is added whole, so that nothing of it is left when it is masked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm._common import joined_spans
from inkfold.llm._spans import CHUNK, add_matches, add_merged, chunks, keep_by, of_kind

KINDS = ["assign", "access", "hex", "entropy"]

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A match of the open-ended runs is a whole run, so its least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="

# Character classes from narrow to wide: pattern of the whole run, bits that a window must reach.
CLASSES = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    "base36": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.6),
    "base62": (r"^[0-9A-Za-z]+$", 3.8),
    "base64": (r"^[0-9A-Za-z+/_=-]+$", 3.9),
}

# Runs that are known not to be secrets.
ALLOW = [
    r"^[A-Za-z]+$",  # words
    r"^[0-9_=+/-]+$",  # numbers and rules
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)example|sample|dummy|placeholder|changeme|lorem",
    r"(?i)^(?:0123456789|abcdefghij|qwertyuiop)",
    r"^[A-Za-z]+(?:[/_-][A-Za-z]+)+[0-9]{0,4}$",  # paths and identifiers
]


def window_entropy(run: Column, window: int = 20) -> Column:
    """Highest Shannon entropy in bits over windows of a run (over the whole run if it is shorter)."""
    chars = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    xlogx = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 1)])
    zero = F.array_repeat(F.lit(0), len(ALPHABET) + 1)

    def step(acc: Column, i: Column) -> Column:
        entering = F.element_at(acc["chars"], i) + 1
        leaving = F.when(i > window, F.element_at(acc["chars"], i - window) + 1).otherwise(F.lit(0))
        fewer = F.when(leaving > 0, F.element_at(acc["counts"], F.greatest(leaving, F.lit(1)))).otherwise(F.lit(0))
        more = F.element_at(acc["counts"], entering) - F.when(entering == leaving, 1).otherwise(0)
        total = (
            acc["total"]
            - F.when(leaving > 0, F.element_at(xlogx, fewer + 1) - F.element_at(xlogx, F.greatest(fewer, F.lit(1)))).otherwise(0.0)
            + F.element_at(xlogx, more + 2)
            - F.element_at(xlogx, more + 1)
        )
        n = F.least(i, F.lit(window)).cast("double")
        counts = F.transform(
            acc["counts"], lambda v, k: v + F.when(k + 1 == entering, 1).otherwise(0) - F.when(k + 1 == leaving, 1).otherwise(0)
        )
        full = (i >= window) | (i == F.size(acc["chars"]))
        return F.struct(
            acc["chars"].alias("chars"),
            counts.alias("counts"),
            total.alias("total"),
            F.when(full, F.greatest(acc["best"], F.log2(n) - total / n)).otherwise(acc["best"]).alias("best"),
        )

    start = F.struct(chars.alias("chars"), zero.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.when(F.length(run) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(run), F.lit(1))), start, step)["best"]).otherwise(F.lit(0.0))


def _bound(run: Column) -> Column:
    out = None
    for pattern, bits in CLASSES.values():
        out = F.when(run.rlike(pattern), bits) if out is None else out.when(run.rlike(pattern), bits)
    return out


def _allowed(run: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | run.rlike(pattern)
    return out


def find(docs: DataFrame, text_col: str = "text", window: int = 20) -> DataFrame:
    """row (the input row), assign, access, hex, entropy, base and spans (arrays of kind, start, end), without a shuffle.

    Offsets are code points, end exclusive; null text counts as empty. Spans of kind
    ``entropy`` are those the method adds: whole runs that base spans do not cover wholly.
    Each input row gives a row; texts of any length are searched whole. Input columns stay
    inside ``row``, so no name of theirs can clash.
    """
    # A run needs a digit to be a candidate; words of prose are never cut out.
    run = rf"(?:\G|(?<![A-Za-z0-9+/_=-]))(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{{window},}}+"
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = add_matches(rows, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": run}, {"assign": "[:=]", "access": "AKIA", "run": "[0-9]"})
    assigned = F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["m"], ASSIGNED, 1)) >= 6)
    rows = rows.select("row", "run", of_kind(assigned, "assign").alias("assign"), of_kind(F.col("access"), "access").alias("access"), of_kind(F.col("hex"), "hex").alias("hex"))
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    rows = add_merged(rows, "__known", F.col("base"))
    beyond = keep_by(F.col("run"), F.col("__known"), lambda one, near: ~F.exists(near, lambda s: (s["start"] <= one["start"]) & (s["end"] >= one["end"])))
    secret = F.filter(F.filter(beyond, lambda s: ~_allowed(s["m"])), lambda s: window_entropy(s["m"], window) >= _bound(s["m"]))
    rows = rows.withColumn("entropy", of_kind(secret, "entropy")).drop("run", "__known")
    return rows.withColumn("spans", F.concat("base", "entropy"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report columns of find(), a row per input row: id, counts of the base kinds, base_sha256, spans, n_entropy; null and empty texts have counts 0 and no spans."""
    found = find(docs.select(id_col, text_col), text_col)
    return found.select(
        f"row.{id_col}",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS if k != "entropy"],
        F.sha2(joined_spans(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined_spans(F.col("spans"), KINDS).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every found span replaced by a mask; n_chars, if there, follows. Texts without secrets are unchanged."""
    found = find(docs, text_col)
    text = F.col("row")[text_col]
    rows = add_merged(found.select("row", "spans"), "__cuts", F.col("spans")).select("row", F.when(F.size("spans") > 0, F.col("__cuts")).alias("cuts"))
    # A piece of text per chunk of cuts first, then the parts between the cuts out of the piece.
    end = lambda spans, k, first: F.when(k == 0, first).otherwise(F.get(spans, k - 1)["end"])
    dealt = F.transform(
        chunks(F.col("cuts")),
        lambda ch, c: F.struct(ch.alias("own"), end(F.col("cuts"), c * CHUNK, F.lit(0)).alias("first"), F.substring(text, end(F.col("cuts"), c * CHUNK, F.lit(0)) + 1, F.element_at(ch, -1)["end"] - end(F.col("cuts"), c * CHUNK, F.lit(0))).alias("piece")),
    )
    parts = F.transform(
        dealt,
        lambda z: F.array_join(
            F.transform(z["own"], lambda s, k: F.concat(F.substring(z["piece"], end(z["own"], k, z["first"]) - z["first"] + 1, s["start"] - end(z["own"], k, z["first"])), F.lit(mask))), ""
        ),
    )
    clean = F.concat(F.array_join(parts, ""), F.substr(text, F.element_at("cuts", -1)["end"] + 1))
    rows = rows.select("row", F.col("cuts").isNotNull().alias("cut"), F.when(F.col("cuts").isNotNull(), clean).otherwise(text).alias("clean"))
    made = {text_col: F.col("clean")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("cut"), F.char_length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return rows.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
