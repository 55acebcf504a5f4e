"""Personal data by base patterns and bootstrapped contextual extraction, all in DataFrame functions.

Base matches are the seeds. The word before and the word after an identifier are its
lexical patterns. Candidates are words that hold digits or an at sign and that no base
pattern covers. Patterns and instances form a bipartite graph over all documents, scored
in turns: a pattern's confidence is the mean score of its distinct instances, shrunk by
``prior`` unscored ones; a candidate's score is the best confidence among its patterns
of a kind that its shape allows. Candidates beside a pattern of at least ``confidence``
with ``support`` distinct seeds become spans of that kind. Contexts never leave the
two neighbouring words (up to 80 characters each side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm._common import cut, joined_spans, stored
from inkfold.llm._spans import add_matches, of_kind, outside

KINDS = ["email", "ip", "card", "phone"]

# Base patterns; possessive runs and run starts only save repeated searching.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"
CANDIDATE = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+"



def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def _valid(kind: str):
    """What a match must hold besides its pattern."""
    if kind == "ip":
        return lambda s: s["m"].rlike(IP_VALID)
    if kind == "card":
        return lambda s: F.char_length(_digits(s["m"])).between(14, 19) & _luhn(_digits(s["m"]))
    if kind == "phone":
        return lambda s: F.char_length(_digits(s["m"])).between(10, 15)
    return lambda s: F.lit(True)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _word_before(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"(\S{1,40})\s*$", 1))


def _word_after(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"^\S{0,40}?\s+(\S{1,40})", 1))


def _seen(found: Column) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lower(s["m"]).alias("value"), _word_before(s["before"]).alias("before"), _word_after(s["after"]).alias("after")
        ),
    )


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, one array of seen base matches per kind, and the uncovered candidate words; one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    patterns = {f"_{k}": p for k, p in BASE.items()} | {"_word": CANDIDATE}
    rows = add_matches(rows, "_t", patterns, dict.fromkeys(patterns, "[0-9@]"))
    rows = rows.select("id", "_word", *[F.filter(f"_{k}", _valid(k)).alias(k) for k in KINDS])
    rows = rows.select("id", "_word", *KINDS, F.concat(*KINDS).alias("_base"))
    return rows.select("id", *[_seen(F.col(k)).alias(k) for k in KINDS], _seen(outside(F.col("_word"), F.col("_base"))).alias("candidate"))


def _shape(kind: Column, value: Column) -> Column:
    """Whether a candidate word can be a damaged or unusual identifier of a kind."""
    digits = F.char_length(_digits(value))
    return (
        F.when(kind == "email", value.rlike(r"^[^@]+@[^@]+$"))
        .when(kind == "ip", value.rlike(r"[0-9]{1,3}(?:[.:_]+[0-9]{1,3}){3}"))
        .when(kind == "card", digits.between(13, 19) & ~value.rlike("[a-z@]"))
        .when(kind == "phone", digits.between(7, 15) & ~value.rlike("[a-z@]"))
        .otherwise(F.lit(False))
    )


def _patterns(seen: Column) -> Column:
    """Word before, word after, both; a side without a word makes no pattern of its own."""
    left, right = seen["before"], seen["after"]
    return F.array_compact(
        F.array(
            F.when(left != "", F.concat(F.lit("<"), left)),
            F.when(right != "", F.concat(F.lit(">"), right)),
            F.when((left != "") | (right != ""), F.concat(F.lit("="), left, F.lit("\t"), right)),
        )
    )


def learn(scanned: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 3, prior: float = 1.0) -> DataFrame:
    """kind, pattern, confidence of the patterns good enough to extract with, from the graph over all documents."""
    seeds = None
    for kind in KINDS:
        part = scanned.select(F.lit(kind).alias("kind"), F.explode(kind).alias("s"))
        seeds = part if seeds is None else seeds.unionByName(part)
    seeds = seeds.select("kind", F.explode(_patterns(F.col("s"))).alias("pattern"), F.col("s.value").alias("value")).withColumn("seed", F.lit(1.0))
    words = scanned.select(F.explode("candidate").alias("s"))
    words = words.select(F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"), "s").where(_shape(F.col("kind"), F.col("s.value")))
    words = words.select("kind", F.explode(_patterns(F.col("s"))).alias("pattern"), F.col("s.value").alias("value")).withColumn("seed", F.lit(0.0))
    edges = cut(seeds.unionByName(words).groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")))
    score = F.col("seed")
    scored = edges.withColumn("score", score)
    rated = None
    for k in range(rounds):
        rated = scored.groupBy("kind", "pattern").agg(
            (F.sum("score") / (F.count("*") + prior)).alias("confidence"), F.sum("seed").alias("support")
        )
        if k < rounds - 1:
            lifted = edges.join(rated, ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("confidence").alias("best"))
            scored = edges.join(lifted, ["kind", "value"]).withColumn("score", F.greatest("seed", "best"))
    return cut(rated.where((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("kind", "pattern", "confidence"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base and spans (arrays of kind, start, end) per row.

    Offsets are code points, end exclusive. Null text counts as empty; each input row
    gives a row, repeated ids and null ids included. Added spans never overlap a base span;
    a word that fits several kinds equally goes to the last of them by name. Texts of any
    length are searched whole, in time about linear in their matches. Other columns of the
    input are ignored, an empty table gives an empty one.
    """
    scanned = stored(scan(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "pii")
    good = learn(scanned, **learning)
    words = scanned.select("_row", F.explode("candidate").alias("s")).select("_row", "s", F.explode(_patterns(F.col("s"))).alias("pattern"))
    added = (
        words.join(good, "pattern")
        .where(_shape(F.col("kind"), F.col("s.value")))
        .groupBy("_row", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
        .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        .groupBy("_row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    )
    rows = scanned.join(added, "_row", "left")
    base = F.concat(*[of_kind(F.col(k), k) for k in KINDS])
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.select(
        "id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        base.alias("base"),
        F.concat(base, F.coalesce("added", none)).alias("spans"),
    )


def digest(found: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """The report columns of find()."""
    return found.select(
        F.col("id").alias(id_name),
        *[f"n_{k}" for k in KINDS],
        F.sha2(joined_spans(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined_spans(F.col("spans"), KINDS).alias("spans"),
    )
