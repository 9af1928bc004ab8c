"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Three kinds follow fixed patterns, leftmost and without overlap per kind, and always stay: ``assign`` (a credential's name
and its value), ``access`` (access key ids) and ``hex`` (long hexadecimal runs). An added kind, ``random``, are other runs
of credential characters (``CANDIDATE``) that touch none of those and that a first-order Markov model of random strings
makes likelier than one of ordinary identifiers, by ``THRESHOLD`` thousandths of a nat over the whole run.

The models are counted from labelled strings: all that the fixed patterns find is random, other identifiers of about
``SAMPLE_TEXTS`` texts are ordinary; ``train`` takes any labelled strings. Each different string counts once. Without
strings of both labels nothing is added.

Only built-in functions. Offsets are code points, ends exclusive, and come from the lengths of matches and of the gaps
between them. Null and empty texts have no spans; rows are independent, repeated rows get equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the base kinds, in this order
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6  # characters of the value at least
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run of 20 or more; a shorter one holds no longer one
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = "[A-Za-z0-9+/_-]{16,}"
IDENTIFIER = "[A-Za-z0-9+/_-]{4,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
WIDTH = len(ALPHABET) + 1  # 0 stands for anything else
THRESHOLD = 8_000  # thousandths of a nat
SMOOTHING = 0.5  # added to the count of every pair of characters
SAMPLE_TEXTS = 5_000  # texts whose identifiers are ordinary, chosen by their hash; all if there are fewer
HASHES = 1 << 30
BLOCK = 256  # matches whose offsets are summed one by one


def _running(sizes: Column) -> Column:
    """Sums of an array up to each element, within blocks and then over blocks, so that long arrays stay cheap."""
    def sums(values: Column) -> Column:
        return F.aggregate(values, F.array().cast("array<long>"),
                           lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(a, F.when(F.size(a) > 0, -1)), F.lit(0)) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK)),
                         lambda b: sums(F.slice(sizes, (b * BLOCK + 1).cast("int"), BLOCK)))
    ends = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
    return F.flatten(F.transform(blocks, lambda b, i: F.transform(
        b, lambda x: x + F.when(i > 0, F.element_at(ends, F.when(i > 0, i))).otherwise(0))))


def _matches(df: DataFrame, name: str, text: str, pattern: str, held: Column, value: int = 0) -> DataFrame:
    """Adds ``name``: array of (begin, end, value) of all matches, ``value`` being that group; null where ``held`` is not."""
    at = f"_{name}"
    df = df.withColumn(at, F.when(held, F.struct(
        F.transform(F.split(text, pattern), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"))))
    df = df.withColumn(at, F.when(F.size(f"{at}.found") > 0, F.struct(
        f"{at}.found", f"{at}.value",
        _running(F.zip_with(F.slice(f"{at}.gaps", 1, F.size(f"{at}.found")), f"{at}.found",
                            lambda g, m: (g + F.length(m)).cast("long"))).alias("ends"))))
    spans = F.transform(F.arrays_zip(f"{at}.found", f"{at}.value", f"{at}.ends"), lambda m: F.struct(
        (m["ends"] - F.length(m["found"])).alias("begin"), m["ends"].alias("end"), m["value"].alias("value")))
    return df.withColumn(name, spans).drop(at)


def _base(df: DataFrame, text: str) -> DataFrame:
    """Adds arrays ``assign``, ``access`` and ``hex`` of spans that pass; null where there are none."""
    t = F.col(text)
    df = _matches(df, "assign", text, ASSIGN, t.rlike(ASSIGN), 2)
    df = _matches(df, "access", text, ACCESS, t.rlike(ACCESS))
    df = _matches(df, "hex", text, HEX, t.rlike(HEX))
    return df.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= ASSIGN_VALUE))


def _without(text: str, pattern: str) -> Column:
    """The text with each match blank, all other characters where they were."""
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blank = F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.when(F.col(text).rlike(pattern), F.array_join(F.flatten(F.zip_with(
        gaps, blank, lambda g, b: F.array(g, F.coalesce(b, F.lit(""))))), "")).otherwise(F.col(text))


def labelled_strings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(string, random): values that the fixed patterns find in all texts, and identifiers of a sample of texts."""
    rows = docs.select(docs[text].alias("text"))
    suspect = rows.where(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    spans = _base(suspect, "text")
    values = F.concat(*[F.transform(F.coalesce(k, F.array().cast("array<struct<begin:long,end:long,value:string>>")),
                                    lambda s: s["value"]) for k in KINDS[:3]])
    # outer, as else Spark repeats the whole expression in a filter below
    found = spans.select(F.explode_outer(values).alias("string"), F.lit(True).alias("random")).where("string IS NOT NULL")
    share = min(HASHES, HASHES * SAMPLE_TEXTS // max(rows.count(), 1))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(HASHES)) < share)
    for pattern in (ASSIGN, ACCESS, HEX):
        sample = sample.select(_without("text", pattern).alias("text"))
    names = F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))
    plain = sample.select(F.explode_outer(names).alias("string"), F.lit(False).alias("random")).where("string IS NOT NULL")
    return found.union(plain)


def train(strings: DataFrame, string: str = "string", random: str = "random") -> list[int] | None:
    """Log-likelihood ratio of each pair of characters, in thousandths of a nat, from labelled strings.

    Entry ``a * WIDTH + b`` is that of ``b`` after ``a``, both numbered by ALPHABET from 1. None unless both labels occur.
    """
    rows = strings.select(strings[string].alias("s"), strings[random].cast("boolean").alias("random")).where(
        "s IS NOT NULL AND random IS NOT NULL")
    pairs = rows.distinct().select("random", F.explode(_pairs(F.col("s"))).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    if {label for label, _ in counts} != {True, False}:  # at most 2 * WIDTH ** 2 counts
        return None
    after = {(label, a): sum(counts.get((label, a * WIDTH + b), 0) for b in range(WIDTH))
             for label in (True, False) for a in range(WIDTH)}

    def chance(label: bool, a: int, b: int) -> float:
        return (counts.get((label, a * WIDTH + b), 0) + SMOOTHING) / (after[label, a] + SMOOTHING * WIDTH)

    return [round(1000 * math.log(chance(True, a, b) / chance(False, a, b))) for a in range(WIDTH) for b in range(WIDTH)]


def _pairs(string: Column) -> Column:
    """Numbers of the neighbouring characters of a string."""
    places = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 2, F.size(places)),
                      lambda a, b: a * WIDTH + b)


def _ratio(string: Column, ratios: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # folded to a constant
    return F.aggregate(_pairs(string), F.lit(0).cast("long"), lambda total, p: total + F.element_at(table, p + 1))


def find_secrets(docs: DataFrame, ratios: list[int] | None, text: str = "text") -> DataFrame:
    """``docs`` with four arrays of (begin, end, value), one a kind; null where there are none. Names must be free."""
    blanked, t = "_blanked", F.col(text)
    df = _base(docs, text)
    if ratios is None:
        return df.withColumn("random", F.lit(None).cast(df.schema["hex"].dataType))
    df = df.withColumn(blanked, F.when(F.col("assign").isNotNull(), _without(text, ASSIGN)).otherwise(t))
    df = _matches(df, "random", blanked, CANDIDATE, F.col(blanked).rlike(CANDIDATE))
    likely = F.filter("random", lambda s: _ratio(s["value"], ratios) >= THRESHOLD)
    df = df.withColumn("random", likely)
    clear = F.filter("random", lambda s: ~F.exists(
        F.concat(*[F.coalesce(k, F.array().cast(df.schema["hex"].dataType)) for k in KINDS[:3]]),
        lambda b: (b["begin"] < s["end"]) & (s["begin"] < b["end"])))
    return df.withColumn("random", F.when(F.size("random") > 0, clear)).drop(blanked)


def _written(kinds: tuple[str, ...]) -> Column:
    """Spans as kind:begin:end by begin, then kind as listed, comma-joined."""
    none = F.array().cast("array<struct<begin:long,place:int,end:long>>")

    def placed(i: int, kind: str) -> Column:
        return F.coalesce(F.transform(kind, lambda s: F.struct(
            s["begin"].alias("begin"), F.lit(i).alias("place"), s["end"].alias("end"))), none)

    all_ = F.concat(*[placed(i, kind) for i, kind in enumerate(kinds)])
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(all_), lambda s: F.concat_ws(
        ":", F.element_at(names, s["place"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def secrets_report(docs: DataFrame, key: str = "doc_id", text: str = "text", ratios: list[int] | None = None) -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256, spans, n_random. Trains on ``docs`` unless given ratios."""
    ratios = train(labelled_strings(docs, text)) if ratios is None else ratios
    found = find_secrets(docs.select(docs[key].alias("_key"), docs[text].alias("_text")), ratios, "_text")
    return found.select(
        F.col("_key").alias(key),
        *[F.coalesce(F.size(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _written(KINDS).alias("spans"),
        F.coalesce(F.size("random"), F.lit(0)).cast("long").alias("n_random"))
