"""URL filters: a few fixed rules, and for all other URLs a tree of path templates per host judged by labelled purity.

Segments with digits become wildcards (an extension stays), and so do those below a parent with many different segments
that few URLs share. URLs that a rule decides are the labels. A branch whose share of blocked URLs can be told from that
of all its siblings together (two proportions, 5 % level) stays on its own; all others, those without labels among them,
are one merged branch. A template's share of blocked URLs is smoothed level by level: the share that its shape has on all
hosts comes first, then its host's, then each branch's on the way down. It is rejected if that is above one half.

Only built-in functions, aggregations and joins: pages are counted per host and shape first, the tree works on those
counts and is as deep as the paths, in time linear in their segments. Shapes, nodes and templates are joined by hashes,
so what is broadcast has a bound in bytes; larger sides are salted, a host with most of the shapes too. Null URLs and
those without ``://`` have an empty host and path and are one more host. Repeated rows count each time and get equal
verdicts; a share of exactly one half is allowed. Without labels everything is allowed, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlspark.llm.common import written
from urlspark.session import lookup_join

# fixed values: (host, path, verdict); a rule fits its host and all subdomains
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
VALUES = 20  # different segments that make those below a parent variable, if they have
SUPPORT = 5  # fewer than so many URLs each
CHI = 3.84  # of one degree of freedom at the 5 % level: shares further apart are not merged
MERGED = "~"  # label of branches that can't be told apart
WEIGHT = 10.0  # of the wider share when a narrower one is smoothed
LIMIT = 0.5

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), CAPITALS, SMALL)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _wild(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]+)$", 1))


def _shape(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike("[0-9]"), _wild(s)).otherwise(s)), "/")


def _share(bad: Column, labelled: Column, prior: Column) -> Column:
    return (bad + WEIGHT * prior) / (labelled + WEIGHT)


def _alike(bad: Column, labelled: Column, other_bad: Column, other_labelled: Column) -> Column:
    """Whether two shares can't be told apart: squared difference over its variance, one URL of each kind added to both."""
    b, n, c, m = [(x + k).cast("double") for x, k in ((bad, 1), (labelled, 2), (other_bad, 1), (other_labelled, 2))]
    apart = (b * m - c * n) * (b * m - c * n) * (n + m) > CHI * (n * m * (b + c) * (n + m - b - c))
    return (labelled == 0) | (other_labelled == 0) | ~apart


def _keyed(levels: DataFrame, names: list[str]) -> DataFrame:
    """``levels`` with two 64-bit keys of the host and the ``names`` from the top down to here (``at``), and those of the
    level above (``above``). A running exclusive or keeps this linear in the path."""
    down = Window.partitionBy("id").orderBy("depth")
    at, above = [], []
    for seed in (1, 2):
        own = F.xxhash64(F.lit(seed), "depth", *names)
        run = F.bit_xor(own).over(down).bitwiseXOR(F.xxhash64(F.lit(seed), "host_id"))
        at.append(run)
        above.append(run.bitwiseXOR(own))
    return levels.withColumns({"at": F.struct(*at), "above": F.struct(*above)})


def path_trees(shapes: DataFrame) -> DataFrame:
    """One row per shape (``id``) and depth of its host's tree: depth, label (its segment, ``*`` if variable), bad and
    labelled of the template down to here. ``shapes``: id, host_id, shape, labelled, bad, n."""
    levels = shapes.select("id", "host_id", "n", "labelled", "bad", F.posexplode(F.split("shape", "/")).alias("depth", "segment"))
    raw = _keyed(levels, ["segment"])
    plain = (F.col("segment") != "") & ~F.col("segment").startswith("*")
    variable = (
        raw.where(plain).groupBy("above", "segment").agg(F.sum("n").alias("n"))
        .groupBy("above").agg(F.count("*").alias("values"), F.sum("n").alias("urls"))
        .where((F.col("values") >= VALUES) & (F.col("urls") < SUPPORT * F.col("values"))).select("above", F.lit(True).alias("varies"))
    )
    general = lookup_join(raw, variable, ["above"]).select(
        "id", "host_id", "labelled", "bad", "depth",
        F.when(F.col("varies") & plain, _wild(F.col("segment"))).otherwise(F.col("segment")).alias("segment"))

    tree = written(_keyed(general, ["segment"]), "url-tree")
    nodes = tree.groupBy("above", "at", "depth").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    parents = nodes.groupBy("above").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    rest = [F.col("all_" + c) - F.col(c) for c in ("bad", "labelled")]
    alone = lookup_join(nodes.where((F.col("depth") > 0) & (F.col("labelled") > 0)), parents, ["above"]).where(
        ~_alike(F.col("bad"), F.col("labelled"), *rest)).select("at", F.lit(True).alias("alone"))
    marked = lookup_join(tree.drop("above"), alone, ["at"]).select(
        "id", "host_id", "labelled", "bad", "depth", F.when(F.col("alone"), F.col("segment")).otherwise(
            F.when(F.col("depth") == 0, "").otherwise(MERGED)).alias("label"))

    merged = written(_keyed(marked, ["label"]).drop("above"), "url-templates")
    templates = merged.groupBy("at").agg(F.sum("bad").alias("t_bad"), F.sum("labelled").alias("t_labelled"))
    return lookup_join(merged, templates, ["at"]).select(
        "id", "depth", "label", F.col("t_bad").alias("bad"), F.col("t_labelled").alias("labelled"))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url",
               rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row: key, host, path, rule, verdict, template, and elsewhere, the share that the same shape has on all hosts
    (both null where a rule decides)."""
    rows = pages.select(pages[key].alias("_key"), pages[url].alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select("_key", host.alias("host"), path.alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), _shape(F.col("path")).alias("shape"))
    rows = rows.withColumn("id", F.md5(F.concat("host", "shape")))  # a shape is empty or begins with a slash

    shapes = written(rows.groupBy("id").agg(
        F.first(F.md5("host")).alias("host_id"), F.first("shape").alias("shape"), F.md5(F.first("shape")).alias("form"),
        F.count("*").alias("n"), F.count("ruled").alias("labelled"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("bad")), "url-shapes")
    total = shapes.agg(F.sum("bad"), F.sum("labelled")).first()
    overall = F.lit(((total[0] or 0) + 1) / ((total[1] or 0) + 2) if total[1] else 0.0)
    everywhere = shapes.groupBy("form").agg(
        _share(F.sum("bad"), F.sum("labelled"), overall).alias("elsewhere"))
    priors = lookup_join(shapes.select("id", "form"), everywhere, ["form"]).select("id", "elsewhere")

    steps = path_trees(shapes).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("depth", "label", "bad", "labelled"))).alias("steps"))
    judged = written(priors.join(steps, "id").select(
        "id", "elsewhere", F.array_join(F.transform("steps", lambda s: s["label"]), "/").alias("template"),
        F.aggregate("steps", F.col("elsewhere"), lambda share, s: _share(s["bad"], s["labelled"], share)).alias("share"),
    ).select("id", "elsewhere", "template", F.when(F.col("share") > LIMIT, "block").otherwise("allow").alias("found")), "url-judged")
    known = rows.where(F.col("ruled").isNotNull()).select(
        "_key", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("string").alias("template"),
        F.lit(None).cast("double").alias("elsewhere"))
    others = lookup_join(rows.where(F.col("ruled").isNull()).drop("shape"), judged, ["id"]).select(
        "_key", "host", "path", "rule", F.col("found").alias("verdict"), "template", "elsewhere")
    return known.union(others).withColumnRenamed("_key", key)
