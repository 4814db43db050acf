"""URL filters: fixed rules on host and path, and gradient-boosted trees on lexical features for what no rule fits.

Rules label the URLs that they fit; the trees are trained on at most ``ROWS`` of these, chosen by a hash, and judge
the others. Features: lengths, depth, share of digits, entropy of the characters, counts of parameters, labels and
marks, and for three suffixes (last label of the host, last two, last label with the first folder) the smoothed share
of blocked ones among all labelled URLs.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees. Each
input row gives one row; equal URLs get equal results, and equal rows are learned from once. URLs of any length are read
whole. Of rules of one length the later one by name counts. An empty table gives no rows; other columns are not read. Without labelled URLs of both kinds, what no rule fits gets the only verdict that rules gave,
or ``allow``.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.storage import stored
from srcatlas.llm.sample import smallest

#: host and beginning of the path, and the verdict
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
ROWS = 2_000
TREES = 12
DEPTH = 3
SEED = 11
#: Labelled URLs that a suffix counts as having at the common share.
SMOOTH = 5.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("top", "site", "folder")
LEXICAL = (
    "url_length",
    "host_length",
    "path_length",
    "depth",
    "digit_share",
    "entropy",
    "params",
    "labels",
    "marks",
)


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules: dict[str, str] | None = None) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for name in sorted(rules or RULES, key=lambda r: (len(r), r)):
        own, slash, folder = name.partition("/")
        fits = ((host_ == own) | host_.endswith("." + own)) & path_.startswith(slash + folder)
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits for each character."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = F.transform(
        F.filter(chars, lambda c: c != ""),
        lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n,
    )
    return F.coalesce(F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p)), F.lit(0.0))


def judged_by_rules(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path, rule`` and the rule's verdict as ``known``."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path")))
    verdicts = F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair))
    return rows.withColumn("known", verdicts[F.col("rule")])


def features(rows: DataFrame) -> DataFrame:
    url, host_, path_ = F.col("url"), F.col("host"), F.col("path")
    top = F.substring_index(host_, ".", -1)
    return rows.withColumns(
        {
            "url_length": F.length(url),
            "host_length": F.length(host_),
            "path_length": F.length(path_),
            "depth": _count(path_, "/"),
            "digit_share": F.length(F.regexp_replace(url, r"[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
            "entropy": _entropy(url),
            "params": F.when(url.contains("?"), 1 + _count(F.substring_index(url, "?", -1), "&")).otherwise(0),
            "labels": _count(host_, ".") + 1,
            "marks": F.length(F.regexp_replace(url, r"[^-_~%+=]", "")),
            "top": top,
            "site": F.substring_index(host_, ".", -2),
            "folder": F.concat_ws("/", top, F.get(F.split(path_, "/"), F.lit(1))),
        }
    )


def _with_shares(rows: DataFrame, share: float) -> DataFrame:
    """``rows`` with the smoothed share of blocked URLs of each suffix."""
    blocked = F.sum(F.when(F.col("known") == "block", 1).otherwise(0))
    out = rows
    for name in SUFFIXES:
        seen = rows.filter("known is not null").groupBy(name).agg(blocked.alias("b"), F.count(F.lit(1)).alias("n"))
        value = (F.col("b") + SMOOTH * share) / (F.col("n") + SMOOTH)
        seen = stored(seen.select(F.col(name).alias("_key"), value.alias(f"{name}_share")), "suffixes")
        out = out.join(seen, out[name] == seen["_key"], "left").drop("_key")
    return out.fillna(share, [f"{name}_share" for name in SUFFIXES])


def judged(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the trees' ``score`` of each row."""
    rows = features(judged_by_rules(pages))
    rows = stored(rows, "urls")
    seen = rows.agg(
        F.sum(F.when(F.col("known") == "block", 1).otherwise(0)).alias("b"), F.count("known").alias("n")
    ).first()
    blocked, n = seen["b"] or 0, seen["n"]
    if blocked in (0, n):
        only = "block" if n and blocked == n else "allow"
        made = rows.withColumn("score", F.lit(float(only == "block")))
    else:
        rows = _with_shares(rows, blocked / n)
        columns = [*LEXICAL, *(f"{name}_share" for name in SUFFIXES)]
        rows = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
        labelled = rows.filter("known is not null").withColumn("label", (F.col("known") == "block").cast("double"))
        # at most ROWS rows
        order = F.xxhash64("url", "page_id", F.lit(SEED))
        chosen = smallest(labelled.select("url", "page_id", "features", "label"), order, ROWS, ["url", "page_id"])
        chosen = stored(chosen.select("features", "label").coalesce(1), "labelled")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxMemoryInMB=64)
        made = trees.fit(chosen).transform(rows).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("known", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return made.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
