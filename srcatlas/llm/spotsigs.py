"""Document fingerprints by spot signatures, and their likeness.

Spot signatures (Theobald, Siddharth, Paepcke 2008): at every common word of a text (an anchor) the chain of the next
``CHAIN`` content words is taken, common words in between being left out; the hashed anchor with its chain is one
signature. A fingerprint is the set of signatures of a text, as ascending numbers.
Texts are lower-cased, and everything but letters, digits and white space is dropped before.

Likeness is the Jaccard likeness of two sets. Two sets whose sizes have a ratio below the threshold cannot reach it, so
a search compares only neighbouring size classes: ``near_classes`` names each document's class of near duplicates,
``near_pairs`` lists the pairs.

Defined results: rows without a ``doc_id`` are in no class, and documents without a signature are alike to each other only. a text without anchors, or with too few content words behind them, has a signature for each of its
words and their successors instead; a text without words has an empty fingerprint. Two empty
fingerprints have likeness 1, an empty and another 0. Null texts count as empty. Documents are in order of ``doc_id``, nulls
first, ties by text; the first follows the last; a single document follows itself. Each row gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions.storage import stored
from srcatlas.llm.components import components

CHAIN = 2
#: Likeness of near duplicates.
LIKE = 0.75
#: Counters of how often signatures are, roughly; they set the order of signatures, not results.
COUNTERS = 1 << 16
#: Rows of a bucket of neighbouring documents, about, and stretches of ids that are divided evenly.
BUCKET_ROWS = 2_000
STRETCHES = 64
# fixed values: common words of four languages
COMMON = {
    "en": "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their "
    "they this to was we were which will with you",
    "de": "aber als am an auch auf aus bei das dem den der des die durch ein eine einer es fur für hat ich im in ist mit "
    "nach nicht noch oder sein sich sie sind so uber und von vor war werden wie wird zu zum zur über",
    "fr": "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me ne nous on ou par "
    "pas pour qu que qui sa se ses son sur un une vous",
    "es": "al como con de del el en entre era es esta este ha la las lo los mas más no o para pero por que se ser sin "
    "sobre su sus también un una y",
}


def _common() -> list[str]:
    return sorted({w for words in COMMON.values() for w in words.split()})


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def signatures(text: Column) -> Column:
    """The set of a text's signatures, as an ascending array of hashes."""
    common = _common()

    def of(words: Column) -> Column:
        anchors = F.filter(
            F.transform(words, lambda w, i: F.when(w.isin(common), i)), lambda i: i.isNotNull()
        )
        content = F.filter(words, lambda w: ~w.isin(common))
        return _let(
            F.struct(anchors.alias("anchors"), content.alias("content")), lambda s: chains(words, s["anchors"], s["content"])
        )

    def chains(words: Column, anchors: Column, content: Column) -> Column:
        # before the anchor number k at word i there are i - k content words
        made = F.transform(
            anchors,
            lambda i, k: F.when(
                i - k + CHAIN <= F.size(content),
                F.hash(F.get(words, i), *(F.get(content, i - k + n) for n in range(CHAIN))),
            ),
        )
        return _let(
            F.filter(made, lambda x: x.isNotNull()),
            lambda found: F.when(F.size(found) > 0, found).otherwise(
                F.transform(words, lambda w, i: F.hash(w, F.coalesce(F.get(words, i + 1), F.lit(""))))
            ),
        )

    return F.sort_array(F.array_distinct(_let(_words(F.coalesce(text, F.lit(""))), of)))


def fingerprint(signature: Column) -> Column:
    """A set of signatures as text."""
    return F.array_join(signature.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard likeness of two sets, from 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, 1.0).otherwise(common / total)


def _bucket(rows: DataFrame, key: str) -> Column:
    """Rises with ``key``; about ``BUCKET_ROWS`` rows have the same one where ids are even within a stretch."""
    parts = [i / STRETCHES for i in range(STRETCHES + 1)]
    known = rows.agg(F.count(key).alias("n"), F.percentile_approx(key, parts, 100 * STRETCHES).alias("cuts")).first()
    if not known["n"]:
        return F.lit(0).cast("long")
    cuts = sorted(set(known["cuts"]))
    each = max(1, known["n"] // (STRETCHES * BUCKET_ROWS))
    bounds, value = F.array(*map(F.lit, cuts)), F.col(key)

    def inside(stretch: Column) -> Column:
        low = F.coalesce(F.get(bounds, stretch - 1), F.lit(cuts[0] - 1))
        high = F.coalesce(F.get(bounds, stretch), F.lit(cuts[-1] + 1))
        share = (value - low) / F.greatest(high - low + 1, F.lit(1))
        step = F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor(share * each)))
        return stretch.cast("long") * each + step

    found = _let(F.size(F.filter(bounds, lambda c: c < value)), inside)
    return F.coalesce(found, F.lit(-1).cast("long"))


def with_next(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``next_`` columns: those of the row that follows in the order of ``key`` and ``columns``; the first
    one follows the last.

    Rows go to buckets of neighbouring keys, so that no bucket grows with the table; the last row of each bucket gets
    the first one of the next bucket. The rows move once.
    """
    placed = rows.withColumn("_bucket", _bucket(rows, key))
    inside = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), *columns)
    led = placed.select("*", F.lead(F.struct(*columns)).over(inside).alias("_next"))
    first = placed.groupBy("_bucket").agg(F.min(F.struct(key, *columns)).alias("_first"))
    first = stored(first, "first")
    # numbers of buckets only
    order = Window.orderBy("_bucket")
    following = first.select(
        F.col("_bucket").alias("_own"),
        F.coalesce(F.lead("_bucket").over(order), F.first("_bucket").over(order)).alias("_bucket"),
    )
    heads = following.join(first, "_bucket").select(F.col("_own").alias("_bucket"), "_first")
    joined = led.join(heads, "_bucket")
    return joined.select(
        *rows.columns,
        *(F.coalesce(F.col(f"_next.{c}"), F.col(f"_first.{c}")).alias(f"next_{c}") for c in columns),
    )


def edited_likeness(documents: DataFrame) -> DataFrame:
    """Each row's fingerprint and that of its edited text, in which the last quarter is replaced by the beginning of the
    next document, with their likeness and that to the next document."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).withColumn("signature", signatures(F.col("text")))
    rows = with_next(rows, "doc_id", ["text", "signature"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    # an empty text must stay one: substring of length 0
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("*", edited.alias("edited"))
    rows = rows.select("*", signatures(F.col("edited")).alias("edited_signature"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signature")).alias("fingerprint"),
        fingerprint(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def _digest(signature: Column) -> Column:
    """128 bits that stand for a set."""
    return F.struct(F.xxhash64(signature).alias("x"), F.xxhash64(F.lit(1), signature).alias("y"))


def _frequencies(rows: DataFrame) -> Column:
    """Counts of all signatures of ``rows`` by ``COUNTERS`` remainders, as a constant array."""
    each = rows.select(F.explode("signature").alias("s")).groupBy(_counter(F.col("s")).alias("k")).count()
    counts = [0] * COUNTERS
    for k, n in each.collect():  # at most COUNTERS rows
        counts[k] = n
    return F.from_json(F.lit(str(counts)), "array<long>")


def _counter(s: Column) -> Column:
    return F.pmod(s, F.lit(COUNTERS)).cast("int")


def _alike(pairs: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have a likeness of at least ``like``."""
    left = sets.select(F.col("class_id").alias("a"), F.col("signature").alias("x"))
    right = sets.select(F.col("class_id").alias("b"), F.col("signature").alias("y"))
    compared = pairs.join(left, "a").join(right, "b")
    return compared.filter(likeness(F.col("x"), F.col("y")) >= like).select("a", "b")


def near_classes(documents: DataFrame, like: float = LIKE) -> DataFrame:
    """``doc_id, _set, near_class`` of each distinct document with a ``doc_id``: the smallest ``doc_id`` that links of a
    likeness of at least ``like`` lead to, itself included. No link between different sets is lost.

    Equal sets are one class first. Signatures are ordered by a rough count, rare ones first; two alike sets share one
    of the first ``size - ceil(like * size) + 1``, whatever the order. Sets are partitioned by the logarithm of their
    size; a partition takes two neighbouring ranges, so that two sets of a size ratio of at least ``like`` meet in one.
    In each partition the sets with the same early signature are a bucket. Sets are compared with the smallest of
    their buckets first; what this links is one component, so a group of near copies costs a comparison for each of
    them. Then only sets of different components in one bucket are compared, each pair once.
    """
    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", signatures(F.col("text")).alias("signature"))
    size = F.size("signature")
    often = _frequencies(rows)
    ordered = F.sort_array(F.transform("signature", lambda s: F.struct(F.get(often, _counter(s)).alias("n"), s.alias("s"))))
    early = F.slice(ordered, F.lit(1), size - F.ceil(F.lit(like) * size).cast("int") + 1)
    head = F.transform(early, lambda e: e["s"])
    keyed = rows.select("doc_id", _digest(F.col("signature")).alias("_set"), size.alias("size"), F.when(size > 0, head).alias("head"))
    keyed = stored(keyed, "keyed")
    classes = keyed.groupBy("_set").agg(F.min("doc_id").alias("class_id"), F.first("size").alias("size"), F.first("head").alias("head"))
    classes = stored(classes, "classes")
    heads = classes.select("class_id", "size", F.explode("head").alias("s"))
    shared = heads.groupBy("s").count().filter("count > 1").select("s")
    level = F.floor(F.log("size") / F.log(F.lit(1 / like))).cast("int")
    parts = F.explode(F.array(level, level + 1)).alias("part")
    buckets = stored(heads.join(shared, "s").select("class_id", "size", "s", parts), "buckets")
    buckets = stored(_mixed(buckets, "class_id"), "buckets")
    wanted = buckets.select("class_id").distinct().join(classes.select("class_id", "_set"), "class_id")
    held = rows.select(F.col("doc_id").alias("class_id"), _digest(F.col("signature")).alias("_set"), "signature")
    sets = held.join(wanted, ["class_id", "_set"]).groupBy("class_id").agg(F.first("signature").alias("signature"))
    sets = stored(sets, "sets")
    fits = F.least("size_a", "size_b") >= F.lit(like) * F.greatest("size_a", "size_b")

    smallest = F.min(F.struct("class_id", "size")).alias("least")
    led = buckets.join(buckets.groupBy("s", "part").agg(smallest), ["s", "part"])
    led = led.select(F.col("least.class_id").alias("a"), F.col("least.size").alias("size_a"), F.col("class_id").alias("b"), F.col("size").alias("size_b"))
    links = stored(_alike(led.filter((F.col("a") < F.col("b")) & fits).select("a", "b").distinct(), sets, like), "links")

    up = components(links, local=False).withColumnRenamed("node", "class_id")
    placed = buckets.join(up, "class_id", "left").withColumn("component", F.coalesce("up", "class_id")).drop("up")
    placed = stored(_mixed(placed, "component"), "placed")
    one, other = (
        placed.select("s", "part", *(F.col(c).alias(f"{n}_{x}") for c, n in (("class_id", "id"), ("size", "size"), ("component", "component"))))
        for x in "ab"
    )
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & fits
    crossing = one.join(other, ["s", "part"]).filter(apart).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    links = links.union(_alike(crossing, sets, like))
    up = components(links, local=False).withColumnRenamed("node", "class_id")
    named = classes.join(up, "class_id", "left").select("_set", F.coalesce("up", "class_id").alias("near_class"))
    return keyed.select("doc_id", "_set").distinct().join(named, "_set").select("doc_id", "_set", "near_class")


def _mixed(buckets: DataFrame, what: str) -> DataFrame:
    """The rows of buckets ``(s, part)`` that hold more than one ``what``."""
    many = buckets.groupBy("s", "part").agg(F.min(what).alias("_low"), F.max(what).alias("_high"))
    return buckets.join(many.filter("_low < _high").select("s", "part"), ["s", "part"])


def near_pairs(rows: DataFrame, like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """Classes and pairs of ``(doc_id, signature)`` rows: ``doc_id, class_id`` of each row, and ``a, b, likeness`` of
    classes of a likeness of at least ``like``.

    Equal sets are one class, named by its smallest ``doc_id``. The rarest signatures of a set come first; two alike
    sets share one of the first ``size - ceil(like * size) + 1``. Sets are partitioned by the logarithm of their size,
    and meet in their own and the next partition only; of these, pairs of too unlike sizes are pruned before sets are
    compared. Empty sets are in no pair.
    """
    named = rows.withColumn("_set", fingerprint(F.col("signature")))
    first = named.groupBy("_set").agg(F.min("doc_id").alias("class_id"), F.first("signature").alias("signature"))
    first = stored(first, "classes")
    members = named.select("doc_id", "_set").join(first.select("_set", "class_id"), "_set").select("doc_id", "class_id")
    size = F.size("signature")
    each = first.filter(size > 0).select("class_id", size.alias("size"), F.explode("signature").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "s").groupBy("class_id", "size").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("all"))
    head = F.slice("all", F.lit(1), F.col("size") - F.ceil(F.lit(like) * F.col("size")).cast("int") + 1)
    level = F.floor(F.log(F.col("size")) / F.log(F.lit(1 / like)))
    heads = stored(ranked.select("class_id", "size", level.alias("level"), F.explode(head["s"]).alias("s")), "heads")
    small = heads.select(F.col("class_id").alias("a"), F.col("size").alias("size_a"), "level", "s")
    levels = F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("level")
    large = heads.select(F.col("class_id").alias("b"), F.col("size").alias("size_b"), levels, "s")
    smaller = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    pairs = small.join(large, ["level", "s"]).filter(smaller & (F.col("size_a") >= like * F.col("size_b")))
    pairs = pairs.select("a", "b").distinct()
    left = first.select(F.col("class_id").alias("a"), F.col("signature").alias("x"))
    right = first.select(F.col("class_id").alias("b"), F.col("signature").alias("y"))
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness"))
    return members, compared.filter(F.col("likeness") >= like)
