"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash (Ertl 2017): each element of a set draws a random permutation of the ``M`` places of a signature; the place
at rank j of its permutation gets the smallest of ``j`` plus a random fraction. The ranks of one element are
correlated, which lowers the variance against independent hashes. Ranks are drawn one after another for all elements of a
block at once, and a set stops as soon as every place holds a value below the next rank.

A set has the distinct ``SHINGLE``-word sequences of a text whose A to Z are lower-cased; a text with fewer words has its
whole sequence as one; a text without words has none and is linked with nothing. Two documents are linked if
100 times the size of the intersection is at least ``LIKE`` times that of the union.

1. Documents with equal sets are one class, found by a 128-bit digest; its smallest ``doc_id`` stands for it.
2. Signatures are cut into ``BANDS`` of ``ROWS`` places; a bucket holds the classes with an equal band. A pair with a
   likeness of 0.75 shares no band with a probability of ``(1 - 0.75 ** ROWS) ** BANDS``, 5e-6.
3. In each bucket every class is paired with the smallest and the largest one. Pairs whose signatures agree in
   ``AGREE`` of the places (for a likeness of 0.75 less is over six standard deviations away) are confirmed on their full
   sets. Union-find gives components.
4. A bucket's ends may be like neither of two members that are alike. Pairs that agree in ``NEAR`` of the places, links or
   not, make up clusters. A cluster that holds more than one component is cut where it has no link: with the shingles of
   each set in the order of how often the cluster has them, rare ones first, two linked sets share one of their first
   ``size - ceil(0.75 size) + 1``; members that share one of these, directly or through others, stay together.
5. In what is left with more than one component, members outside the largest one are compared with all others, exactly: in
   blocks of ``BLOCK`` members each, by products of incidence matrices, so that no pair becomes a row. Then union-find again.

The pairs of 3 are at most two for each class and bucket, the rows of 4 the shingles of clusters that are mixed. The blocks of 5 come from
texts that share rare shingles without being linked; their rows are the members outside the largest component times the blocks.
Texts that share a frequent passage, however many, and are unlike in the rest do not come that far. What stays quadratic, with a factor of
one over ``BLOCK``, are texts that are chained by rare shingles and yet of many components.

Defined results: a null ``doc_id`` gets a null component and is not kept, and takes no part in links. Rows of one
``doc_id`` are one node: a link of either text counts, and each row keeps its own set size. Each input row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.shipping import ship
from srcatlas.functions.storage import stored
from srcatlas.llm.components import components, forest
from srcatlas.llm.words import Texts, U, blocks, distinct, listed, mapped, mixed, signed

SHINGLE = 5
LIKE = 75
ROWS = 4
BANDS = 32
M = ROWS * BANDS
AGREE = 0.5
NEAR = 0.3
BLOCK = 256
#: Shingles whose incidences are multiplied at once.
COLUMNS = 4096


def shingle_sets(block: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each text, ascending, one text after another, and how many each has."""
    words = block.words(lower=True)
    at, made = words.windows(SHINGLE)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), U)
        for k in range(SHINGLE - 1):
            has = words.count[short] > k
            whole[has] = mixed(whole[has] * U(31) + words.hash[words.first[short][has] + k] + U(k))
        doc, made = np.concatenate([doc, short]), np.concatenate([made, whole])
        order = np.argsort(doc, kind="stable")
        doc, made = doc[order], made[order]
    return distinct(doc, made, block.n)


def superminhash(sets: np.ndarray, counts: np.ndarray, m: int = M) -> np.ndarray:
    """A row of ``m`` values for each set: the rank in the upper byte, the fraction below. Empty sets: all ones."""
    n = len(counts)
    out = np.full(n * m, ~U(0))
    element, doc = sets, np.repeat(np.arange(n), counts)
    places: np.ndarray | None = None
    for rank in range(m):
        drawn = mixed(element + U((rank + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        take = rank + ((drawn & U(0xFFFF)) * U(m - rank) >> U(16)).astype(np.int64)
        if places is None:
            place = take
        else:
            at = np.arange(len(element))
            place = places[at, take].astype(np.int64)
            places[at, take] = places[:, rank]
        np.minimum.at(out, doc * m + place, (U(rank) << U(56)) | (drawn >> U(16)) << U(8))
        # a set is done when no later rank can lower any of its places
        open_ = out.reshape(n, m).max(axis=1) >= U(rank + 1) << U(56) if rank + 1 < m else np.zeros(n, bool)
        go = open_[doc]
        if not go.any():
            break
        if places is None:
            places = np.tile(np.arange(m, dtype=np.uint8), (int(go.sum()), 1))
            taken = take[go]
            places[np.arange(len(taken)), taken] = 0
        elif not go.all():
            places = places[go]
        element, doc = element[go], doc[go]
    return out.reshape(n, m)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.md5(values.tobytes(), usedforsecurity=False).digest()


def _signature_rows(block: Texts) -> list[pa.Array]:
    sets, counts = shingle_sets(block)
    ends = np.concatenate([[0], np.cumsum(counts)])
    digest = [_digest(sets[a:b]) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
    signature = superminhash(sets, counts)
    code = mixed(signature)
    bands = np.zeros((block.n, BANDS), U)
    for k in range(ROWS):
        bands = mixed(bands * U(31) + code[:, k::ROWS] + np.arange(BANDS, dtype=U))
    marks = (code >> U(56)).astype(np.uint8)
    return [
        pa.array(counts.astype(np.int64)),
        pa.array(digest, pa.binary()),
        listed(signed(bands.ravel()), np.full(block.n, BANDS), pa.int64()),
        pa.array([x.tobytes() for x in marks], pa.binary()),
    ]


def signatures(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, marks`` of each row; marks have a byte for each place."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                own = [batch.column("doc_id")[block.rows], *_signature_rows(block)]
                yield pa.RecordBatch.from_arrays(own, ["doc_id", "n_shingles", "digest", "bands", "marks"])

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return mapped(rows, made, "doc_id long, n_shingles long, digest binary, bands array<long>, marks binary")


def _agreeing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """``a, b, agree`` of the pairs whose signatures agree in at least ``NEAR`` of the places."""
    left = marks.select(F.col("doc_id").alias("a"), F.col("marks").alias("left"))
    right = marks.select(F.col("doc_id").alias("b"), F.col("marks").alias("right"))
    both = pairs.join(left, "a").join(right, "b")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, M)
                for n in ("left", "right")
            )
            agree = (x == y).mean(axis=1)
            own = [batch.column("a"), batch.column("b"), pa.array(agree)]
            yield pa.RecordBatch.from_arrays(own, ["a", "b", "agree"]).filter(pa.array(agree >= NEAR))

    return mapped(both.select("a", "b", "left", "right"), made, "a long, b long, agree double")


def shingles_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, shingles`` of the documents whose ids are ``wanted``: whole sets, as ascending hashes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                sets, counts = shingle_sets(block)
                lists = listed(signed(sets), counts, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[block.rows], lists], ["doc_id", "shingles"])

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    rows = rows.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    return mapped(rows, made, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links by their full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    total = F.size("left") + F.size("right") - common
    # no aggregate on top: a join alone can be split where many pairs share a member
    return pairs.join(left, "a").join(right, "b").filter(100 * common >= LIKE * total).select("a", "b")


def _block_links(block: pa.Table) -> pa.Table:
    """Links between rows of unlike components of a block, joined by union-find."""
    doc = block.column("doc_id").to_numpy()
    own = block.column("component").to_numpy()
    lists = block.column("shingles").combine_chunks()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), size)
    _, place, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    # shingles of one row alone are in no intersection
    shared = np.cumsum(times > 1) - 1
    keep = times[place] > 1
    row, place = row[keep], shared[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((len(doc), len(doc)), np.float64)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [first, first + COLUMNS])
        part = np.zeros((len(doc), COLUMNS), np.float32)
        part[row[a:b], place[a:b] - first] = 1
        common += part @ part.T
    total = size[:, None] + size[None, :] - common
    linked = (100 * common >= LIKE * total) & (own[:, None] != own[None, :]) & (total > 0)
    x, y = np.nonzero(np.triu(linked, 1))
    pairs = forest(list(zip(doc[x].tolist(), doc[y].tolist(), strict=True)))
    return pa.table({n: pa.array([p[i] for p in pairs], pa.int64()) for i, n in enumerate("ab")})


def cluster_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between unlike components of one cluster, from ``(cluster, doc_id, component)`` of all its members."""
    sizes = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = main.filter("parts > 1").select(
        "cluster",
        F.col("main.component").alias("main"),
        blocks(F.col("main.n")).alias("inner"),
        blocks(F.col("all") - F.col("main.n")).alias("outer"),
    )
    rows = members.join(stored(main, "mixed"), "cluster")
    is_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("doc_id"), F.when(is_main, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    key = lambda i, kind, j: F.struct(i.alias("i"), F.lit(kind).alias("kind"), j.alias("j"))
    mine = F.col("own")
    inside = F.transform(upto(F.col("outer")), lambda i: key(i, "main", mine))
    outside = F.concat(
        F.transform(upto(F.col("inner")), lambda j: key(mine, "main", j)),
        F.transform(upto(F.col("outer")), lambda j: key(F.least(mine, j), "rest", F.greatest(mine, j))),
    )
    rows = rows.select("cluster", "doc_id", "component", F.explode(F.when(is_main, inside).otherwise(outside)).alias("k"))
    rows = rows.join(sets, "doc_id").select("cluster", "k.*", "doc_id", "component", "shingles")
    ship(rows.sparkSession)
    return rows.groupBy("cluster", "i", "kind", "j").applyInArrow(_block_links, "a long, b long")


def cut_clusters(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` of clusters with several components, in smaller clusters between which there is no link.

    A part is named by its smallest component. Shingles of a set come by how many members of its cluster have them, then by
    hash; of each, only those of the prefix that another one has too are joined, with the smallest component that has it there.
    """
    mixed = members.groupBy("cluster").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    rows = stored(members.join(mixed.filter("least < most").select("cluster"), "cluster"), "mixed")
    # a set is hashed before it is taken apart, not once for each shingle
    own = rows.join(sets, "doc_id").select(
        "cluster", "component", F.xxhash64("shingles").alias("row"), F.size("shingles").alias("n"), "shingles"
    )
    each = own.select("cluster", "component", "row", "n", F.explode("shingles").alias("s"))
    often = each.groupBy("cluster", "s").agg(F.count(F.lit(1)).alias("often"))
    # equal sets of one component count as one
    ranked = each.join(often, ["cluster", "s"]).groupBy("cluster", "component", "row", "n")
    ranked = ranked.agg(F.sort_array(F.collect_set(F.struct("often", "s"))).alias("all"))
    first = F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * LIKE / 100).cast("int") + 1)
    heads = ranked.select("cluster", "component", F.explode(F.filter(first, lambda x: x["often"] > 1)["s"]).alias("s"))
    # a component is linked already: one row of it for each shingle will do
    heads = stored(heads.distinct(), "heads")
    low = heads.groupBy("cluster", "s").agg(F.min("component").alias("low"))
    parts = components(heads.join(low, ["cluster", "s"]).filter("low < component").select("component", "low"))
    joined = rows.join(parts.withColumnRenamed("node", "component"), "component", "left")
    return joined.select(F.coalesce("up", "component").alias("cluster"), "doc_id", "component")


class Groups:
    """The classes of equal sets and their components, in tables of the shared folder."""

    def __init__(self, documents: DataFrame):
        self.signatures = stored(signatures(documents), "signatures")
        known = self.signatures.filter("digest is not null and doc_id is not null")
        self.classes = stored(known.groupBy("digest").agg(F.min("doc_id").alias("first")), "classes")
        # one row stands for each class
        first = known.join(self.classes, (known["doc_id"] == self.classes["first"]) & (known["digest"] == self.classes["digest"]), "left_semi")
        self.first = stored(first.dropDuplicates(["doc_id", "digest"]).select("doc_id", "bands", "marks"), "first")
        members = self.first.select("doc_id", F.explode("bands").alias("band"))
        buckets = members.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        buckets = stored(buckets.filter("low < high"), "buckets")
        ends = F.explode(F.array("low", "high")).alias("end")
        pairs = members.join(buckets, "band").select("doc_id", ends).filter("end <> doc_id")
        pairs = pairs.select(F.least("doc_id", "end").alias("a"), F.greatest("doc_id", "end").alias("b")).distinct()
        pairs = stored(_agreeing(pairs, self.first.select("doc_id", "marks")), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = stored(shingles_of(documents, wanted), "shingles")
        links = stored(confirmed(pairs.filter(F.col("agree") >= AGREE).select("a", "b"), sets), "links")
        found = components(links)
        clusters = components(pairs.select("a", "b")).withColumnRenamed("up", "cluster")
        # a cluster's smallest member is not among the nodes
        heads = clusters.select(F.col("cluster").alias("node"), "cluster").distinct()
        members = clusters.union(heads).join(found, "node", "left")
        members = members.select("cluster", F.col("node").alias("doc_id"), F.coalesce("up", "node").alias("component"))
        parts = stored(cut_clusters(stored(members, "members"), sets), "parts")
        more = stored(cluster_links(parts, sets), "links")
        self.components = components(links.union(more)) if more.limit(1).count() else found


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row."""
    groups = Groups(documents)
    up = groups.components.select(F.col("node").alias("first"), "up")
    own = groups.classes.join(up, "first", "left").select("digest", F.coalesce("up", "first").alias("component"))
    # rows without a class stay out of the join's key
    rows = groups.signatures.select("doc_id", "n_shingles", "digest")
    joined = rows.filter("digest is not null and doc_id is not null").join(stored(own, "owners"), "digest")
    # rows of one doc_id may be of several classes, which are one node
    alone = rows.filter("digest is null or doc_id is null")
    out = joined.select("doc_id", "n_shingles", "component").union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    return out.select(
        "doc_id",
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose ``doc_id`` is the smallest of its component, with all their columns."""
    gone = near_duplicates(documents).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return documents.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
