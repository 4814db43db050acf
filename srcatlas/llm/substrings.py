"""Substring dedup: words of long passages that also stand in a document with a smaller id.

A window is ``WINDOW`` words in a row. Each word is removed that is covered by a window whose word sequence also
starts in a document with a smaller ``doc_id``. Windows are judged on the input, not on what is left.

Method: the residues ``COVER`` modulo ``PERIOD`` are a difference cover: for any two positions there is
a shift below ``PERIOD`` that takes both to residues of the cover. So two equal windows, wherever they start,
hold an equal anchor (``ANCHOR`` words) that both texts hash, though a text hashes at cover positions only.

1. Each text's anchors are hashed; the hashes that more than one document has are kept.
2. Each document gets the positions of its shared anchors. Its windows that hold one of them are hashed
   with 128 bits: this extends the anchors to whole windows. All others cannot be equal to another document's.
3. Each window hash has its smallest document; the larger ones lose the window's words.

Documents with the word sequence of a smaller one are found by a digest of it before, and take no part in 2 and 3. Every
step is linear in the input: no pairs are made, groups are counted before they are moved, and the two joins on hashes
have one row for each hash on one side, so that a common passage lengthens only the side that can be split.

Defined results: a null text has no words. A document of fewer words than a window keeps all of them. A null
``doc_id`` is no smaller than any other: its row keeps its words, and removes none of others. Rows
with one ``doc_id`` do not remove each other's words. Repeats inside one document stay. Each input row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.storage import stored
from srcatlas.llm.words import Words, blocks, mapped, signed

WINDOW = 50
PERIOD = 31
#: A perfect difference set: every residue but 0 is the difference of two of these exactly once.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
NOTHING = hashlib.sha256(b"").hexdigest()

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _named(df: DataFrame) -> DataFrame:
    """The three columns that are needed; ``row_hash`` tells rows of one ``doc_id`` with other texts apart."""
    return df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"))


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _word_bytes(text: bytes) -> list[bytes]:
    return text.split()


def digests(df: DataFrame) -> DataFrame:
    """``doc_id, row_hash, n_words, words_sha256``: the digest of the words with one space between them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = [_word_bytes(block.text(i)) for i in range(block.n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[block.rows],
                        batch.column("row_hash")[block.rows],
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
                    ],
                    ["doc_id", "row_hash", "n_words", "words_sha256"],
                )

    return mapped(_named(df), made, f"doc_id {_kind(df)}, row_hash long, n_words long, words_sha256 string")


def anchors(df: DataFrame) -> DataFrame:
    """``doc_id, pos, anchor``: the hashed anchors of documents that have a window."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = block.words()
                at, value = words.windows(ANCHOR)
                doc = words.doc[at]
                pos = at - words.first[doc]
                own = _IN_COVER[pos % PERIOD] & (words.count[doc] >= WINDOW)
                doc_id = batch.column("doc_id")[block.rows].take(pa.array(doc[own]))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(pos[own], pa.int32()), pa.array(signed(value[own]))],
                    ["doc_id", "pos", "anchor"],
                )

    known = df.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return mapped(known, made, f"doc_id {_kind(df)}, pos int, anchor long")


def _candidates(words: Words, i: int, shared: np.ndarray) -> np.ndarray:
    """Where the windows of text ``i`` begin that hold a shared anchor, in words of the block."""
    n = int(words.count[i])
    if n < WINDOW:
        return np.zeros(0, np.int64)
    found = np.zeros(n - ANCHOR + 1, bool)
    found[shared[shared < len(found)]] = True
    total = np.concatenate([[0], np.cumsum(found)])
    return np.flatnonzero(total[PERIOD:] > total[: n - WINDOW + 1]) + words.first[i]


def _window_rows(block, shared: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and both hash halves of the block's candidate windows."""
    first, second = block.words(), block.words(seed=1)
    at, high = first.windows(WINDOW)
    _, low = second.windows(WINDOW, seed=1)
    own = np.concatenate([_candidates(first, i, x) for i, x in enumerate(shared)])
    place = np.searchsorted(at, own)
    doc = first.doc[own] if len(own) else own
    return doc, own - first.first[doc], signed(high[place]), signed(low[place])


def _lists(column: pa.Array, rows: slice) -> list[np.ndarray]:
    return [np.array(x.as_py() or [], np.int64) for x in column[rows]]


def windows(suspects: DataFrame) -> DataFrame:
    """``doc_id, row_hash, pos, high, low`` of candidate windows; suspects have ``text`` and ``shared`` positions."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                doc, pos, high, low = _window_rows(block, _lists(batch.column("shared"), block.rows))
                taken = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[block.rows].take(taken),
                        batch.column("row_hash")[block.rows].take(taken),
                        pa.array(pos, pa.int32()),
                        pa.array(high),
                        pa.array(low),
                    ],
                    ["doc_id", "row_hash", "pos", "high", "low"],
                )

    schema = f"doc_id {_kind(suspects)}, row_hash long, pos int, high long, low long"
    return mapped(suspects.select("doc_id", "row_hash", "text", "shared"), made, schema)


class Found:
    """What is to be removed: whole documents (``copies``) and windows (``starts``, by document)."""

    def __init__(self, documents: DataFrame):
        self.base = stored(digests(documents), "words")
        least = self.base.groupBy("words_sha256").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        twins = stored(least.filter("least < most").select("words_sha256", "least"), "twins")
        copies = self.base.filter(F.col("n_words") >= WINDOW).join(twins, "words_sha256")
        self.copies = stored(copies.filter("doc_id > least").select("doc_id", "row_hash", "n_words"), "copies")
        own = anchors(documents)
        shared = own.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        shared = stored(shared.filter("least < most").select("anchor"), "anchors")
        hits = own.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("pos").alias("shared"))
        rows = _named(documents).join(hits.hint("shuffle_hash"), "doc_id")
        self.suspects = stored(rows.join(self.copies.select("doc_id", "row_hash"), ["doc_id", "row_hash"], "left_anti"), "suspects")
        made = windows(self.suspects)
        first = made.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        first = stored(first.filter("least < most").select("high", "low", "least"), "windows")
        later = made.join(first, ["high", "low"]).filter("doc_id > least")
        self.starts = stored(later.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("starts")), "starts")


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(change)[:n] > 0


def _kept(text: bytes, starts: np.ndarray) -> tuple[bytes, int]:
    words = _word_bytes(text)
    gone = _covered(len(words), starts)
    return b" ".join(w for w, g in zip(words, gone, strict=True) if not g), int(gone.sum())


def kept_texts(rows: DataFrame) -> DataFrame:
    """``doc_id, row_hash, n_removed, kept``: the words left of each row, with one space between them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                starts = _lists(batch.column("starts"), block.rows)
                out = [_kept(block.text(i), starts[i]) for i in range(block.n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[block.rows],
                        batch.column("row_hash")[block.rows],
                        pa.array([n for _, n in out], pa.int64()),
                        pa.array([t.decode() for t, _ in out], pa.string()),
                    ],
                    ["doc_id", "row_hash", "n_removed", "kept"],
                )

    schema = f"doc_id {_kind(rows)}, row_hash long, n_removed long, kept string"
    return mapped(rows.select("doc_id", "row_hash", "text", "starts"), made, schema)


def dedup_digests(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row."""
    found = Found(documents)
    cut = kept_texts(found.suspects.join(found.starts, ["doc_id", "row_hash"]))
    cut = cut.select("doc_id", "row_hash", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    whole = found.copies.select("doc_id", "row_hash", F.col("n_words").alias("n_removed"), F.lit(NOTHING).alias("kept_sha256"))
    # rows that are equal in both columns have equal results
    changed = cut.union(whole).dropDuplicates(["doc_id", "row_hash"])
    return found.base.join(changed, ["doc_id", "row_hash"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"),
    )


def dedup(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated passages taken out of their texts; texts that lose nothing stay as they are.

    Changed texts have one space between their words; ``n_chars`` follows if there is such a column.
    """
    found = Found(documents)
    cut = kept_texts(found.suspects.join(found.starts, ["doc_id", "row_hash"])).select("doc_id", "row_hash", "kept")
    changed = cut.union(found.copies.select("doc_id", "row_hash", F.lit("").alias("kept")))
    changed = changed.dropDuplicates(["doc_id", "row_hash"])
    names = set(documents.columns)
    # struct fields: a column of the input may have any name
    rows = documents.select(
        F.struct(*(F.col(f"`{n}`") for n in documents.columns)).alias("r"),
        F.col("doc_id").alias("d"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
    )
    other = changed.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("h"), "kept")
    joined = rows.join(other.hint("shuffle_hash"), ["d", "h"], "left")
    new = {"text": F.coalesce("kept", "r.text")}
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(kind)).otherwise(F.col("r.n_chars"))
    return joined.select(*((new[n] if n in new else F.col(f"r.`{n}`")).alias(n) for n in documents.columns))
