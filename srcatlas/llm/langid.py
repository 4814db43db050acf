"""Language identification by bit-sliced Bloom filters of character n-grams.

The filters of all languages share their hash functions and lie side by side: row ``i`` of the table holds the ``i``-th bit of every
language's filter. The ``AND`` of an n-gram's ``HASHES`` rows is a mask of all languages that contain it. A text's masks are counted by
language; a filter whose share of set bits is ``f`` claims a share ``f ** HASHES`` of what it does not hold, and the counts are
corrected for that. The largest one decides; ``score`` is its share of the sum of the two largest.

n-grams are ``SIZES`` neighbouring code points of a lower-cased text in which each run of other characters than letters is one
gap; a gap is only at the ends of an n-gram. A language holds an n-gram if at least ``SUPPORT`` of its texts (two at least)
have it, and at least one ``RATIO``-th of the share of texts that the language with the largest share has.

Learned from: documents with a language whose ``crc32(doc_id)`` is not 0 modulo 5; of each language about ``DOCUMENTS``, chosen by a
hash below a bound that follows from the language's number of documents, equal texts once; at most ``LANGUAGES`` languages, those with
the most documents. Counting is done by Spark; the driver gets the table, ``SLOTS`` rows of one bit for each language.

Defined results: a null text, or one without letters, is ``und`` with score 0. A text none of whose n-grams is known gets the
language with most documents and score 0, as everything does if all languages tie; ties go to the language with more
documents, then to the first by name. If nothing can be learned, every row is ``und``. A null ``doc_id`` is neither held out
nor learned from. Each input row gives one row; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.storage import stored
from srcatlas.llm.words import Texts, U, blocks, mapped, mixed, stream

SIZES = (2, 3, 4)
SUPPORT = 0.005
RATIO = 20
DOCUMENTS = 3_000
LANGUAGES = 64
SLOTS = 1 << 20
HASHES = 3
SEED = 5
NONE = "und"


@cache
def _letters() -> np.ndarray:
    """The lower-case form of each code point that is a letter, 0 for others."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            lower = char.lower()
            out[c] = ord(lower) if len(lower) == 1 else c
    return out


class Grams:
    """The n-grams of a block of texts: ``value`` and ``doc`` of each; ``lettered``: which texts have a letter."""

    def __init__(self, block: Texts):
        points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])[block.offsets]
        text = block.data.tobytes().decode("utf-8", "replace")
        letter = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        own = np.repeat(np.arange(block.n), np.diff(points))
        self.n = block.n
        self.lettered = np.bincount(own[letter > 0], minlength=block.n) > 0
        # a gap before each text and at the end, and one for each run of gaps
        code, doc = np.zeros((2, len(letter) + block.n + 1), np.int64)
        at = np.arange(len(letter)) + own + 1
        code[at], doc[at] = letter, own
        kept = np.ones(len(code), bool)
        kept[1:] = (code[1:] > 0) | (code[:-1] > 0)
        code, doc = code[kept], doc[kept]
        values, docs = [], []
        for size in SIZES:
            m = max(len(code) - size + 1, 0)
            # letters inside; of two neighbours one is a letter anyway
            whole, made = np.ones(m, bool), np.full(m, size, U)
            for i, factor in enumerate(stream(size, SEED + 1009 * size)):
                made += code[i : m + i].astype(U) * factor
                if 0 < i < size - 1:
                    whole &= code[i : m + i] > 0
            values.append(mixed(made[whole]))
            docs.append(np.where(code[:m] > 0, doc[:m], doc[1 : m + 1])[whole])
        self.value, self.doc = np.concatenate(values), np.concatenate(docs)


def places(values: np.ndarray, slots: int) -> list[np.ndarray]:
    """The rows of each value in a table of ``slots``, a power of 2."""
    step = (values >> U(32)) | U(1)
    return [((values + U(k) * step) & U(slots - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """``table[i]`` holds bit ``i`` of each language's filter, eight languages in a byte."""

    def __init__(self, table: np.ndarray, languages: list[str]):
        self.table, self.languages = table, languages
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        self._bits = bits.astype(float)
        fill = [np.bincount(column, minlength=256) @ bits / max(len(column), 1) for column in table.T]
        self.fill = np.concatenate(fill)[: len(languages)] if fill else np.zeros(0)

    @property
    def false_positive(self) -> np.ndarray:
        return self.fill**HASHES

    def masks(self, values: np.ndarray) -> np.ndarray:
        """The languages that contain each value."""
        out = None
        for at in places(values, len(self.table)):
            own = self.table[at]
            out = own if out is None else out & own
        return out

    def counts(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of its n-grams, and of those that each language contains."""
        masks = self.masks(grams.value)
        parts = [
            np.bincount(grams.doc * 256 + masks[:, k], minlength=256 * grams.n).reshape(grams.n, 256) @ self._bits
            for k in range(masks.shape[1])
        ]
        return np.bincount(grams.doc, minlength=grams.n), np.concatenate(parts, axis=1)[:, : len(self.languages)]

    def decide(self, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the place of its language (-1: none), the score and the number of n-grams."""
        n, hits = self.counts(grams)
        wrong = self.false_positive
        right = np.maximum((hits - wrong * n[:, None]) / np.maximum(1 - wrong, 1e-9), 0)
        best = right.argmax(axis=1)
        order = np.sort(right, axis=1)
        first = order[:, -1]
        both = first + (order[:, -2] if right.shape[1] > 1 else 0)
        score = np.where(first > 0, first / np.where(both > 0, both, 1), 0.0)
        return np.where(grams.lettered, best, -1), np.where(grams.lettered, score, 0.0), n


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(documents: DataFrame) -> Filters | None:
    """The filters of the languages of ``documents``; None if there is nothing to learn from."""
    known = documents.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    known = known.filter(~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    languages = [r["lang"] for r in sizes]
    # shares of a hash's range, so that no rows have to be ordered
    share = F.element_at(F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(DOCUMENTS / r["count"])))), F.col("lang"))
    number = F.element_at(F.create_map(*(x for k, r in enumerate(languages) for x in (F.lit(r), F.lit(k)))), F.col("lang"))
    some = known.filter(F.col("lang").isin(languages)).withColumn("language", number)
    some = some.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30)) < share * (1 << 30))
    some = some.select("language", "text").groupBy("language", F.xxhash64("text").alias("_key")).agg(F.first("text").alias("text"))
    counted = stored(_text_counts(some).groupBy("language", "gram").agg(F.sum("n").alias("n")), "grams")
    whole = {r["language"]: r["n"] for r in counted.filter("gram is null").collect()}
    table = _table(counted.filter("gram is not null"), whole, len(languages))
    return Filters(table, languages)


def _text_counts(texts: DataFrame) -> DataFrame:
    """``language, gram, n``: how many texts of each block have the n-gram; with a null ``gram`` how many texts there are."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = batch.column("language").to_numpy().astype(np.int64)
            for block in blocks(batch.column("text")):
                grams, own = Grams(block), language[block.rows]
                order = np.lexsort((grams.value, grams.doc))
                value, doc = grams.value[order], grams.doc[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                for k in np.unique(own):
                    found, n = np.unique(value[new & (own[doc] == k)], return_counts=True)
                    gram = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(found.view(np.int64))])
                    many = np.append((own == k).sum(), n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(many), k, np.int32)), gram, pa.array(many, pa.int64())], ["language", "gram", "n"]
                    )

    return mapped(texts, made, "language int, gram long, n long")


def _table(counted: DataFrame, whole: dict[int, int], n_languages: int) -> np.ndarray:
    """The table of bits; ``whole``: the number of texts of each language."""
    texts = F.element_at(F.create_map(*(x for k, n in whole.items() for x in (F.lit(k), F.lit(n)))), F.col("language"))
    rows = counted.withColumn("share", F.col("n") / texts).filter((F.col("n") >= 2) & (F.col("share") >= SUPPORT))
    # at most one entry for each language
    rows = rows.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("language", "share")).alias("own"))
    width = -(-n_languages // 8)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column("gram").to_numpy().view(U)
            own = batch.column("own")
            count = own.value_lengths().to_numpy().astype(np.int64)
            flat = own.flatten()
            language = flat.field("language").to_numpy().astype(np.int64)
            enough = flat.field("share").to_numpy() * RATIO >= np.repeat(batch.column("most").to_numpy(), count)
            at = np.concatenate(places(np.repeat(value, count)[enough], SLOTS)) * width
            language = np.tile(language[enough], HASHES)
            cell, bit = at + language // 8, np.left_shift(1, language % 8)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(bit, pa.int64())], ["cell", "bit"])

    cells = mapped(rows, made, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").cast("short").alias("bits"))
    found = cells.toArrow()  # at most SLOTS * width rows of ten bytes
    table = np.zeros(SLOTS * width, np.uint8)
    table[found["cell"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return table.reshape(SLOTS, width)


def identified(documents: DataFrame) -> DataFrame:
    """``doc_id, lang_pred, score, n_grams`` of each row of ``(doc_id, text, lang)``."""
    filters = learned(documents)
    rows, kind = documents.select("doc_id", "text"), documents.schema["doc_id"].dataType.simpleString()
    if filters is None:
        return rows.select("doc_id", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_grams"))
    names = np.array([*filters.languages, NONE], object)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                language, score, n = filters.decide(Grams(block))
                own = [pa.array(names[language], pa.string()), pa.array(score), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[block.rows], *own], ["doc_id", "lang_pred", "score", "n_grams"]
                )

    return mapped(rows, made, f"doc_id {kind}, lang_pred string, score double, n_grams long")
