"""Fill-in-the-middle transformation by piece tables.

A document is a row of descriptors (buffer, start, length) over two buffers that never change: its text and the sentinels.
Cutting splits the one descriptor of a text in three, sentinels are descriptors too, an arrangement is a permutation of
descriptors, and digests stream over descriptors. Restoring reads an output as a new immutable buffer, splits its one
descriptor at the sentinels and applies the inverse permutation. Texts are copied only where an output is asked for.

Tokens are matches of ``[A-Za-z]+|[^A-Za-z]``. Cuts and forms follow from the SHA-256 of ``1:`` and the decimal ``doc_id``. A text
that holds a sentinel stays as it is (form ``plain``), so sentinels of other forms are the only ones in their output: a
sentinel cannot arise where two pieces meet, because it begins with ``<`` and has no other.

Defined results: a null text counts as empty, and an empty text is plain. A null ``doc_id`` counts as no digits.
Repeated rows give repeated results. Texts of any length are cut as a whole. An empty table gives no rows. Other columns
of the input are not read. An output whose form is not plain, but which lacks a sentinel or has one twice or out of order, is
restored as null; a null output or form too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from srcatlas.llm.words import Texts, blocks, mapped

PLAIN_FROM = 90
SPM_BELOW = 20
#: The sentinel of each part, parts in the order of the text: prefix, middle, suffix.
MARKS = (b"<P>", b"<M>", b"<S>")
WIDTH = len(MARKS[0])
#: The order in which the parts follow each other, by form.
ARRANGEMENTS = {"plain": (0, 1, 2), "psm": (0, 2, 1), "spm": (2, 0, 1)}
FORMS = tuple(ARRANGEMENTS)
TEXT, SENTINEL = 0, 1
_ORDER = np.array([ARRANGEMENTS[f] for f in FORMS])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class PieceTable:
    """Descriptors over a block of texts: ``buffer``, ``start`` and ``length``, each a row of columns for a document.

    Descriptors of length 0 stand for nothing.
    """

    def __init__(self, block: Texts, buffer: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.block, self.buffer, self.start, self.length = block, buffer, start, length
        self._views = memoryview(block.data), memoryview(b"".join(MARKS))

    @classmethod
    def whole(cls, block: Texts) -> PieceTable:
        start = block.offsets[:-1, None].copy()
        return cls(block, np.zeros_like(start), start, np.diff(block.offsets)[:, None])

    def cut(self, *ends: np.ndarray) -> PieceTable:
        """Each document's only descriptor split where ``ends``, places in the text buffer, say."""
        edges = np.stack([self.start[:, 0], *ends, self.start[:, 0] + self.length[:, 0]], axis=1)
        return PieceTable(self.block, np.zeros_like(edges[:, 1:]), edges[:, :-1], np.diff(edges, axis=1))

    def marked(self, where: np.ndarray) -> PieceTable:
        """A sentinel before each part, of length 0 in documents that are not in ``where``."""
        n, parts = self.start.shape
        both = [np.zeros((n, 2 * parts), np.int64) for _ in range(3)]
        for made, own, mark in zip(both, (self.buffer, self.start, self.length), (SENTINEL, np.arange(parts) * WIDTH, WIDTH), strict=True):
            made[:, 0::2], made[:, 1::2] = mark, own
        both[2][~where, 0::2] = 0
        return PieceTable(self.block, *both)

    def permuted(self, order: np.ndarray) -> PieceTable:
        return PieceTable(self.block, *(np.take_along_axis(x, order, 1) for x in (self.buffer, self.start, self.length)))

    def pieces(self, i: int) -> list[memoryview]:
        return [
            self._views[b][s : s + n]
            for b, s, n in zip(self.buffer[i].tolist(), self.start[i].tolist(), self.length[i].tolist(), strict=True)
            if n
        ]

    def text(self, i: int) -> bytes:
        return b"".join(self.pieces(i))

    def sha256(self, i: int) -> str:
        made = hashlib.sha256()
        for piece in self.pieces(i):
            made.update(piece)
        return made.hexdigest()


def token_starts(block: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens begin, and for each text the place of its first one among them (and the end)."""
    letter = _LETTER[block.data]
    starts = (block.data & 0xC0) != 0x80
    inner = np.zeros(len(starts), bool)
    inner[1:] = letter[1:] & letter[:-1]
    edges = block.offsets[:-1]
    inner[edges[edges < len(inner)]] = False
    at = np.flatnonzero(starts & ~inner)
    return at, np.searchsorted(at, block.offsets)


def sentinels(block: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where sentinels are: their document, which part's, and their place; in order of place."""
    data = block.data
    if len(data) < WIDTH:
        return (np.zeros(0, np.int64),) * 3
    open_, close = np.frombuffer(MARKS[0], np.uint8)[[0, -1]]
    at = np.flatnonzero((data[: 1 - WIDTH] == open_) & (data[WIDTH - 1 :] == close))
    part = np.full(len(at), -1)
    for k, mark in enumerate(MARKS):
        part[data[at + 1] == mark[1]] = k
    doc = np.searchsorted(block.offsets, at, "right") - 1
    inside = (part >= 0) & (at + WIDTH <= block.offsets[doc + 1])
    return doc[inside], part[inside], at[inside]


def cut_block(block: Texts, h: np.ndarray) -> tuple[PieceTable, np.ndarray, np.ndarray, np.ndarray]:
    """The arranged table of a block, and for each text its tokens' number, its form and where prefix and middle end.

    ``h`` has four numbers for each text.
    """
    at, first = token_starts(block)
    n = np.diff(first)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    place = np.append(at, len(block.data))
    ends = np.where(cuts == n[:, None], block.offsets[1:, None], place[np.minimum(first[:-1, None] + cuts, len(at))])
    form = np.where(h[:, 3] % 100 < SPM_BELOW, FORMS.index("spm"), FORMS.index("psm"))
    form[h[:, 2] % 100 >= PLAIN_FROM] = 0
    form[n == 0] = 0
    form[sentinels(block)[0]] = 0
    ends[form == 0] = block.offsets[1:, None][form == 0]
    table = PieceTable.whole(block).cut(ends[:, 0], ends[:, 1]).marked(form != 0)
    return table.permuted(_doubled(_ORDER[form])), n, form, ends


def restored_block(block: Texts, form: np.ndarray) -> tuple[PieceTable, np.ndarray]:
    """The table of the texts that outputs came from, and which of them are well formed."""
    doc, part, place = sentinels(block)
    marked = form != 0
    count = np.bincount(doc, minlength=block.n)
    good = ~marked | (count == len(MARKS))
    full = np.flatnonzero(marked & good)
    of_full = np.isin(doc, full)
    seen, begin = part[of_full].reshape(-1, len(MARKS)), place[of_full].reshape(-1, len(MARKS))
    order = _ORDER[form[full]]
    good[full] = (seen == order).all(axis=1) & (begin[:, 0] == block.offsets[full])
    # a plain output is one part; of others, each part is a sentinel and a piece
    ends = np.repeat(block.offsets[1:, None], 2 * len(MARKS) - 1, axis=1)
    ends[full, 0::2] = begin + WIDTH
    ends[full, 1::2] = begin[:, 1:]
    table = PieceTable.whole(block).cut(*ends.T)
    table.length[full, 0::2] = 0
    back = np.argsort(_doubled(_ORDER[np.where(marked, form, 0)]), axis=1)
    return table.permuted(back), good


def _doubled(order: np.ndarray) -> np.ndarray:
    """The same order for pairs of columns."""
    return np.stack([2 * order, 2 * order + 1], axis=2).reshape(len(order), -1)


def _numbers(doc_id: Column) -> list[Column]:
    made = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(made, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def arranged(documents: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, output_sha256`` of each row of ``(doc_id, text)``."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", *_numbers(F.col("doc_id")))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)], axis=1)
            for block in blocks(batch.column("text")):
                table, n, form, ends = cut_block(block, h[block.rows])
                points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                chars = np.diff(points[np.column_stack([block.offsets[:-1], ends])], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[block.rows],
                        pa.array(n, pa.int64()),
                        pa.array([FORMS[f] for f in form], pa.string()),
                        pa.array(chars[:, 0], pa.int64(), mask=form == 0),
                        pa.array(chars[:, 1], pa.int64(), mask=form == 0),
                        pa.array([table.text(i) for i in range(block.n)], pa.binary()).cast(pa.string()),
                        pa.array([table.sha256(i) for i in range(block.n)], pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"],
                )

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
    return mapped(rows, made, schema)


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the text that ``output`` and ``form`` came from and its digest, as ``restored`` and ``restored_sha256``.

    Columns that have these names already, in whatever case, are replaced.
    """
    own = [StructField("restored", StringType()), StructField("restored_sha256", StringType())]
    outputs = outputs.drop(*(f.name for f in own))
    schema = StructType([*outputs.schema.fields, *own])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {f: k for k, f in enumerate(FORMS)}
        for batch in batches:
            names, output = batch.schema.names, batch.column("output")
            there = output.is_valid().to_numpy(zero_copy_only=False)
            form = np.array([known.get(f, -1) for f in batch.column("form").to_pylist()], np.int64)
            there &= form >= 0
            for block in blocks(output):
                table, good = restored_block(block, np.maximum(form[block.rows], 0))
                good &= there[block.rows]
                texts = [table.text(i) if good[i] else None for i in range(block.n)]
                digests = [table.sha256(i) if good[i] else None for i in range(block.n)]
                own = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch[block.rows].columns, *own], [*names, "restored", "restored_sha256"])

    return mapped(outputs, made, schema)
