"""Byte-pair encoding and decoding, cut at forced boundaries.

No merge can join two neighbouring bytes that stand side by side inside no token of the vocabulary. Every
such place is a certain cut: the fragments between cuts are encoded by themselves, many at once, and their ids
are put one after another. White space and the pattern of the vocabulary file cut first; the words that these
leave are encoded once for each distinct one that a worker meets.

Files of the ``tokenizers`` library with a BPE model, a word-end suffix, NFC and lower case, a splitting pattern
and byte-level symbols are read; others are refused.

Defined results: a null or empty text has no ids and decodes to the empty text. A null list of ids decodes
to the empty text. Rows with equal texts get equal ids; every input row gives one output row; other columns
pass through, and added columns take names that the input does not have, or replace those asked for.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from srcatlas.llm.words import blocks, listed, mapped

#: Texts between white space that a worker remembers; a memory only, results do not depend on it.
REMEMBERED = 200_000
#: Longer fragments are merged with a queue instead of by looking through them.
SHORT = 40
_NONE = 1 << 62
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + n)
    return [shown[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (
            model["type"] != "BPE"
            or not model["end_of_word_suffix"]
            or steps != ["NFC", "Replace", "Lowercase"]
            or [x["type"] for x in splits] != ["Split", "ByteLevel"]
            or spec["decoder"] is not None
            or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        ):
            raise ValueError(f"not a vocabulary of the kind that is read here: {path}")
        vocab: dict[str, int] = model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        #: by a name that no piece of a text can have, because it holds a blank
        self.special = {f" {x}": i for x, i in special.items()}
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        longest_first = sorted(special, key=len, reverse=True)
        self.control = regex.compile("|".join(map(regex.escape, longest_first))) if special else None
        tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.string())
        # symbols 0 to 255 are bytes inside a word, 256 to 511 bytes that end one
        end = model["end_of_word_suffix"]
        shown = _byte_symbols()
        self.first = np.array([vocab[c] for c in shown] + [vocab[c + end] for c in shown])
        #: by left and right id: the rank and, in the low bits, the id that is made
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 24 | vocab[b]] = rank << 24 | vocab[a + b]
        self.keys = np.array([*sorted(self.merges), _NONE])
        self.made = np.array([*(self.merges[k] for k in sorted(self.merges)), _NONE])
        #: pairs of symbols that stand side by side inside some token
        self.joined = np.zeros((512, 512), bool)
        of = {c: b for b, c in enumerate(shown)}
        for token in vocab:
            ended = token.endswith(end)
            own = [of[c] for c in (token.removesuffix(end) if ended else token)]
            if ended and own:
                own[-1] += 256
            self.joined[own[:-1], own[1:]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.remembered = _Lists.of([], [])

    def words_ids(self, words: list[bytes]) -> _Lists:
        """The ids of words, none of them empty: cut into fragments, these merged, and joined again."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        symbols[ends - 1] += 256
        cut = np.ones(len(symbols), bool)
        cut[1:] = ~self.joined[symbols[:-1], symbols[1:]]
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(symbols)))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            if length > SHORT:
                for i in own:
                    ids = self.first[symbols[starts[i] : starts[i] + length]].tolist()
                    parts.append((own[own == i], np.array([self._merged_long(ids)])))
            else:
                parts += self._merged(own, self.first[symbols[starts[own][:, None] + np.arange(length)]])
        counts = np.zeros(len(starts), np.int64)
        for rows, ids in parts:
            counts[rows] = ids.shape[1]
        begins = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in parts:
            flat[begins[rows][:, None] + np.arange(ids.shape[1])] = ids
        return _Lists.of(flat, np.add.reduceat(counts, np.searchsorted(starts, ends - sizes)))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 24 | right
        place = np.searchsorted(self.keys, pairs)
        return np.where(self.keys[place] == pairs, self.made[place], _NONE)

    def _merged(self, rows: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges fragments of one length, a row each: the earliest merge first, of equal ones the leftmost.

        Each step makes every row that still merges shorter by one; those that do not are given out.
        """
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            if width == 1:
                yield rows, ids
                return
            place = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), place]
            done = least == _NONE
            if done.any():
                yield rows[done], ids[done]
                go = ~done
                rows, ids, ranks, place, least = rows[go], ids[go], ranks[go], place[go], least[go]
            at = np.arange(len(rows))
            made = least & 0xFFFFFF
            ids[at, place] = made
            rest = np.ones(ids.shape, bool)
            rest[at, place + 1] = False
            ids = ids[rest].reshape(len(rows), width - 1)
            rest = np.ones(ranks.shape, bool)
            rest[at, place] = False
            ranks = ranks[rest].reshape(len(rows), width - 2)
            left = place > 0
            ranks[at[left], place[left] - 1] = self._ranks(ids[at[left], place[left] - 1], made[left])
            right = place < width - 2
            ranks[at[right], place[right]] = self._ranks(made[right], ids[at[right], place[right] + 1])

    def _merged_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.merges.get(ids[i] << 24 | ids[after[i]])) is not None:
                heapq.heappush(queue, (found, i, ids[i], ids[after[i]]))

        for i in range(n):
            offer(i)
        while queue:
            found, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = found & 0xFFFFFF, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> _Lists:
        pieces = [self._pieces(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        new = list(set(chain.from_iterable(pieces)).difference(self.known))
        if new:
            found = [[x] if x in self.special else self.pattern.findall(x) for x in new]
            words = list(set(chain.from_iterable(found)).difference(self.special))
            lists = self.words_ids([x.encode() for x in words]) if words else _Lists.of([], [])
            lists = lists.and_(_Lists.of([*self.special.values()], [1] * len(self.special)))
            place = {x: i for i, x in enumerate([*words, *self.special])}
            self.known |= {x: i for i, x in enumerate(new, len(self.known))}
            self.remembered = self.remembered.and_(lists.joined(found, place))
        return self.remembered.joined(pieces, self.known)

    def _pieces(self, text: str) -> list[str]:
        """Texts between white space, in lower case, and control tokens as they are."""
        if not self.control or "<" not in text:
            return self._plain(text)
        out: list[str] = []
        at = 0
        for found in self.control.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(f" {found.group()}")
            at = found.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # one character at a time, as the vocabulary's library does: no form for the end of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split also splits at these four control characters, which are no white space here
        return text.split() if not _SEPARATORS.search(text) else self.pattern.findall(text)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists without nulls."""
        tokens = self.tokens.take(ids.values[ids.offsets[0].as_py() : ids.offsets[-1].as_py()])
        offsets = pc.subtract(ids.offsets, ids.offsets[0])
        return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")


class _Lists:
    """Lists of numbers, one after another."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts = flat, counts
        self.starts = np.cumsum(counts) - counts

    @classmethod
    def of(cls, flat, counts) -> _Lists:
        return cls(np.asarray(flat, np.int32), np.asarray(counts, np.int64))

    def and_(self, more: _Lists) -> _Lists:
        return _Lists(np.concatenate([self.flat, more.flat]), np.concatenate([self.counts, more.counts]))

    def joined(self, groups: list[list[str]], place: dict[str, int]) -> _Lists:
        """For each group of names, the lists at their places put one after another."""
        sizes = np.fromiter(map(len, groups), np.int64, len(groups))
        own = np.fromiter(map(place.__getitem__, chain.from_iterable(groups)), np.int64, int(sizes.sum()))
        counts = self.counts[own]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.starts[own] - (ends - counts), counts)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return _Lists(flat, np.diff(bounds))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """A worker reads each file once."""
    return Vocabulary(path)


def _with(df: DataFrame, added: dict[str, str], made) -> DataFrame:
    """``df`` with columns that ``made`` fills from each batch; columns of the same names, in whatever case, are replaced."""
    taken = {name.lower() for name in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in made(batch):
                own = batch[rows]
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), *values], [*names, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return mapped(df, run, ", ".join([*fields, *(f"`{n}` {k}" for n, k in added.items())]))


def coded(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of its texts, and if asked for, the texts that these decode to."""

    def made_of(batch):
        own = vocabulary(path)
        for block in blocks(batch.column(text)):
            lists = own.encode([block.text(i).decode() for i in range(block.n)])
            made = listed(lists.flat, lists.counts, pa.int32())
            yield block.rows, [made, own.decode(made)] if decoded else [made]

    return _with(df, {ids: "array<int>"} | ({decoded: "string"} if decoded else {}), made_of)


def encoded(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    return coded(df, path, text, ids)


def decoded(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts of its ids."""

    def made(batch):
        own = vocabulary(path)
        lists = batch.column(ids).cast(pa.list_(pa.int32()))
        yield slice(0, len(batch)), [pc.fill_null(own.decode(lists), "")]

    return _with(df, {text: "string"}, made)
