"""Quality rules: text statistics, two fixed rules, and an isolation forest on the statistics.

The forest (Liu, Ting, Zhou 2008) is fitted on bounded samples: ``TREES`` trees of ``SAMPLE`` rows each.
Short mean path lengths mark anomalous rows. The threshold comes from all labelled rows: their scores
are counted in ``BINS`` bins by label; of the thresholds that keep at least ``KEEP`` of the good rows,
those that reject most of the others count, and the middle one is taken.

Defined results: a null text counts as empty; a text without words fails the base rules. A null ``doc_id``
stays null and is unlabelled. Repeated rows are judged alike, each one. Without labelled rows of both
kinds the threshold is 1, which rejects nothing beyond the base rules. An empty table gives no rows.
Other columns of the input are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.storage import stored
from srcatlas.llm.sample import smallest
from srcatlas.llm.words import Texts, blocks, mapped, per_text

TREES = 128
SAMPLE = 64
BINS = 1000
KEEP = 0.999
SEED = 20240131
LEAST_WORDS = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest reads, and the step to which each is rounded down: smaller differences say nothing.
FEATURES = {
    "word_length": 2.0,
    "symbols": 0.05,
    "dup_lines": 0.25,
    "repeats": 0.25,
    "upper": 0.1,
    "marks": 0.1,
    "lone_marks": 0.1,
}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?\"'()[]{}:;=+/\\@^_~`-")] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(block, words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    out = np.zeros(block.n, np.int64)
    for i in np.flatnonzero(words.count):
        text = block.text(i)
        if b"\n" not in text:
            continue
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                out[i] += 1
            elif line.strip(b" \t\n\x0b\x0c\r"):
                seen.add(line)
    return out


def _repeat_words(words, n: int) -> np.ndarray:
    """Words inside a window of three words that its text has at least twice."""
    at, made = words.windows(3)
    own = made + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.doc), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return per_text(covered, words.doc, n)


def block_statistics(block: Texts) -> dict[str, np.ndarray]:
    """The counts by text, and the shares that the forest reads."""
    words = block.words()
    data, offsets = block.data, block.offsets
    letters = _sums((data & 0xC0) != 0x80, offsets)
    gaps = _sums((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)), offsets)
    lines = _sums(data == 0x0A, offsets) + 1
    alone = (words.end - words.start == 1) & ~_ALNUM[data[words.start]]
    out = {
        "n_words": words.count.astype(np.int64),
        "word_chars": letters - gaps,
        "n_symbols": _sums(_SYMBOLS[data], offsets),
        "n_dup_lines": _dup_lines(block, words),
        "n_repeat_words": _repeat_words(words, block.n),
    }
    chars, n_words = np.maximum(out["word_chars"], 1), np.maximum(out["n_words"], 1)
    shares = {
        "word_length": out["word_chars"] / n_words,
        "symbols": out["n_symbols"] / chars,
        "dup_lines": out["n_dup_lines"] / lines,
        "repeats": out["n_repeat_words"] / n_words,
        "upper": _sums(_UPPER[data], offsets) / chars,
        "marks": _sums(_MARKS[data], offsets) / chars,
        "lone_marks": per_text(alone, words.doc, block.n) / n_words,
    }
    return out | {name: np.floor(shares[name] / step) for name, step in FEATURES.items()}


class Forest:
    """Isolation trees as arrays: node ``i`` of tree ``t`` has its children at ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(sample, 2))))
        n_nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, n_nodes), -1, np.int16)
        self.split = np.zeros((trees, n_nodes))
        self.length = np.zeros((trees, n_nodes))
        self.norm = float(_mean_path(np.array([sample]))[0]) or 1.0
        for t in range(trees):
            self._grow(t, 0, 0, rows[rng.choice(len(rows), sample, replace=False)], rng)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng: np.random.Generator) -> None:
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(open_):
            self.length[t, node] = depth + float(_mean_path(np.array([len(rows)]))[0])
            return
        feature = int(rng.choice(open_))
        split = float(rng.uniform(low[feature], high[feature]))
        left = rows[:, feature] <= split
        self.feature[t, node], self.split[t, node] = feature, split
        self._grow(t, 2 * node + 1, depth + 1, rows[left], rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[~left], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher: isolated by fewer splits."""
        total = np.zeros(len(rows))
        at_rows = np.arange(len(rows))
        for feature, split, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                own = feature[node]
                inner = own >= 0
                right = rows[at_rows, np.maximum(own, 0)] > split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return np.exp2(-total / len(self.feature) / self.norm)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """The mean path length of a failed search in a binary search tree of ``n`` rows."""
    n = n.astype(float)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def statistics(df: DataFrame) -> DataFrame:
    """``doc_id``, the counts and what the forest reads, for each row of ``(doc_id, text)``."""
    kinds = {name: pa.int64() for name in COUNTS} | {name: pa.float64() for name in FEATURES}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                values = block_statistics(block)
                own = [pa.array(values[name], kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[block.rows], *own], ["doc_id", *kinds]
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(
        [*(f"{name} long" for name in COUNTS), *(f"{name} double" for name in FEATURES)]
    )
    return mapped(df.select("doc_id", "text"), made, schema)


def base_failed(n_words, n_repeat_words):
    """The fixed rules, on columns or on arrays: too few words, or more than half of them in repeats."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > 50 * n_words)


def fit(stats: DataFrame) -> Forest | None:
    """A forest from at most ``TREES * SAMPLE`` rows, taken by the order of a hash, equal ones once; None without rows."""
    known = stats.select("doc_id", *FEATURES)
    order = F.xxhash64(*known.columns, F.lit(SEED))
    chosen = smallest(known, order, TREES * SAMPLE, known.columns).select(*FEATURES)
    rows = np.array([tuple(r) for r in chosen.collect()], float)
    return Forest(rows) if len(rows) else None


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with the anomaly ``score``."""
    names = list(FEATURES)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            score = pa.array(forest.score(x) if len(x) else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields]
    return mapped(stats, made, ", ".join([*fields, "score double"]))


def threshold(scores: DataFrame, labels: DataFrame) -> float:
    """The score above which rows are rejected; from all labelled rows that the base rules pass."""
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality in (0, 1)")
    passed = scores.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    bins = F.floor(F.col("score") * BINS).cast("int").alias("bin")
    counted = passed.join(known, "doc_id").groupBy(bins, "quality").count().collect()
    count = np.zeros((2, BINS + 1))
    for row in counted:
        count[row["quality"], row["bin"]] += row["count"]
    if not count.sum(axis=1).all():
        return 1.0
    above = count.sum(axis=1, keepdims=True) - np.cumsum(count, axis=1)
    allowed = np.flatnonzero(above[1] <= (1 - KEEP) * count[1].sum())
    best = allowed[above[0][allowed] == above[0][allowed].max()]
    return (int(best[len(best) // 2]) + 1) / BINS


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row of ``documents``: its counts, ``base_failed``, the anomaly ``score`` and ``kept``."""
    stats = stored(statistics(documents), "quality")
    forest = fit(stats)
    if forest is None:
        scores, limit = stats.withColumn("score", F.lit(0.0)), 1.0
    else:
        scores = scored(stats, forest)
        limit = threshold(scores, labels)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return scores.select(
        "doc_id",
        *COUNTS,
        failed.alias("base_failed"),
        "score",
        (~failed & (F.col("score") <= limit)).alias("kept"),
    )


def keep(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, with all their columns.

    The statistics are made a second time where the rows lie, so that no text is moved.
    """
    stats = stored(statistics(documents), "quality")
    forest = fit(stats)
    limit = 1.0 if forest is None else threshold(scored(stats, forest), labels)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                values = block_statistics(block)
                score = forest.score(np.column_stack([values[n] for n in FEATURES]))
                good = ~base_failed(values["n_words"], values["n_repeat_words"]) & (score <= limit)
                yield batch[block.rows].filter(pa.array(good))

    return documents if forest is None else mapped(documents, made, documents.schema)
