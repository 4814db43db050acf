"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters and digits (ASCII lower-cased) and of bytes from 0x80 on. Labels are known by document only, so
tokens are labelled first: in a toxic document a token is toxic if one of its forms (the token, or its first ``PREFIXES``
bytes) is found in at least ``SUPPORT`` of the toxic texts of the sample and ``RATIO`` times as often there as in the others.
The field has two states and hashed features: the token, its prefixes and its suffixes. It is trained by gradient
steps on the likelihood of those labels; forward-backward gives each token's marginal. A logistic model, fitted on
another part of the sample, turns sums and maxima of marginals into a score.

The sample is bounded: at most ``TOXIC`` toxic and ``CLEAN`` other documents of up to ``LONGEST`` bytes, chosen by a hash of
their ids, and of their texts, each once, as many as have ``BYTES`` together, by a hash of the text. A text with both labels
is toxic. Training takes about 70 bytes of the driver's memory for each byte of text. Scoring reads every text whole: a text's chain is cut into pieces whose 2 x 2 products are combined, which is exact.

Defined results: a null or empty text has no tokens, and the score that the logistic model gives to none. A null
``doc_id`` is scored like any other. Each input row gives one row. Without labelled documents of both kinds
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.storage import stored
from srcatlas.llm.sample import MARGIN, smallest
from srcatlas.llm.words import LOWER, Texts, U, blocks, mapped, mixed

TOXIC = 1200
CLEAN = 2400
LONGEST = 32_000
BYTES = 8_000_000
SUPPORT = 0.01
RATIO = 12.0
PREFIXES = (4, 5, 6, 7)
SUFFIXES = (4, 6)
TABLE = 1 << 19
PIECE = 64
STEPS = 40
RATE = 0.4
DECAY = 1e-4
SEED = 7

_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Tokens:
    """The tokens of a block of texts and the places of their features in the weight table."""

    def __init__(self, block: Texts):
        words = block.words(lower=True, gaps=_GAPS)
        self.start, self.end, self.doc, self.count, self.first = words.start, words.end, words.doc, words.count, words.first
        data, size = LOWER[block.data], words.end - words.start
        self.forms = [mixed(words.hash + U(1))]
        for sign, lengths in ((1, PREFIXES), (-1, SUFFIXES)):
            value = np.zeros(len(size), U)
            for k in range(max(lengths)):
                own = np.flatnonzero(size > k)
                at = words.start[own] + k if sign == 1 else words.end[own] - 1 - k
                value[own] = mixed(value[own] * U(31) + data[at] + U(257 * (sign + 2)))
                if k + 1 in lengths:
                    self.forms.append(np.where(size > k, mixed(value + U(k + 11)), U(0)))

    def __len__(self) -> int:
        return len(self.start)

    def places(self) -> np.ndarray:
        """A row of places for each form; the last one is the bias."""
        kinds = [(f & U(TABLE - 1)).astype(np.int32) for f in self.forms]
        return np.stack([*kinds, np.full(len(self), TABLE, np.int32)])


class Chains:
    """Forward-backward over all texts of a block at once, in pieces of ``PIECE`` tokens."""

    def __init__(self, count: np.ndarray):
        self.pieces = -(-count // PIECE)
        self.first_piece = np.cumsum(self.pieces) - self.pieces
        n = int(self.pieces.sum())
        doc = np.repeat(np.arange(len(count)), count)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        self.piece = self.first_piece[doc] + pos // PIECE
        self.at = pos % PIECE
        self.n, self.starts = n, pos == 0
        self.live = np.zeros((PIECE, n), bool)
        self.live[self.at, self.piece] = True

    def run(self, odds: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the marginal of state 1; the expected moves between neighbours, 2 x 2.

        ``odds``: log weight of state 1 against 0; ``move``: log weights of moves.
        """
        weight = np.ones((PIECE, self.n))
        weight[self.at, self.piece] = np.exp(np.clip(odds, -30, 30))
        step = np.exp(move)
        whole = self._products(weight, step)
        enter = self._enter(whole)
        leave = self._leave(whole)
        a = np.empty((PIECE, self.n, 2))
        now = enter
        for t in range(PIECE):
            go = np.stack([now @ step[:, 0], (now @ step[:, 1]) * weight[t]], axis=1)
            go /= go.sum(axis=1, keepdims=True)
            now = np.where(self.live[t][:, None], go, now)
            a[t] = now
        b = np.empty((PIECE, self.n, 2))
        now = leave
        for t in range(PIECE - 1, -1, -1):
            b[t] = now
            seen = np.stack([now[:, 0], now[:, 1] * weight[t]], axis=1) @ step.T
            seen /= seen.sum(axis=1, keepdims=True)
            now = np.where(self.live[t][:, None], seen, now)
        alpha, beta = a[self.at, self.piece], b[self.at, self.piece]
        both = alpha * beta
        marginal = both[:, 1] / both.sum(axis=1)
        later = np.flatnonzero(~self.starts)
        own = weight[self.at, self.piece][later]
        to = np.stack([beta[later, 0], beta[later, 1] * own], axis=1)
        pair = alpha[later - 1][:, :, None] * step[None] * to[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        return marginal, pair.sum(axis=0)

    def _products(self, weight: np.ndarray, step: np.ndarray) -> np.ndarray:
        out = np.tile(np.eye(2), (self.n, 1, 1))
        for t in range(PIECE):
            go = out @ step
            go[:, :, 1] *= weight[t][:, None]
            go /= go.sum(axis=(1, 2), keepdims=True)
            out = np.where(self.live[t][:, None, None], go, out)
        return out

    def _enter(self, whole: np.ndarray) -> np.ndarray:
        out = np.full((self.n, 2), 0.5)
        for k in range(1, int(self.pieces.max(initial=0))):
            own = self.first_piece[self.pieces > k] + k
            now = np.einsum("ni,nij->nj", out[own - 1], whole[own - 1])
            out[own] = now / now.sum(axis=1, keepdims=True)
        return out

    def _leave(self, whole: np.ndarray) -> np.ndarray:
        out = np.full((self.n, 2), 0.5)
        for k in range(int(self.pieces.max(initial=0)) - 2, -1, -1):
            own = self.first_piece[self.pieces > k + 1] + k
            now = np.einsum("nij,nj->ni", whole[own + 1], out[own + 1])
            out[own] = now / now.sum(axis=1, keepdims=True)
        return out


class Model:
    """Weights of the field, and of the logistic model on its marginals."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, final: np.ndarray):
        self.weights, self.move, self.final = weights, move, final

    def marginals(self, tokens: Tokens) -> np.ndarray:
        if not len(tokens):
            return np.zeros(0)
        return Chains(tokens.count).run(self.weights[tokens.places()].sum(axis=0), self.move)[0]

    def scores(self, tokens: Tokens, marginal: np.ndarray) -> np.ndarray:
        return _logistic(_summary(tokens, marginal) @ self.final)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summary(tokens: Tokens, marginal: np.ndarray) -> np.ndarray:
    n = len(tokens.count)
    total = np.bincount(tokens.doc, weights=marginal, minlength=n)
    sure = np.bincount(tokens.doc, weights=marginal > 0.5, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, tokens.doc, marginal)
    share = np.log((total + 0.05) / (tokens.count + 10))
    return np.stack([np.ones(n), np.log1p(total), most, share, np.log1p(sure)], axis=1)


def _block(texts: list[str]) -> Texts:
    (made,) = blocks(pa.array(texts, pa.large_string()), 1 << 62)
    return made


def token_labels(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts with a form that is typical of these."""
    out = np.zeros(len(tokens), bool)
    n_toxic, n_other = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    for form in tokens.forms[: 1 + len(PREFIXES)]:
        value, place = np.unique(form, return_inverse=True)
        seen = np.unique(place.astype(np.int64) * len(toxic) + tokens.doc)
        which, doc = seen // len(toxic), seen % len(toxic)
        inside = np.bincount(which, weights=toxic[doc], minlength=len(value))
        outside = np.bincount(which, weights=~toxic[doc], minlength=len(value))
        typical = (inside >= max(3, SUPPORT * n_toxic)) & ((inside / n_toxic) >= RATIO * (outside + 0.5) / n_other)
        out |= (typical & (value != 0))[place]
    return out & toxic[tokens.doc]


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """From whole texts and their labels; both kinds must be there."""
    for_field = np.arange(len(texts)) % 3 != 2
    tokens = Tokens(_block([t for t, own in zip(texts, for_field, strict=True) if own]))
    y = token_labels(tokens, toxic[for_field])
    places, chains = tokens.places(), Chains(tokens.count)
    weights, move = np.zeros(TABLE + 1), np.zeros((2, 2))
    weights[-1] = -3.0
    # weights that no token of the sample has stay 0
    used, small = np.unique(places, return_inverse=True)
    small = small.reshape(places.shape)
    own, seen = weights[used], np.full(len(used), 1e-6)
    seen_move = np.full((2, 2), 1e-6)
    later = np.flatnonzero(~chains.starts)
    moves = np.zeros((2, 2))
    np.add.at(moves, (y[later - 1].astype(int), y[later].astype(int)), 1)
    for _ in range(STEPS):
        marginal, pairs = chains.run(own[small].sum(axis=0), move)
        error = y - marginal
        slope = sum(np.bincount(row, weights=error, minlength=len(used)) for row in small) - DECAY * own
        seen += slope**2
        own = own + RATE * slope / np.sqrt(seen)
        slope_move = moves - pairs
        seen_move += slope_move**2
        move = move + 0.5 * RATE * slope_move / np.sqrt(seen_move)
    weights[used] = own
    field = Model(weights.astype(np.float32), move, np.zeros(5))
    rest = Tokens(_block([t for t, own in zip(texts, for_field, strict=True) if not own]))
    field.final = _fit_logistic(_summary(rest, field.marginals(rest)), toxic[~for_field])
    return field


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps, with a slight pull to 0."""
    out = np.zeros(x.shape[1])
    pull = 0.05 * np.eye(x.shape[1])
    for _ in range(25):
        p = _logistic(x @ out)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull
        out = out + np.linalg.solve(curve, x.T @ (y - p) - pull @ out)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels to learn from, each text once; bounded by ``TOXIC``, ``CLEAN`` and ``LONGEST``."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    some = [smallest(known.filter(F.col("toxic") == k), order, n, ["doc_id"]) for k, n in ((1, TOXIC), (0, CLEAN))]
    # at most TOXIC + CLEAN ids
    wanted = F.broadcast(some[0].union(some[1]))
    rows = documents.select("doc_id", "text").filter(F.octet_length("text") <= LONGEST).join(wanted, "doc_id")
    rows = stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    # ids may have many texts: about as many pass as are wanted
    order = F.xxhash64("text", F.lit(SEED))
    bound = min((1 << 63) - 1, int(MARGIN * BYTES / max(size, 1) * (1 << 64)) - (1 << 63))
    passed = rows.filter(order <= bound).withColumn("_order", order).collect()
    found, total = {}, 0
    for r in sorted(passed, key=lambda r: (r["_order"], r["text"])):
        total += len(r["text"].encode())
        if total > BYTES:
            break
        found[r["text"]] = r["toxic"]
    texts = sorted(found, key=lambda t: hash_of(t))
    return texts, np.array([found[t] == 1 for t in texts], bool)


def hash_of(text: str) -> int:
    return int(mixed(np.array([len(text), *text.encode()[:64]], U).cumsum())[-1])


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, spans`` of each row; spans are merged runs of toxic tokens, in code points, with their largest marginal."""
    texts, toxic = sample(documents, labels)
    kind = documents.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:long,end:long,score:double>>"
    if not toxic.any() or toxic.all():
        return documents.select("doc_id", F.lit(0.5).alias("score"), F.expr(f"cast(array() as {spans})").alias("spans"))
    model = train(texts, toxic)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                tokens = Tokens(block)
                marginal = model.marginals(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[block.rows],
                        pa.array(model.scores(tokens, marginal)),
                        _spans(block, tokens, marginal),
                    ],
                    ["doc_id", "score", "spans"],
                )

    return mapped(documents.select("doc_id", "text"), made, f"doc_id {kind}, score double, spans {spans}")


def _spans(block: Texts, tokens: Tokens, marginal: np.ndarray) -> pa.Array:
    hit = np.flatnonzero(marginal >= 0.5)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (tokens.doc[hit[1:]] != tokens.doc[hit[:-1]])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(hit))[: len(begin)] - 1
    doc = tokens.doc[hit[begin]]
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    base = points[block.offsets[:-1]][doc]
    start = points[tokens.start[hit[begin]]] - base
    end = points[tokens.end[hit[last]]] - base
    most = np.maximum.reduceat(marginal[hit], begin) if len(hit) else np.zeros(0)
    rows = pa.StructArray.from_arrays([pa.array(start), pa.array(end), pa.array(most)], ["start", "end", "score"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), rows)
