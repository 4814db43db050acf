import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from made_texts import prose, words_of

from srcatlas.llm import neardup
from srcatlas.llm.components import components
from srcatlas.llm.words import U, blocks, mixed

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Set size and component by comparing every pair."""
    sets = collections.defaultdict(list)
    for i, text in rows:
        w = words_of((text or "").translate(LOWER))
        sets[i].append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = {i: i for i in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (sorted(map(len, s)), None if i is None else root(i)) for i, s in sets.items()}


def result(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    return {i: (sorted(r.n_shingles for r in rs), rs[0].component_id) for i, rs in out.items()}


def test_like_brute_force_on_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(neardup.near_duplicates(documents)) == brute(rows)


def test_chain_links_through_the_middle(table):
    # neighbours are alike, the ends are not, and the smallest is like one of them only
    base = prose(200).split()
    rows = []
    for step in range(12):
        words = list(base)
        for j in range(step):
            words[5 + 16 * j] = f"changed{j}"
        rows.append((100 - 7 * step if step else 3, " ".join(words)))
    rows += [(i, prose(60, i)) for i in range(200, 210)]
    assert result(neardup.near_duplicates(table(rows))) == brute(rows)


def test_odd_rows(table):
    rows = [
        (None, "a b c d e f"),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "One two"),
        (2, "one TWO"),
        (8, "é É"),
        (9, "é é"),
        (10, prose(30_000)),
        (11, prose(30_000) + " end"),
        (12, prose(40)),
        (12, prose(40)),
        (13, prose(40, 5)),
        (13, prose(40, 6)),
        (14, prose(40, 6)),
    ]
    assert result(neardup.near_duplicates(table(rows))) == brute(rows)


def test_empty_table(table):
    assert neardup.near_duplicates(table([])).collect() == []
    assert neardup.keep_first(table([])).collect() == []


def test_kept_rows_have_all_columns(spark):
    schema = "doc_id long, text string, digest string, band int, a int, kept string"
    rows = [(3, prose(50), "x", 1, 2, "k"), (1, prose(50), "y", 3, 4, "l"), (None, prose(50), "z", 5, 6, "m")]
    kept = neardup.keep_first(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "digest", "band", "a", "kept"]
    # a null doc_id takes no part in links, so its row stays
    assert sorted(r.digest for r in kept.collect()) == ["y", "z"]


def test_signature_is_that_of_one_element_after_another():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(U)) for n in (1, 2, 40, 700, 0)]
    got = neardup.superminhash(np.concatenate(sets), np.array([len(s) for s in sets]), 16)
    for row, own in zip(got, sets, strict=True):
        want = [(1 << 64) - 1] * 16
        for element in own:
            place = list(range(16))
            for rank in range(16):
                drawn = int(mixed(np.array([element]) + U((rank + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[0])
                k = rank + ((drawn & 0xFFFF) * (16 - rank) >> 16)
                place[rank], place[k] = place[k], place[rank]
                want[place[rank]] = min(want[place[rank]], rank << 56 | (drawn >> 16) << 8)
        assert [int(x) for x in row] == want


@pytest.mark.parametrize("like", [0.3, 0.75])
def test_signatures_estimate_likeness(like):
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 1 << 60, 1000).astype(U)
        both, rest = pool[: int(1000 * like)], pool[int(1000 * like) :]
        a, b = np.concatenate([both, rest[::2]]), np.concatenate([both, rest[1::2]])
        rows = neardup.superminhash(np.concatenate([a, b]), np.array([len(a), len(b)]))
        errors.append((rows[0] == rows[1]).mean() - like)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 1.2 * (like * (1 - like) / neardup.M) ** 0.5


def test_components_of_random_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    up = {i: i for pair in links for i in pair if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.up for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: root(i) for i in up if root(i) != i}


def test_shingles_of_short_and_long_texts():
    (block,) = blocks(pa.array(["a b", "a b c d e", "a b c d e f a b c d e", "", None]))
    assert list(neardup.shingle_sets(block)[1]) == [1, 1, 6, 0, 0]


def _cut(table, rows):
    """The part of each text, all texts in one cluster and each in a component of its own."""
    docs = table(rows)
    ids = docs.select("doc_id").distinct()
    members = ids.selectExpr("0L as cluster", "doc_id", "doc_id as component")
    found = neardup.cut_clusters(members, neardup.shingles_of(docs, ids)).collect()
    assert len(found) == len({i for i, _ in rows})
    return {r.doc_id: r.cluster for r in found}


def test_texts_with_a_common_passage_alone_part(table):
    """Half of each text is the same; only those that are alike in the rest stay together."""
    common = prose(100)
    rows = [(i, f"{common} {prose(100, i + 1)}") for i in range(300)]
    rows += [(300 + i, f"{common} {prose(95, i + 1)} other words at the end") for i in range(20)]
    rows += [(5, rows[5][1]), (6, f"{common} {prose(100, 900)}"), (400, f"{common} {prose(100, 900)} more")]
    assert _cut(table, rows) == {i: i - 300 if 300 <= i < 320 else 6 if i == 400 else i for i, _ in rows}
    assert result(neardup.near_duplicates(table(rows[:60] + rows[300:]))) == brute(rows[:60] + rows[300:])


@pytest.mark.parametrize("seed", range(2))
def test_linked_texts_stay_in_one_part(table, seed):
    """Sentences from a small pool: hardly a shingle is in one text alone."""
    draw = random.Random(seed)
    pool = [prose(12, 50 + i) for i in range(30)]
    rows = []
    for i in range(0, 120, 2):
        own = [draw.choice(pool) for _ in range(16)]
        rows.append((i, " ".join(own)))
        own[draw.randrange(16)] = draw.choice(pool)
        rows.append((i + 1, " ".join(own)))
    parts, want = _cut(table, rows), brute(rows)
    assert all(parts[i] == parts[root] for i, (_, root) in want.items())
    assert result(neardup.near_duplicates(table(rows))) == want
    assert sum(i != root for i, (_, root) in want.items()) > 20
