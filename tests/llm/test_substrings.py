import hashlib

from made_texts import prose, words_of

from srcatlas.llm import substrings as S


def brute(rows):
    """Per row: words, removed words and the digest of the rest."""
    starts = {}
    for i, text in rows:
        if i is not None:
            w = words_of(text)
            for j in range(len(w) - 49):
                key = tuple(w[j : j + 50])
                starts[key] = min(i, starts.get(key, i))
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = set()
        for j in range(len(w) - 49) if i is not None else ():
            if starts[tuple(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.dedup_digests(df).collect()), key=repr)


def test_cover_reaches_every_pair_of_places():
    for i in range(S.PERIOD):
        for j in range(S.PERIOD):
            assert any((i + d) % S.PERIOD in S.COVER and (j + d) % S.PERIOD in S.COVER for d in range(S.PERIOD))


def test_like_brute_force_on_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute(rows)
    assert sum(n for _, _, n, _ in want) > 1000
    assert result(documents) == want


def test_passages_at_every_shift(table):
    passage = prose(53, 3)
    rows = [(0, f"{prose(7, 1)} {passage} {prose(60, 2)}")]
    rows += [(i, f"{prose(i, 10 + i)} {passage} {prose(3, 90 + i)}") for i in range(1, 40)]
    rows += [(100, " ".join(passage.split()[:49])), (101, " ".join(passage.split()[:50]) + " x"), (102, passage.upper())]
    assert result(table(rows)) == brute(rows)


def test_odd_rows(table):
    rows = [
        (None, prose(80)),
        (5, None),
        (6, ""),
        (7, " \n "),
        (8, prose(80)),
        (8, prose(80)),
        (9, prose(80)),
        (9, prose(30) + " x " + prose(80)),
        (10, prose(49)),
        (11, prose(49)),
        (12, prose(120) + " " + prose(120)),
        (13, prose(30_000, 4)),
        (14, "y " + prose(30_000, 4)),
        (15, prose(50)),
        (16, " ".join(["same"] * 200)),
        (17, " ".join(["same"] * 120) + " end"),
    ]
    assert result(table(rows)) == brute(rows)
    assert result(table([])) == []


def test_texts_lose_their_repeats(spark):
    schema = "doc_id long, text string, r string, d int, h int, kept string, starts int, n_chars long"
    own = prose(60)
    rows = [(1, own, "a", 1, 2, "k", 3, 9), (2, f"b  {own}\nc", "b", 4, 5, "l", 6, 9), (3, "b  c", "c", 7, 8, "m", 9, 4), (4, own, "d", 1, 1, "n", 1, 9)]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in S.dedup(df).collect()}
    assert S.dedup(df).columns == df.columns
    assert [(got[i].text, got[i].n_chars, got[i].r) for i in (1, 2, 3, 4)] == [(own, 9, "a"), ("b c", 3, "b"), ("b  c", 4, "c"), ("", 0, "d")]
