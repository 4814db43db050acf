import numpy as np
from made_texts import prose, words_of

from srcatlas.llm import quality as Q


def brute(text):
    text = text or ""
    w = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {p + k for ps in places.values() if len(ps) > 1 for p in ps for k in range(3)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), failed


def test_counts_like_brute_force(documents, labels):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in Q.judge(documents, labels).collect():
        assert tuple(r[n] for n in (*Q.COUNTS, "base_failed")) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_verdicts_follow_labels(spark):
    # held to all labelled rows of a larger table
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = Q.judge(spark.read.parquet(f"{d}/documents.parquet"), labels).filter("not base_failed").join(labels, "doc_id")
    kept = {(r["quality"], r["kept"]): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) <= 0.01 * kept[1, True]
    assert kept.get((0, True), 0) <= 0.1 * kept[0, False]


def test_odd_rows(table, labels):
    rows = [(None, prose(60)), (1, None), (2, ""), (3, "a\n\na\n a\n"), (4, prose(60)), (4, prose(60)), (5, "a b c a b c a"), (6, prose(30_000)), (7, "x" * 200_000), (8, "é <b> #")]
    got = Q.judge(table(rows), labels).collect()
    want = sorted([(i, *brute(t)) for i, t in rows], key=repr)
    assert sorted([tuple(r[n] for n in ("doc_id", *Q.COUNTS, "base_failed")) for r in got], key=repr) == want
    assert Q.judge(table([]), labels).collect() == []
    assert Q.keep(table([]), labels).collect() == []


def test_without_labels_only_the_base_rules_reject(table, labels):
    rows = [(i, prose(60, i)) for i in range(5)] + [(9, "few words")]
    got = {r.doc_id: r.kept for r in Q.judge(table(rows), labels.limit(0)).collect()}
    assert got == {**dict.fromkeys(range(5), True), 9: False}


def test_keep_is_judge_with_all_columns(spark, documents, labels):
    kept = {r.doc_id for r in Q.judge(documents, labels).filter("kept").collect()}
    more = documents.selectExpr("*", "doc_id as score", "text as symbols", "1 as kept")
    got = Q.keep(more, labels)
    assert got.columns == more.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)


def test_isolated_rows_score_higher():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(size=(500, 3)), [[8.0, 8.0, 8.0]]])
    scores = Q.Forest(rows, 64, 128).score(rows)
    assert scores.argmax() == 500 and np.median(scores) < 0.5 < scores[500]
    assert len(Q.Forest(np.zeros((1, 3))).score(np.zeros((2, 3)))) == 2
