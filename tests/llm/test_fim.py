import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from made_texts import prose

from srcatlas.llm import fim as M
from srcatlas.llm.words import blocks


def numbers(doc_id):
    made = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(made[8 * k : 8 * k + 8], 16) for k in range(4)]


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(tokens), numbers(doc_id)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text("ab<>PSM é\n日z1😀"), min_size=1), st.sampled_from([1, 40, 1 << 20]))
def test_tables_cut_arrange_and_restore(texts, most):
    for block in blocks(pa.array(texts, pa.string()), most):
        own = range(block.rows.start, block.rows.stop)
        table, n, form, _ = M.cut_block(block, np.array([numbers(i) for i in own]))
        outputs = [table.text(j).decode() for j in range(block.n)]
        assert [(n[j], M.FORMS[form[j]], outputs[j]) for j in range(block.n)] == [(w[0], w[1], w[4]) for w in (brute(i, texts[i]) for i in own)]
        (again,) = blocks(pa.array(outputs, pa.string()), 1 << 60)
        back, good = M.restored_block(again, form)
        assert good.all() and [back.text(j).decode() for j in range(block.n)] == [texts[i] or "" for i in own]


def test_documents_and_odd_rows(table, documents):
    odd = [(None, "a b"), (None, None), (1, ""), (2, None), (3, "x <M> y"), (4, prose(30_000)), (4, prose(30_000)), (5, "<" * 9), (6, "\n" * 7), (7, "y" * 200_000)]
    odd += [(i, f"één {i} <P") for i in range(100, 140)]
    for rows in (table(odd).selectExpr("*", "1 as n", "text as output", "'x' as `a.b`"), documents):
        want = {}
        for r in rows.collect():
            n, form, before, middle, output = brute(r.doc_id, r.text)
            digest = hashlib.sha256(output.encode()).hexdigest()
            want.setdefault((r.doc_id, n, form, before, middle, output, digest, r.text or ""), []).append(1)
        got = {}
        for r in M.restored(M.arranged(rows)).collect():
            assert r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
            got.setdefault((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored), []).append(1)
        assert got == want
    assert M.restored(M.arranged(table([]))).collect() == []
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_damaged_outputs_are_restored_as_null(spark):
    rows = [("<P>a<S>c<M>b", "psm", "abc"), ("<S>c<P>a<M>b", "spm", "abc"), ("<S>c<P>a<M>b", "psm", None), ("<P>a<S>c", "psm", None), ("x<P>a<S>c<M>b", "psm", None), ("<P>a<S>c<M>b<M>", "psm", None), (None, "psm", None), ("a", None, None), ("a", "other", None), ("<P>", "plain", "<P>"), ("<P><S><M>", "psm", "")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, output string, form string, want string")
    for r in M.restored(frame).collect():
        assert r.restored == r.want and (r.restored_sha256 is None) == (r.want is None), r
