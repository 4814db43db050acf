import zlib

import numpy as np
import pytest
from made_texts import prose

from srcatlas.llm import shards as H


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 4097])
def test_every_number_is_taken_once_and_goes_back(n):
    places = H.permuted(np.arange(n), n)
    assert sorted(places) == list(range(n))
    assert (H.permuted(places, n, back=True) == np.arange(n)).all()


def test_large_tables_stay_in_range():
    n = 3 * 10**11
    rows = np.array([0, 1, n // 2, n - 1])
    places = H.permuted(rows, n)
    assert ((places >= 0) & (places < n)).all() and (H.permuted(places, n, back=True) == rows).all()


def check(rows, got):
    n = len(rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    assert sorted(r.row_number for r in got) == list(range(n))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)
    in_order = sorted(got, key=lambda r: r.row_number)
    assert [key(r) for r in in_order] == sorted(map(key, got))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert H.row_number(r.shard, r.slot, n) == r.row_number
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(H.SHARDS)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == n


def test_documents(documents):
    check([(r.doc_id, r.text) for r in documents.collect()], H.sharded(documents).collect())


def test_odd_rows(table):
    rows = [(None, "a"), (None, "a"), (None, None), (3, ""), (2, prose(20_000)), (2, "é"), (2, "é"), (-5, " ")]
    check(rows, H.sharded(table(rows)).collect())
    assert H.sharded(table([])).collect() == []
    again = H.sharded(table(rows[::-1])).collect()
    assert sorted(H.sharded(table(rows)).collect(), key=repr) == sorted(again, key=repr)
