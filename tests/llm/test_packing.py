import random
from collections import Counter

import pytest

from pathweave.llm.packing import pack, pack_histogram


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_histogram(capacity):
    random.seed(capacity)
    h = Counter(min(capacity, max(1, int(random.lognormvariate(4, 1)))) for _ in range(5000))
    used, packs = Counter(), 0
    for n, lengths in pack_histogram(dict(h), capacity):
        assert n > 0 and sum(lengths) <= capacity
        packs += n
        for x in lengths:
            used[x] += n
    assert used == h
    assert packs <= 1.02 * -(-sum(k * v for k, v in h.items()) // capacity) + 1 or capacity <= 64


def test_pack(spark):
    random.seed(1)
    rows = [(i, random.choice([None, 0, 1, 5, 5, 5, 30, 64, 65, 200]), 0, 0) for i in range(500)] + [(7, 5, 0, 0)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int, piece int, container int"), 64, bucket_texts=5).collect()
    fill = Counter()
    for r in got:
        fill[r.container] += r.n_tokens
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    per = Counter()
    for r in got:
        per[r.doc_id] += r.n_tokens
    want = Counter()
    for d, n, *_ in rows:
        want[d] += n or 0
    assert per == +want
    assert all(r.first_token == r.piece * 64 for r in got) and all(r.piece == 0 for r in got if dict((x[0], x[1]) for x in rows if x[0] == r.doc_id)[r.doc_id] <= 64)
    assert all(fill[r.container] == 64 for r in got if r.n_tokens == 64)


def test_empty(spark):
    schema = "doc_id bigint, n_tokens int"
    assert pack(spark.createDataFrame([], schema), 64).count() == 0
    assert pack(spark.createDataFrame([(1, 0), (2, None)], schema), 64).count() == 0
