"""Ranked search against plain Python, its compression and its merge on their own."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from callgrain.llm import search
from test_operators import EDGES

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))


def plainly(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n, total = len(own), sum(len(t) for _, t in own)
    counts = [Counter(t) for _, t in own]
    df = Counter(x for c in counts for x in c)
    out = []
    for item, text in items:
        scored = []
        for (i, t), c in zip(own, counts, strict=True):
            m = 25 + (75 * len(t) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in terms(text) if x in c)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize(("shard", "pairs", "broadcast"), [(1 << 24, 1 << 16, 1 << 18), (300, 9, 0), (1, 1, 5)])
def test_same_as_plain(spark, monkeypatch, shard, pairs, broadcast):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "PAIRS", pairs)
    monkeypatch.setattr(search, "TERMS", broadcast)
    rng = random.Random(shard)
    letters = ["the", "The", "of", "é", "É", "漢字", "a1", "rare-%d", "x_y", "don't"]
    word = lambda: rng.choices(letters, [40, 10, 20, 5, 5, 3, 3, 10, 2, 2])[0].replace("%d", str(rng.randrange(40)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(rng.randrange(10**6), text(rng.choice([1, 4, 30, 200]))) for _ in range(150)]
    docs += [(5, "the rare-1"), (5, "the rare-1"), (4, "the rare-1"), (None, "the rare-1"), (None, None), (6, ""), (7, " -.- ")]
    items = [(i, text(rng.choice([1, 2, 8, 20]))) for i in range(12)] + [(3, "rare-1 the"), (99, None), (None, "of"), (98, "nowhere"), (97, "the the the")]
    found = search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, found.collect())) == Counter(plainly(docs, items))


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, "s", 1, "q", 2) for i, t in EDGES], "doc_id long, text string, term string, shard int, item string, documents int")
    items = spark.createDataFrame([(1, "x b", "t", 3)], "item_id long, text string, term string, item int")
    found = search.ranked(docs, items)
    assert Counter(map(tuple, found.collect())) == Counter(plainly(EDGES, [(1, "x b")]))
    assert search.ranked(docs.limit(0), items).count() == 0 and search.ranked(docs, items.limit(0)).count() == 0
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_varints():
    rng = np.random.default_rng(1)
    for values in ([], [0], [127, 128], rng.integers(0, 1 << rng.integers(1, 62, 500), dtype=np.int64)):
        values = np.array(values, np.uint64)
        data, starts = search.varints(values)
        assert (search.values_of(data) == values).all()
        assert len(data) == sum(max(1, -(-int(v).bit_length() // 7)) for v in values)
        assert all(v < 128 for v in data[starts[1:] - 1])


@pytest.mark.parametrize("k", [1, 3, 50])
def test_merge_keeps_the_best(k):
    rng = random.Random(k)
    for _ in range(300):
        ids = sorted(rng.randrange(100) for _ in range(30))
        lists = []
        for _ in range(rng.randint(1, 6)):
            docs = sorted(rng.sample(range(30), rng.randint(1, 30)))
            gains = [rng.choice([0, 1, 5, 5, 9]) * rng.choice([1, 10]) for _ in docs]
            times = rng.randint(1, 3)
            lists.append((times * max(gains), times, docs, gains))
        before = [(rng.randint(1, 60), -rng.randrange(100)) for _ in range(rng.randint(0, k))]
        best = list(before)
        heapq.heapify(best)
        scores = Counter()
        for _, times, docs, gains in lists:
            for d, g in zip(docs, gains, strict=True):
                scores[d] += times * g
        search.merged(list(lists), ids, k, best)
        assert sorted(best) == sorted(before + [(s, -ids[d]) for d, s in scores.items() if s > 0])[-k:]
