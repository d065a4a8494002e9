"""MinHash near duplicates against brute force; the sequential test against its own chances."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from callgrain.llm import jaccard, minhash, queries
from test_operators import EDGES, SF, words

SHAPE = "doc_id long, text string"


def brute(rows, size=3, threshold=85):
    """(n_shingles, component_id) of each row, in order; ids may be null or repeat."""
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    at, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for k in s:
            at[k].append(i)
    for own in at.values():
        for a in range(len(own)):
            for b in range(a):
                shared[own[a], own[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            up[top(a)] = top(b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[top(i)] += [doc] if doc is not None else []
    return [(doc, len(s), doc if not s else min(least[top(i)], default=None)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def counted(found):
    out = defaultdict(int)
    for r in found:
        out[tuple(r)] += 1
    return out


def with_kept(expect):
    return counted((i, n, c, i == c) for i, n, c in expect)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert counted(queries.op13_minhash_dedup(spark, SF).collect()) == with_kept(brute(rows))


@pytest.mark.parametrize(("fan", "share"), [(2, 3), (256, 1024)])
def test_near_copies_at_every_distance(spark, monkeypatch, fan, share):
    """Groups of near copies whose similarities lie about the threshold, passages in common, copies, short texts."""
    monkeypatch.setattr(jaccard, "FAN", fan)
    monkeypatch.setattr(jaccard, "SHARE", share)
    rng = random.Random(fan)
    new = lambda n: [f"v{rng.randrange(10**8)}" for _ in range(n)]
    common, rows = new(30), []
    for _ in range(40):
        body = new(rng.choice([1, 2, 3, 8, 40, 120]))
        for _ in range(rng.randint(1, 6)):
            moved = list(body)
            for _ in range(rng.randint(0, max(1, len(body) // 30))):
                moved[rng.randrange(len(moved))] = rng.choice(["odd", "Odd", f"x{rng.randrange(100)}"])
            rows.append((rng.randrange(10**6), " ".join((common if rng.random() < 0.5 else []) + moved)))
    rows += [(None, rows[0][1]), (None, "only nulls have this text"), (None, "only nulls have this text"), (5, None), (5, ""), (6, " \n ")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, SHAPE)).collect()
    expect = counted((i, n, c, i == c) for i, n, c in brute(rows))
    assert counted(found) == expect
    assert len({c for _, _, c in brute(rows)}) < len(rows) - 40


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, 1, "b", "h", 2) for i, t in EDGES], "doc_id long, text string, class int, band string, hub string, members int")
    found = minhash.near_duplicates(docs)
    assert counted(found.collect()) == with_kept(brute(EDGES))
    empty = minhash.near_duplicates(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64))
    sets = [x[:20_000], x[2_000:22_000], x[10_000:30_000], x[:1], x[:20_000]]
    s = minhash.signatures(sets)
    assert (s[0] == s[4]).all() and (s[3] != s[1]).any()
    for j in (1, 2):
        true = len(np.intersect1d(sets[0], sets[j])) / len(np.union1d(sets[0], sets[j]))
        assert abs((s[0] == s[j]).mean() - true) < 0.15
    # over many pairs, agreements have the mean and the spread of independent draws
    agreed = []
    for k in range(300):
        a = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        one, two = minhash.signatures([a[:85], a[15:]])
        agreed.append((one == two).sum())
    n = minhash.BANDS * minhash.ROWS
    assert abs(np.mean(agreed) - 0.7 * n) < 1.5 and 0.8 < np.std(agreed) / math.sqrt(n * 0.7 * 0.3) < 1.25


def test_pruning_keeps_to_its_chance():
    """A pair right at the threshold is pruned a few times as often as the posterior's bound says, a nearer one less often; unlike pairs soon go."""
    for miss in (1e-7, 1e-3):
        for n in (28, 56, 140):
            least = minhash.least_agreements(n, 85, miss)
            lost, nearer = (sum(math.comb(n, m) * s**m * (1 - s) ** (n - m) for m in range(least)) for s in (0.85, 0.9))
            assert nearer < miss and lost < 10 * miss
            # the posterior by integration: the next smaller count of agreements is below the bound, this one is not
            t = np.linspace(0, 1, 200_001)
            for m, above in ((least, True), (least - 1, False)):
                if m >= 0:
                    beta = t**m * (1 - t) ** (n - m)
                    assert (beta[t >= 0.85].sum() / beta.sum() >= miss * (0.999 if above else 1.001)) == above
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 32, 140, dtype=np.uint32)
    others = np.repeat(one[None], 3, 0)
    others[1, rng.choice(140, 90, replace=False)] = 7
    others[2, :10] = 7
    assert minhash.agreeing(one, others, minhash._bounds(85, 1e-7)).tolist() == [0, 2]
