"""Optima, packings, hot groups and the whole pipeline against plain versions of them."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrain.llm import exact_dedup, graph, jaccard, language, mixing, packing, pii, queries, substring, tokens, topk
from test_operators import EDGES, SF, brute_components, brute_repeats, words


def feasible(given, patterns, quota):
    """Hall's condition: whatever patterns are taken together, their sources have room for them."""
    return all(
        sum(given[i] for i in own) <= sum(quota[s] for s in set().union(*(patterns[i][0] for i in own))) + 1e-9
        for n in range(1, len(patterns) + 1)
        for own in itertools.combinations(range(len(patterns)), n)
    )


def test_flow_is_the_cheapest_of_the_largest():
    rng = random.Random(4)
    cost = lambda n, size: sum(1 + k // size for k in range(n))
    for _ in range(150):
        names = "abc"[: rng.randint(1, 3)]
        patterns = [(tuple(sorted(rng.sample(names, rng.randint(1, len(names))))), rng.randint(1, 2)) for _ in range(rng.randint(1, 3))]
        quota = {s: float(rng.randint(0, 5)) for s in names}
        best = max(
            (sum(g), -sum(cost(n, p[1]) for n, p in zip(g, patterns, strict=True)))
            for g in itertools.product(*[range(3 * p[1] + 1) for p in patterns])
            if feasible(g, patterns, quota)
        )
        found = mixing.route(patterns, quota)
        assert feasible(found, patterns, quota)
        assert (round(sum(found)), -sum(cost(round(n), p[1]) for n, p in zip(found, patterns, strict=True))) == best


def test_overlapping_sources_through_spark(spark):
    rng, rows = random.Random(7), []
    for i in range(900):
        own = rng.choice([["a"], ["b"], ["a", "b"], ["b", "c"], ["c", "b", "c"], None])
        rows.append((i, "w " * rng.randint(1, 30), own))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    found = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    size, taken = Counter(), Counter()
    for i, text, own in rows:
        key = tuple(sorted(set(own))) if own else (None,)
        size[key] += len(text.split())
        taken[key] += found[i].taken
        assert found[i].taken % found[i].size == 0 and found[i].taken <= 3 * found[i].size
    sizes = Counter()
    for key, n in size.items():
        for s in key:
            sizes[s] += n
    quota = mixing.targets(list(sizes.items()), sum(size.values()))
    patterns = sorted(size.items(), key=lambda p: ["null" if s is None else s for s in p[0]])
    given = mixing.route(patterns, quota)
    assert sum(taken.values()) == pytest.approx(sum(given), abs=60)
    assert {r.doc_id: r.taken for r in mixing.mixed(docs.repartition(5)).collect()} == {i: r.taken for i, r in found.items()}


def test_packing_is_as_tight_as_plain_best_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    rows = packing.packed(docs, queries.vocabulary()).collect()
    open_bins, bins = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        fits = [b for b in open_bins if b >= r.length]
        if fits:
            open_bins.remove(b := min(fits))
        else:
            b, bins = 1024, bins + 1
        open_bins.append(b - r.length)
    assert len({r.sequence_id for r in rows}) <= 1.01 * bins + 1


@pytest.mark.parametrize("bins", [1, 3, 40])
def test_best_fit_closes_the_fullest(bins):
    rng = random.Random(bins)
    best, held, closed = packing.BestFit(50, bins), {}, set()
    for _ in range(500):
        n = rng.randint(1, 50)
        fits = [b for b, used in held.items() if used + n <= 50]
        tightest = max((held[b] for b in fits), default=None)
        own, offset = best.put(n)
        assert own not in closed
        if fits:
            assert held[own] == tightest == offset
        else:
            assert own not in held and offset == 0
        for b in best.closed:
            if held.get(b, 0) + (n if b == own else 0) < 50:
                assert held[b] == max(held.values())
            held.pop(b, None)
        closed |= set(best.closed)
        if own not in closed:
            held[own] = held.get(own, 0) + n
        best.closed.clear()
        assert len(held) <= bins
    assert dict(best.still_open()) == held


def edge_rows(spark):
    rows = [(i, t, "en" if t else None, "s", 0, "q", 1, 2) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, size int")


def as_set(rows):
    return Counter(map(tuple, rows))


def test_edges_have_their_values(spark):
    docs, low = edge_rows(spark), lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    count = tokens.counter(queries.vocabulary()).count
    assert as_set(tokens.token_counts(docs, queries.vocabulary()).collect()) == as_set([(i, len((t or "").encode()), count(t), count(t) > 512) for i, t in EDGES])
    ids = packing.ids_of(queries.vocabulary())
    pieces = Counter()
    for i, t in EDGES:
        body = ids.of(t) + (2).to_bytes(4, "little")
        for n, (start, length) in enumerate(packing.pieces(len(body) // 4, 1024)):
            pieces[i, n, start, length, zlib.crc32(body[4 * start : 4 * (start + length)])] += 1
    assert as_set(packing.packed(docs, queries.vocabulary()).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == pieces
    groups = defaultdict(list)
    for i, t in EDGES:
        groups[low(t)].append(i)
    top = {t: max((i for i in own if i is not None), default=None) for t, own in groups.items()}
    rows = exact_dedup.duplicate_groups(docs).collect()
    assert as_set((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == as_set((i, top[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in EDGES)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    found = language.languages_of(docs)
    assert as_set(found.select("doc_id", "lang_pred").collect()) == as_set((i, "en" if t else "und") for i, t in EDGES)
    assert as_set(pii.personal_data(docs).select("doc_id", "n_email", "spans").collect()) == as_set((i, 0, "") for i, _ in EDGES)
    mix = mixing.mixed(docs).collect()
    whole = sum(len(words(t or "")) for _, t in EDGES)
    assert as_set((r.doc_id, r.size, r.source_size, r.target) for r in mix) == as_set((i, len(words(t or "")), whole, float(whole)) for i, t in EDGES)
    assert sum(r.taken for r in mix) == whole
    one, long = hashlib.sha256(b"").hexdigest(), "x y z " * 3000
    kept = {None: one, 1: one, 2: hashlib.sha256(b"A b").hexdigest(), 3: hashlib.sha256(b"a b").hexdigest(), 5: hashlib.sha256(("É" * 300).encode()).hexdigest()}
    rest = brute_repeats({6: long})[6]
    assert as_set(substring.without_repeats(docs).collect()) == as_set((i, len(words(t or "")), 0, kept[i]) if i != 6 else (6, *rest) for i, t in EDGES)
    sets = [(i, t) for i, t in EDGES if t]
    near = brute_components(dict(sets))
    expect = [(i, near[i][0], near[i][1]) if t else (i, 0, i) for i, t in EDGES]
    assert as_set(jaccard.near_duplicates(docs).collect()) == as_set(expect)


def test_one_text_may_be_half_of_all_rows(spark):
    rows = [(i, "same text" if i % 2 else f"text {i}") for i in range(3000)] + [(7000, "kept twice"), (7000, "kept twice"), (6999, "kept twice")]
    found = {}
    for r in exact_dedup.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert all(found[i] == [(2999, 1500, i == 2999)] for i in range(1, 3000, 2)) and all(found[i] == [(i, 1, True)] for i in range(0, 3000, 2))
    assert sorted(found[7000]) == [(7000, 3, False), (7000, 3, True)] and found[6999] == [(7000, 3, False)]


def test_components_of_stars_and_chains(spark):
    rng = random.Random(1)
    links = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1150)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: top(x) for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize(("fan", "share"), [(2, 3), (256, 1024)])
def test_hot_sets_lose_no_link(spark, monkeypatch, fan, share):
    monkeypatch.setattr(jaccard, "FAN", fan)
    monkeypatch.setattr(jaccard, "SHARE", share)
    rng = random.Random(5)
    new = lambda n: [f"v{rng.randrange(10**8)}" for _ in range(n)]
    common, rows = new(12), {}
    for i in range(40):  # unrelated documents with a passage in common, and near copies of a few of them
        body = new(rng.randint(20, 60))
        rows[3 * i] = " ".join(common + body)
        for k in range(rng.randint(0, 2)):
            moved = list(body)
            moved[rng.randrange(len(moved))] = "odd"
            rows[3 * i + k + 1] = " ".join(common + moved)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert found == brute_components(rows)


def test_a_line_said_often_in_one_document(spark, monkeypatch):
    monkeypatch.setattr(substring, "FREQUENT", 3)
    line = " ".join(f"l{i}" for i in range(25))
    rows = {1: " ".join([line] * 40 + ["end"]), 2: "head " + line, 3: f"{line} x {line}", 4: "alone " * 5}
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert found == brute_repeats(rows)


@pytest.mark.parametrize(("d", "scale"), [(1, 1.0), (6, 1.0), (6, 50.0)])
def test_topk_over_many_blocks(spark, monkeypatch, d, scale):
    for name, value in (("BLOCK", 16), ("QUERIES", 4), ("GROUP", 2), ("STEP", 5)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(d)
    v = rng.integers(-3, 4, (300, d)) / 4.0 * rng.choice([0.0, 1.0, scale], (300, 1))
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    m = np.floor(256 * v).astype(int)
    expect = {}
    for i in range(0, 300, 50):
        s = m @ m[i]
        for rank, j in enumerate([j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]):
            expect[i, rank + 1] = (j, s[j])
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(table).collect()} == expect


def test_other_vocabularies_are_refused_or_left_to_their_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = public_tokenizers.path("word_bpe_49k.json")
    with pytest.raises(ValueError, match="normaliser"):
        tokens.MergeCounter(other)
    ids, text = packing._Ids(other), "Two words, TWO words"
    assert np.frombuffer(ids.of(text), "<u4").tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


def test_memory_of_workers_is_bounded():
    counter = tokens.MergeCounter(queries.vocabulary())
    counter.counts.most = counter.parts.most = 20_000
    for i in range(3000):
        counter.count(f"word{i} {'x' * 500}{i}")
    assert max(counter.counts.held, counter.parts.held) <= 20_000 and all(len(k) <= 64 for k in counter.parts)


def test_one_row_of_each_group(spark):
    """Clashing, repeated and null ids: of each group of linked texts one row stays, with the smallest id."""
    base = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(base[:k] + ["x"] + base[k + 1 :])  # noqa: E731  all link with one another
    other, blank = "one two three four five six seven", " "
    rows = [(0, text(1)), (1, other), (1, text(2)), (7, text(3)), (7, text(3)), (None, text(1)), (None, "a b c d e f"), (None, "a b c d e f"), (None, "a b c d e f"), (None, "A b c d e f"), (5, blank), (5, blank), (5, None), (0, "lone words of its own here"), (0, text(5))]
    shape = "doc_id long, text string, _id long, mark string, doc int, copies int"
    docs = spark.createDataFrame([(*r, 1, "m", 2, 3) for r in rows], shape)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    found = Counter((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    linked = [x for x in found if x[1].startswith(("w0", "x w1"))]
    assert len(linked) == 1 and linked[0][0] == 0 and found[linked[0]] == 1
    assert found - Counter(linked) == Counter({(1, other): 1, (None, "a b c d e f"): 1, (5, blank): 2, (5, ""): 1, (0, "lone words of its own here"): 1})
    assert jaccard.one_of_each(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(7, other)] * 3 + [(None, base[0])] * 2, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.one_of_each(same).collect())) == Counter([(7, other), (None, base[0])])


def test_pipeline_is_its_stages_done_plainly(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    told = corpus_pipeline.language_id(spark, docs, SF)
    kept = {r.doc_id: r for r in told.collect()}
    scored = {r.doc_id: (r.lang_pred, r.score) for r in language.languages_of(docs).collect()}
    assert kept.keys() == {i for i, (lang, score) in scored.items() if lang != "und" and score >= 0.5} and all(kept[i] == rows[i] for i in kept)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    last = {}
    for i in sorted(kept):
        last[low(kept[i].text)] = i
    once = corpus_pipeline.exact_duplicates(spark, told, SF)
    assert sorted(r.doc_id for r in once.collect()) == sorted(last.values())
    texts = {i: rows[i].text or "" for i in last.values()}
    near = corpus_pipeline.near_duplicates(spark, once, SF)
    apart = {c for _, c in brute_components(texts).values()}
    assert {r.doc_id for r in near.collect()} == apart
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, near, SF).collect())
    sizes, by_source = {i: len(words(texts[i])) for i in apart}, defaultdict(int)
    for i in apart:
        by_source[rows[i].source] += sizes[i]
    quota, taken = mixing.targets(list(by_source.items()), sum(sizes.values())), defaultdict(int)
    for i, n in mixed.items():
        taken[rows[i].source] += n * sizes[i]
    assert set(mixed.values()) <= {1, 2, 3} and mixed.keys() <= apart
    longest = max(sizes.values())
    assert all(abs(taken[s] - quota[s]) <= longest for s in quota)
    ids, expect = packing.ids_of(queries.vocabulary()), Counter()
    for i, n in mixed.items():
        body = ids.of(texts[i]) + (2).to_bytes(4, "little")
        for at, (start, length) in enumerate(packing.pieces(len(body) // 4, 1024)):
            expect[i, at, start, length, zlib.crc32(body[4 * start : 4 * (start + length)])] += n
    final = corpus_pipeline.run(spark, SF)
    assert as_set(final.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == expect
    fill = final.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in fill)
