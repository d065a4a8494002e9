"""The corpus operators on small tables, against plain Python."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callgrain.llm import exact_dedup, jaccard, language, mixing, packing, pii, queries, substring, tokens, topk, warc

SF = "/root/testdata/sf0.001"
EDGES = [(1, None), (None, ""), (2, "A b"), (2, "A b"), (3, "a b"), (None, None), (5, "É" * 300), (6, "x y z " * 3000)]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, repeated rows, ties, a long text, and columns whose names operators use."""
    rows = [(i, t, "en" if t else None, "s", 0, "q", 1, 2) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, size int")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def test_token_counts_are_the_librarys(spark, texts, edges):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    rows = queries.op1_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    count = tokens.counter(queries.vocabulary()).count
    for x in ["", " ", "a" * 3000, "\n\n a\t b  c<|endoftext|>d", "\x01 x", "'s 'LL １２  é", "a \n", "​ x"]:
        assert count(x) == len(t.encode(x, add_special_tokens=False).ids)
    assert tokens.token_counts(edges, queries.vocabulary()).count() == len(EDGES)
    assert tokens.token_counts(edges.limit(0), queries.vocabulary()).count() == 0


def test_all_code_points_are_cut_as_by_the_library():
    """Letters, numbers and white space are the library's, whatever Unicode other packages know."""
    from tokenizers import Tokenizer

    t, count, ids = Tokenizer.from_file(queries.vocabulary()), tokens.MergeCounter(queries.vocabulary()).count, packing.ids_of(queries.vocabulary())
    points = [c for a, b in ((0, 0x34000), (0xE0000, 0xE0200), (0xF0000, 0xF0100), (0x10FF00, 0x110000)) for c in range(a, b) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        rows = [f"x{chr(c)}'s 1{chr(c)} {chr(c)}{chr(c)}!{chr(c)}\n" for c in points[at : at + 20_000]]
        for x, known in zip(rows, t.encode_batch(rows, add_special_tokens=False), strict=True):
            assert count(x) == len(known.ids) and np.frombuffer(ids.of(x), "<u4").tolist() == known.ids


def test_packing_is_a_partition_of_the_ids(spark, texts, edges):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    rows, bins = defaultdict(list), defaultdict(list)
    for r in queries.op2_best_fit_packing(spark, SF).collect():
        rows[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, x in texts.items():
        ids, at = t.encode(x, add_special_tokens=False).ids + [2], 0
        for n, r in enumerate(sorted(rows[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in rows[i] if r.piece)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.1 * sum(n for own in bins.values() for _, n in own) / 1024 + 2
    assert packing.packed(edges, queries.vocabulary()).filter("piece = 0").count() == len(EDGES)
    assert packing.packed(edges.limit(0), queries.vocabulary()).count() == 0


@given(st.text(st.one_of(st.sampled_from(" \n'.,1a\x01\x7f\xad\u200b\u0301é漢😀"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_librarys(text):
    ids = packing.ids_of(queries.vocabulary())
    assert ids.of(text) == ids.whole(text)


def test_ids_of_long_pieces_and_special_strings():
    ids = packing.ids_of(queries.vocabulary())
    assert ids.ranks is not None
    for text in ("a" * 20_000, " " * 5_000 + "x", "ab" * 9_000, "é漢" * 3_000, "!?" * 4_000, "\n" * 3_000, "one <|endoftext|> two", "<|endoftext|>"):
        assert ids.of(text) == ids.whole(text)


def test_topk_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    m, ids = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(int), np.array([r.vec_id for r in rows])
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.op3_exact_topk(spark, SF).collect()}
    for i in np.flatnonzero(ids % 50 == 0):
        scores = m @ m[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
        assert [found[ids[i], k + 1] for k in range(len(order))] == [(ids[j], scores[j]) for j in order]
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (50, None), (100, []), (1, [float("nan")]), (2, [0.5, None]), (3, [1.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(odd).orderBy("query_id", "rank").collect()][:3] == [(0, 3, 65536), (0, 3, 65536), (0, 100, 0)]
    assert topk.top_k(odd.limit(0)).count() == 0


def test_exact_groups(spark, texts, edges):
    low = lambda x: "".join(c.lower() if c.isascii() else c for c in x or "")
    groups = defaultdict(list)
    for i, x in texts.items():
        groups[low(x)].append(i)
    for r in queries.op4_exact_dedup(spark, SF).collect():
        own = groups[low(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(low(texts[r.doc_id]).encode()).hexdigest()
    rows = exact_dedup.duplicate_groups(edges).collect()
    assert len(rows) == len(EDGES) and sum(r.kept for r in rows) == 4
    kept = exact_dedup.deduplicated(edges)
    assert kept.columns == edges.columns and kept.count() == 4
    assert exact_dedup.deduplicated(edges.limit(0)).count() == 0


def test_language_on_held_out_rows(spark, edges):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op5_language_id(spark, sf).collect() if r.held_out]
    assert rows and sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert language.languages_of(edges).count() == len(EDGES)
    assert language.languages_of(edges.limit(0)).count() == 0


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs.select(docs.doc_id.alias("id"), "text", "lang"))
    one = {r.lang: r.text for r in docs.filter("n_chars between 400 and 900").select("lang", "text").collect()}
    text = one["en"] + " " + one["de"]
    row = language.identified(spark.createDataFrame([(text,)], "text string"), model, spans=True).first()
    assert [s.lang for s in row.spans] == ["en", "de"]
    assert abs(row.spans[1].start - len(one["en"])) < 60


def test_path_is_the_best_of_all_paths():
    def worth(scores, path):
        return sum(s[i] for s, i in zip(scores, path, strict=True)) - 10 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    def labeller(n):
        return language.Labeller(language.Model([str(i) for i in range(n)], np.zeros((1, n)), np.zeros((1, n), bool), 0))

    stretches = np.array([[0.0, -20, -2]] * 4 + [[-20, 0.0, -2]] * 4)
    assert labeller(3).path(stretches).tolist() == [0] * 4 + [1] * 4
    rng = np.random.default_rng(8)
    for _ in range(300):
        scores = -rng.integers(0, 13, (6, 3)).astype(float)
        best = max(worth(scores, p) for p in itertools.product(range(3), repeat=6))
        assert worth(scores, labeller(3).path(scores).tolist()) == best


def brute_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_plain_personal_data(texts, spark, edges):
    odd = ["a@b@c.com x..y@z.q-.r @a.b a@b. 1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111 1111 1111 +1 (415) 555-0100 +44 20 7946 0958.", "1" * 50 + ".2.3.4 " + "a" * 100 + "@b.c"]
    for t in [*texts.values(), *odd]:
        assert sorted(pii.plain_spans(t)) == brute_spans(t)
        assert set(pii.plain_spans(t)) <= set(pii.all_spans(t)[1])
    rows = pii.personal_data(edges).collect()
    assert len(rows) == len(EDGES) and all(r.spans == "" for r in rows)


@pytest.mark.parametrize(
    ("text", "part", "kind"),
    [
        ("write john [at] mail [dot] example [dot] com now", "john [at] mail [dot] example [dot] com", "email"),
        ("mail me: bob at corp dot org ok", "bob at corp dot org", "email"),
        ("see аnna@mаil.ru", "аnna@mаil.ru", "email"),
        ("write john five five at mail dot com soon", "john five five at mail dot com", "email"),
        ("write jоhn-two [at] mail [dot] com soon", "jоhn-two [at] mail [dot] com", "email"),
        ("ip one nine two dot one six eight dot zero dot one end", "one nine two dot one six eight dot zero dot one", "ip"),
        ("call plus one four one five five five five zero one zero zero please", "plus one four one five five five five zero one zero zero", "phone"),
    ],
)
def test_disguises_map_back(text, part, kind):
    assert [(text[a:b], k) for a, b, k in pii.all_spans(text)[1]] == [(part, kind)]


def undone(text, part, kind):
    return (part, kind) in [(text[a:b], k) for a, b, k in pii.all_spans(text)[1]]


@pytest.mark.parametrize("brackets", ["[]", "()", "{}", "<>"])
@pytest.mark.parametrize("blank", ["", " ", "  ", "\t", "\n", " \r\n"])
def test_every_bracket_form_is_undone(brackets, blank):
    a, b = (brackets[0] + blank, blank + brackets[1])
    for word in ("at", "AT", "@", "arroba", "Arobase"):
        part = f"jane{a}{word}{b}example.com"
        assert undone(f"mail {part} now", part, "email"), part
    for word in ("dot", "DOT", ".", "punkt", "Punto", "point"):
        part = f"jane@example{a}{word}{b}com"
        assert undone(f"mail {part} now", part, "email"), part
        part = f"8{a}{word}{b}8{a}{word}{b}4{a}{word}{b}4"
        assert undone(f"ip {part} now", part, "ip"), part


@pytest.mark.parametrize("gap", [" ", ", ", ".", "-", " - "])
@pytest.mark.parametrize("plus", ["plus ", "Plus, ", "+"])
def test_digits_and_words_may_alternate(gap, plus):
    part = plus + gap.join("1 four 1 five 5 five 0 one 0 zero".split())
    assert undone(f"call {part} please", part, "phone")


@pytest.mark.parametrize("odd", ["", "\u0130 "])
def test_spelled_addresses_are_undone(odd):
    for part in ("eight point eight point four point four", "Eight Dot 8 DOT four Point 4", "one zero.zero.zero.one"):
        assert undone(f"{odd}ip {part} end", part, "ip"), part


def test_disguises_are_found_in_linear_time():
    for text in (" " * 300_000 + "[", "a[" + "\t" * 300_000, "( " * 100_000, "one " + " " * 300_000, "1 " * 150_000 + "one", "dot " * 80_000, "a at b dot com " * 20_000, "x[at]y.de " * 20_000):
        began = time.perf_counter()
        pii.all_spans(text)
        assert time.perf_counter() - began < 5


@pytest.mark.parametrize("text", ["meet at example.com or look at this. Thing", "one or two at home", "dot by dot", "look at amazon dot com", "Arrive at noon dot Then we go"])
def test_plain_prose_has_no_disguise(text):
    assert pii.all_spans(text)[1] == []


def test_mix_meets_targets(spark, edges):
    rows = mixing.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = rows.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    assert mixing.mixed(edges).count() == len(EDGES)
    assert mixing.mixed(edges.limit(0)).count() == 0
    assert mixing.mixed_documents(edges).columns == edges.columns


@pytest.mark.parametrize("later", [1 << 16, 3])
def test_mix_fills_the_room_before_a_long_document(spark, monkeypatch, later):
    monkeypatch.setattr(mixing, "LATER", later)
    monkeypatch.setattr(mixing, "EDGE", 4)
    rng, rows = random.Random(5), []
    for source, long in (("a", 60_000), ("b", 60_000), ("c", 200)):
        sizes = [long, *[rng.randint(20, 200) for _ in range(500)]]
        rows += [(f"{source}{i}", "w " * n, source) for i, n in enumerate(sizes)]
    rows += [("r", "w " * 50, "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    for seed in range(2):
        found = mixing.mixed(docs, seed=seed).collect()
        assert len(found) == len(rows) and len({r.taken for r in found if r.doc_id == "r"}) == 1
        taken, target = defaultdict(int), {}
        for r in found:
            taken[r.doc_id[0].replace("r", "a")] += r.taken
            target[r.doc_id[0].replace("r", "a")] = r.target
        assert all(abs(taken[s] - target[s]) <= 100 for s in target), (taken, target)
        kept = mixing.mixed_documents(docs, seed=seed).groupBy("doc_id").count().collect()
        size = {r.doc_id: r.size for r in found}
        assert sum(size[r.doc_id] * r["count"] for r in kept) == sum(taken.values())


def test_flow_shares_overlapping_sources():
    assert mixing.route([(("a", "b"), 10), (("a",), 10)], {"a": 10.0, "b": 10.0}) == [10, 10]
    assert mixing.targets([("a", 1), ("b", 100), (None, 10)], 111)["a"] == 3.0


def brute_repeats(rows, w=20):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        ws, own = words(t), set()
        gone = [False] * len(ws)
        for s in range(len(ws) - w + 1):
            k = tuple(ws[s : s + w])
            if k in seen or k in own:
                gone[s : s + w] = [True] * w
            own.add(k)
        seen |= own
        out[i] = (len(ws), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(ws, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [512, 2])
def test_repeated_passages(spark, texts, edges, monkeypatch, frequent):
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substring_dedup(spark, SF).collect()}
    assert found == brute_repeats(texts)
    assert substring.without_repeats(edges).count() == len(EDGES)
    assert substring.without_repeats(edges.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [512, 1])
def test_repeats_stay_within_their_row(spark, monkeypatch, frequent):
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared, own = new(40), new(30)
    rows = [(1, shared), (None, new(100) + shared), (None, new(200)), (None, new(22)), (None, own), (None, own)]
    rows += [(7, new(60) + shared + new(9)), (7, new(150)), (7, new(21)), (8, new(25) + own)]
    expect = sorted((-1 if i is None else i, len(w), 40 * (len(w) in (140, 109)) + 30 * (w is own)) for i, w in rows)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").coalesce(1)
    found = substring.without_repeats(table, with_text=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in found) == expect
    kept = {(i, " ".join(x for x in w if x not in shared or i == 1)) for i, w in rows if w is not own}
    assert kept <= {(r.doc_id, r.kept) for r in found}


@pytest.mark.parametrize("split", [1 << 22, 2000])
def test_archives_round_trip(spark, split):
    pages = [(1, None, None), (None, "u\r\nx", "y" * 200), (2, "é", "y" * 200), (2, "é", "y" * 200), (3, "q", "z" * 99), (4, "q", "z" * 99)]
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    table = spark.createDataFrame(rows + [(None if i is None else i + 10**6, u, h) for i, u, h in pages], "page_id long, url string, html string")
    found = warc.round_trip(table, split=split, keep_payload=True).collect()
    assert len(found) == table.count()
    html = {r.page_id: (r.html or "").encode() for r in table.collect()}
    for r in found:
        assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest() and r.payload_bytes == len(html[r.page_id])
        assert r.record_type == "revisit" or bytes(r.payload) == html[r.page_id]
    assert [(r.record_type, r.refers_to) for r in found if r.page_id is None] == [("revisit", 10**6 + 2)]
    assert warc.round_trip(table.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1 << 22, 5000])
def test_headers_may_have_any_length(spark, split):
    rng = random.Random(6)
    urls = ["u" * 65_500, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(8000)), "".join(chr(rng.randrange(33, 127)) for _ in range(3_000_000)), None]
    rows = [(10 * i + n, url, body) for i, url in enumerate(urls) for n, body in enumerate(("", "y" * 200, f"{i} WARC/1.1\r\n\r\n"))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(table)
    found = {r.page_id: r for r in warc.read_archives(spark, archives, split=split, keep_payload=True).collect()}
    assert sorted(found) == sorted(i for i, _, _ in rows)
    for i, _, body in rows:
        again = i % 10 == 1 and i > 1
        assert (found[i].record_type, found[i].refers_to) == (("revisit", 1) if again else ("response", None))
        assert found[i].payload_digest == hashlib.sha256(body.encode()).hexdigest() and (again or bytes(found[i].payload) == body.encode())


def brute_components(rows):
    sets = {}
    for i, t in rows.items():
        w = words(t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    at = defaultdict(list)
    for i, s in sets.items():
        for k in s:
            at[k].append(i)
    shared = defaultdict(int)
    for own in at.values():
        for a in range(len(own)):
            for b in range(a):
                shared[own[a], own[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("often", [4, 10**9])
def test_near_duplicates(spark, edges, monkeypatch, often):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(80)] for _ in range(8)]
    rows = {}
    for i in range(250):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        rows[i] = " ".join(w[: rng.randint(0, 80)] if rng.random() < 0.3 else w)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(table).collect()} == brute_components(rows)
    assert jaccard.near_duplicates(edges).count() == len(EDGES)
    assert jaccard.near_duplicates(edges.limit(0)).count() == 0
    assert jaccard.one_of_each(edges).columns == edges.columns


def test_parity_bits_never_hide_a_link():
    rng = np.random.default_rng(4)
    for _ in range(500):
        pool = rng.integers(0, 2**63, 460).astype(np.uint64)
        n = int(rng.integers(1, 400))
        a = np.unique(pool[:n])
        b = np.unique(np.r_[pool[int(rng.integers(0, 1 + n // 5)) : n], pool[400 : 400 + int(rng.integers(0, 60))]])
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            assert jaccard._may_link(jaccard.sketch(a), len(a), jaccard.sketch(b), len(b), 80)


def test_pipeline_stages_keep_clean_documents(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    once = corpus_pipeline.exact_duplicates(spark, docs, SF)
    assert once.count() == len({x.lower() for x in texts.values()})
    near = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert near == {c for _, c in brute_components(texts).values()}
    assert corpus_pipeline.run(spark, SF).columns[:2] == ["doc_id", "piece"]
