"""Fill-in-the-middle against plain Python: small pieces, giants, marks, edges."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrain.llm import infill
from test_operators import EDGES

SHAPE = "doc_id long, text string"


def plainly(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def text_of(rng, n):
    return "".join(rng.choice(["abc", "P", "S", "<", "<", ">", "<P", "M>", " ", "\n", "é", "漢", "😀", "́", "x" * rng.randint(1, 700)]) for _ in range(n))


@pytest.mark.parametrize("piece", [256, 300, 1 << 16])
def test_same_as_plain(spark, monkeypatch, piece):
    """With small pieces nearly every text is a giant; 300 bytes cut code points and marks in two."""
    monkeypatch.setattr(infill, "PIECE", piece)
    rng = random.Random(piece)
    rows = [(i, text_of(rng, rng.choice([0, 1, 3, 10, 200]))) for i in range(120)]
    rows += [(7, "a" * 5000), (None, "é" * 900), (None, "<" * 2000), (8, "ab cd" * 400), (8, "ab cd" * 400), (9, "<P" + "x" * 600 + "<S>" + "y" * 900)]
    found = infill.filled_in_middle(spark.createDataFrame(rows, SHAPE))
    got = found.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(plainly(*r) for r in rows)
    assert Counter((r.doc_id, r.again) for r in got) == Counter(rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_marks_are_found_at_any_place(monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 4)
    rng = random.Random(3)
    texts = ["".join(rng.choice("<PSMx> é") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    exits, counts, chars = infill.Scan([t.encode() for t in texts]).functions()
    for t, e, c, k in zip(texts, exits, counts, chars, strict=True):
        assert (e[infill.OTHER] >= infill.SEEN) == bool(re.search("<[PSM]>", t))
        assert (c[infill.OTHER], k) == (len(re.findall(r"[A-Za-z]+|[^A-Za-z]", t)), len(t))
        # entered within a run of letters, letters at the start begin no token
        assert c[infill.LETTER] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", "a" + t)) - 1


def test_functions_compose_in_any_grouping():
    rng = np.random.default_rng(2)
    exits, counts = rng.integers(0, 6, (6, 50)).astype(np.uint8), rng.integers(0, 9, (6, 50))
    first = np.repeat([0, 7, 8, 30], [7, 1, 22, 20])
    left, sums = infill.composed(exits, counts, first)
    for i in range(50):
        for s in range(6):
            state, total = s, 0
            for j in range(first[i], i + 1):
                total, state = total + counts[state, j], exits[state, j]
            assert (left[s, i], sums[s, i]) == (state, total)


def test_edges(spark):
    rows = [(i, t, "q", 1, 2, 3, "f", "o") for i, t in EDGES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string, size int, n int, h1 int, form string, output string")
    found = infill.filled_in_middle(docs)
    assert Counter(map(tuple, found.collect())) == Counter(plainly(i, t) for i, t in EDGES)
    empty = infill.filled_in_middle(docs.limit(0))
    assert empty.count() == 0 and empty.columns == found.columns
