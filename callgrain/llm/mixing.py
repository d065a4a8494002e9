"""Mixing overlapping sources to target weights.

Documents are summed up by membership pattern: the set of sources they belong to. A
flow then routes words from patterns to sources. Each pattern offers its words three
times, each time at a higher cost (repeats are worth less), and each source takes up
to its target. The cheapest largest flow says how many words each pattern gives;
documents are then selected in a seeded order, whole, until that is met.
"""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.llm._shared import written

#: Times that a document is taken at most, and its words offered.
REPEATS = 3
#: Bits of a key that number the buckets of the seeded order within a pattern, at least and at most; documents are put in
#: order in one bucket only, which has about IN_BUCKET of them.
FEWEST_BITS, MOST_BITS, IN_BUCKET = 12, 24, 4096
#: Documents put in order at once, at the first cut and at later ones; any number of cuts follows.
EDGE, LATER = 64, 1 << 16
#: Patterns and sources that the driver's flow takes; beyond that the operator refuses.
MOST_PATTERNS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], total: int) -> dict[str | None, float]:
    """Each source's words in the mix: weights 1, 2, 3, repeating, in code point order, null last.

    Together they share ``total``, all words of the documents. A target stops at REPEATS times its source's size,
    and what is over goes to the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    weight = {name: 1 + i % 3 for i, (name, _) in enumerate(order)}
    limit = {name: float(REPEATS * size) for name, size in order}
    out, left, free = {}, float(total), dict(order)
    while free:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if each * weight[s] > limit[s]]
        if not full:
            return out | {s: each * weight[s] for s in free}
        for s in full:
            out[s] = limit[s]
            left -= limit[s]
            del free[s]
    return out


def route(patterns: list[tuple[tuple, int]], quota: dict[str | None, float]) -> list[float]:
    """Words each pattern gives, by the cheapest flow that meets the quotas as far as can be.

    patterns: (sources, size). Costs arise only where words enter a pattern, and rise
    with each repetition, the same for all. Paths that add flow never take any from such
    an edge, so the cheapest flow comes from filling the first repetitions as far as they
    go, then the second ones, then the third.
    """
    given = [0.0] * len(patterns)
    taken = {s: 0.0 for s in quota}
    sent: dict[tuple[int, str | None], float] = {}
    users: dict[str | None, set[int]] = {s: set() for s in quota}
    eps = 1e-6
    for repeat in range(1, REPEATS + 1):
        for i, (_, size) in enumerate(patterns):
            while given[i] < repeat * size - eps:
                # breadth first, along patterns and sources, to a source that wants more
                came: dict[str | None, tuple[int, str | None] | None] = {}
                queue, end = deque(), None
                for s in patterns[i][0]:
                    came[s] = (i, None)
                    queue.append(s)
                while queue and end is None:
                    s = queue.popleft()
                    if quota[s] - taken[s] > eps:
                        end = s
                        break
                    for j in users[s]:
                        if sent.get((j, s), 0) > eps:
                            for t in patterns[j][0]:
                                if t not in came:
                                    came[t] = (j, s)
                                    queue.append(t)
                if end is None:
                    break
                hops, s = [], end
                while True:
                    j, before = came[s]
                    hops.append((j, s, before))
                    if before is None and j == i:
                        break
                    s = before
                step = min([repeat * size - given[i], quota[end] - taken[end], *[sent[j, b] for j, _, b in hops if b is not None or j != i]])
                for j, s, before in hops:
                    sent[j, s] = sent.get((j, s), 0.0) + step
                    users[s].add(j)
                    if before is not None or j != i:
                        sent[j, before] -= step
                given[i] += step
                taken[end] += step
    return given


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, keep_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``; with ``keep_rows``, doc and times.

    source_col holds a source or an array of the sources a document belongs to; a null
    is a source too. Size is the number of words; empty and null texts have 0 and are
    never taken. A document's order comes from ``seed``, its id and its text, so reruns
    agree, and rows equal in both are taken or left together. No document is taken more
    than three times. source_size and target are sums over a document's sources.

    Sums by pattern and bucket are made before the shuffle, so a hot source is no more
    than a row a bucket; only documents of a bucket a pattern, or EDGE of them, are put in order, and
    the number of buckets grows with the documents.
    Room that these leave goes to later documents that fit, by sums and buckets again,
    until none is left that fits.
    The flow works on one number a pattern; beyond MOST_PATTERNS it raises.
    """
    spark = docs.sparkSession
    is_array = docs.schema[source_col].dataType.typeName() == "array"
    source = F.col(f"`{source_col}`")
    members = F.array_sort(F.array_distinct(F.coalesce(source, F.array(F.lit(None).cast("string"))))) if is_array else F.array(source.cast("string"))
    text = F.col(f"`{text_col}`")
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text)
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc") if keep_rows else F.col(f"`{id_col}`").alias("doc")
    rows = docs.select(struct, F.to_json(members).alias("members"), word_count(text).alias("size"), key.alias("key"))
    if not keep_rows:
        rows = written(rows)
    narrow = written(rows.select("members", "key", "size")) if keep_rows else rows.select("members", "key", "size")
    bits = min(MOST_BITS, max(FEWEST_BITS, (narrow.count() // IN_BUCKET).bit_length()))
    bucket = F.shiftrightunsigned(F.col("key"), 64 - bits).cast("int")
    rows, narrow = rows.withColumn("bucket", bucket), narrow.withColumn("bucket", bucket)
    hist = written(narrow.groupBy("members", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    patterns = hist.groupBy("members").agg(F.sum("size").alias("size")).orderBy("members").limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    sizes: dict[str | None, int] = {}
    names = [tuple(json.loads(p.members)) for p in patterns]
    for p, own in zip(patterns, names, strict=True):
        for s in own:
            sizes[s] = sizes.get(s, 0) + p["size"]
    quota = targets(list(sizes.items()), sum(p["size"] for p in patterns))
    given = route([(own, p["size"]) for own, p in zip(names, patterns, strict=True)], quota)
    plan = []
    for p, own, words in zip(patterns, names, given, strict=True):
        times = min(REPEATS, int(words // p["size"])) if p["size"] else 0
        rest = 0 if times == REPEATS else round(words - times * p["size"])
        plan.append((p.members, len(plan), times, rest, sum(sizes[s] for s in own), float(sum(quota[s] for s in own))))
    table = spark.createDataFrame(plan, "members string, pattern int, times int, rest long, source_size long, target double")
    marks, chosen = _chosen(narrow, hist, table, 1 << bits)
    placed = rows.join(F.broadcast(marks), "members")
    # only rows of these buckets and sizes can have a match; the others are not shuffled
    asked = F.col("bucket").between(F.col("cut"), F.col("until")) & ((F.col("bucket") <= F.col("last")) | (F.col("size") < F.col("bound")))
    edge = placed.filter(asked).join(chosen, ["pattern", "key"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    inner = placed.filter(~asked).withColumn("chosen", F.col("bucket") < F.col("cut"))
    out = inner.unionByName(edge)
    times = F.when(F.col("size") > 0, F.col("times") + F.col("chosen").cast("int")).otherwise(0)
    if keep_rows:
        return out.select("doc", times.alias("times"))
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


def _chosen(narrow: DataFrame, hist: DataFrame, plan: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The plan with marks, and (pattern, key, chosen) of the documents taken from the first cut on.

    All of a bucket before ``cut`` are taken. Taken ones after it are in buckets to
    ``until``, and if past ``last``, of sizes under ``bound``. In seeded order, a document is
    taken if it still fits. Room never grows, so one that did not fit is not asked again, and
    each round takes at least one document of those that still fit, or ends.
    """
    spark = plan.sparkSession
    own = plan.select("members", "pattern", "rest")
    first = written(_cuts(hist.join(F.broadcast(own), "members"), EDGE, buckets))
    at_cut = narrow.join(F.broadcast(own.join(first, "pattern")), "members").filter("bucket between cut and last")
    at_cut = at_cut.groupBy("pattern", "bucket", "key", "room").agg(F.sum("size").alias("size"))
    steps = [written(at_cut.groupBy("pattern").applyInPandas(_fill, _FILLED))]
    rooms, ends = _rooms(steps[0]), {r.pattern: r["last"] for r in first.select("pattern", "last").collect()}
    bounds, fits = dict(rooms), None
    after = {p: (ends[p], room) for p, room in rooms.items() if room > 0}
    while after:
        state = F.broadcast(spark.createDataFrame([(p, *at) for p, at in after.items()], "pattern int, after int, rest long"))
        if fits is None:
            fits = narrow.join(F.broadcast(own.drop("rest").join(state, "pattern")), "members").filter("bucket > after and size between 1 and rest")
            fits = written(fits.groupBy("pattern", "bucket", "key").agg(F.sum("size").alias("size")))
        left = fits.join(state, "pattern").filter("bucket > after and size <= rest").drop("after")
        sums = left.groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        cuts = written(_cuts(sums, LATER, buckets))
        placed = left.join(F.broadcast(cuts), "pattern")
        whole = placed.filter("bucket < cut").select("pattern", "bucket", "key", "size", F.lit(True).alias("chosen"), "room")
        filled = placed.filter("bucket between cut and last").select("pattern", "bucket", "key", "size", "room").groupBy("pattern").applyInPandas(_fill, _FILLED)
        steps.append(written(whole.unionByName(filled)))
        # room is what was left at the cut, so rows of whole buckets do not count against it
        rooms |= _rooms(steps[-1].join(F.broadcast(cuts.select("pattern", "cut")), "pattern").withColumn("chosen", F.expr("chosen and bucket >= cut")))
        after = {r.pattern: (r["last"], rooms[r.pattern]) for r in cuts.collect() if r["last"] < buckets and rooms[r.pattern] > 0}
    taken = steps[0]
    for step in steps[1:]:
        taken = taken.unionByName(step)
    taken = taken.filter("chosen").select("pattern", "bucket", "key")
    # the smallest document not taken may go over if that comes nearer
    short = spark.createDataFrame([(p, room) for p, room in rooms.items() if room > 0], "pattern int, short long")
    over = narrow.join(F.broadcast(own.drop("rest").join(first, "pattern").join(short, "pattern")), "members").filter("bucket >= cut and size > 0 and size < 2 * short")
    over = over.groupBy("pattern", "bucket", "key", "short").agg(F.sum("size").alias("size")).filter("size < 2 * short")
    over = over.join(taken, ["pattern", "bucket", "key"], "left_anti").groupBy("pattern").agg(F.min(F.struct("size", "bucket", "key")).alias("doc"))
    taken = written(taken.unionByName(over.select("pattern", "doc.bucket", "doc.key")))
    until = taken.groupBy("pattern").agg(F.max("bucket").alias("until"))
    bound = spark.createDataFrame([(p, 2 * room) for p, room in bounds.items()], "pattern int, bound long")
    marks = plan.join(first.drop("room"), "pattern", "left").join(until, "pattern", "left").join(bound, "pattern", "left")
    marks = marks.fillna({"cut": buckets, "last": buckets, "until": -1, "bound": 0})
    return written(marks), taken.select("pattern", "key", F.lit(True).alias("chosen"))


def _cuts(sums: DataFrame, edge: int, buckets: int) -> DataFrame:
    """pattern, the buckets, cut to last, in which each pattern's rest is met, and the room left at their start.

    That is one bucket, and as many more as it takes to choose from ``edge`` documents. If all fit, both are ``buckets``,
    and room is what they leave.
    """
    own = Window.partitionBy("pattern").orderBy("bucket")
    every = sums.withColumn("upto", F.sum("size").over(own)).withColumn("seen", F.sum("n").over(own) - F.col("n"))
    met = every.filter(F.col("upto") > F.col("rest")).withColumn("past", F.col("seen") - F.min("seen").over(Window.partitionBy("pattern")))
    room = F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("size")).alias("room"))
    first = met.filter(F.col("past") < edge).groupBy("pattern").agg(F.min_by(room, "bucket").alias("at"), F.max("bucket").alias("last"))
    total = sums.groupBy("pattern").agg((F.first("rest") - F.sum("size")).alias("spare"))
    return total.join(first, "pattern", "left").select(
        "pattern", F.coalesce("at.bucket", F.lit(buckets)).alias("cut"), F.coalesce("last", F.lit(buckets)).alias("last"), F.coalesce("at.room", "spare").alias("room")
    )


_FILLED = "pattern int, bucket int, key long, size long, chosen boolean, room long"


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """In seeded order, takes what still fits."""
    rows = rows.sort_values(["bucket", "key"])
    room, chosen = int(rows.room.iloc[0]), []
    for size in rows["size"].tolist():
        chosen.append(size <= room)
        room -= size * (size <= room)
    return rows.assign(chosen=chosen)[["pattern", "bucket", "key", "size", "chosen", "room"]]


def _rooms(step: DataFrame) -> dict[int, int]:
    """What is left of each pattern's room."""
    left = F.max("room") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))
    return {r.pattern: r.left for r in step.groupBy("pattern").agg(left.alias("left")).collect()}


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` in the mix, each as often as it is taken, with their own columns."""
    rows = mixed(docs, keep_rows=True, **options).filter("times > 0")
    return rows.select(F.explode(F.array_repeat("doc", F.col("times"))).alias("doc")).select("doc.*")
