"""N-gram Jaccard join of whole texts, and the groups its links form.

A document is its set of distinct word shingles. Sets that link share a token in their
prefixes under any order of the tokens, so candidates are pairs that share prefix tokens
under several orders: the first order meets in Spark's shuffle, then as many tokens must
be shared under the second, and one under the third, before two sets are compared. All orders put frequent tokens last.

Equal sets are one class from the start. Within a token's group not all pairs are made:
first each member is compared with the group's member of lowest token position; only
members that are still in different components after that are compared with one another.
Both kinds of pairs first pass a check of the sets' parity bits, one bit or two a token: the
bits in which two sketches differ are no more than the tokens in which the sets do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm._shared import HEAVY_GROUPS, arrow_map, attach_groups, bitmap_bytes, by_bucket, chunks, dealt, filter_bits, gathered, in_bitmap, mixed, partitions, runs, signed, text_bytes, word_hashes, written
from callgrain.llm.graph import components

#: Seeds of the token orders.
ORDERS = (11, 12, 13)
#: A token met so often within LOCAL shingles of a task is counted as frequent; the list of them has MOST at most.
OFTEN, LOCAL, MOST = 4, 1 << 20, 250_000
#: Sets compared with one set in a task.
FAN = 256
#: Members of a group that a task compares, on either side.
SHARE = 1024


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    for a, b in chunks(texts):
        split = [t.lower().split() for t in texts[a:b]]  # of bytes: A-Z alone, ASCII white space alone
        hashes = mixed(word_hashes([w for own in split for w in own]))
        grams = mixed(runs(hashes, words), 2)
        at = 0
        for own in split:
            n = len(own)
            if n >= words:
                yield np.unique(grams[at : at + n - words + 1])
            elif n:
                yield mixed(runs(hashes[at : at + n], n), 100 + n)
            else:
                yield hashes[:0]
            at += n


def class_of(tokens: np.ndarray) -> np.ndarray:
    """A hash of a set as its id: sums over two mixings of its tokens; 0 for the empty set."""
    with np.errstate(over="ignore"):
        one, two = mixed(tokens, 5).sum(dtype=np.uint64), mixed(tokens, 6).sum(dtype=np.uint64)
        return mixed(one * np.uint64(0x9FB21C651E98DF25) ^ two + np.uint64(len(tokens)), 7) if len(tokens) else np.uint64(0)


def ranked(tokens: np.ndarray, frequent: np.ndarray, seed: int) -> np.ndarray:
    """The tokens in an order: those not in ``frequent`` (sorted) first, each part by a seeded hash."""
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    common = frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)
    return tokens[np.lexsort((mixed(tokens, seed), common))]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens by slot, in 64-bit words; the slots are a power of two, as many as tokens or more."""
    bits = 1 << max(6, (max(1, len(tokens)) - 1).bit_length())
    odd = np.bincount((mixed(tokens, 31) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _halved(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches of fewer slots: upper halves fall on lower ones until ``width`` words are left."""
    while x.shape[-1] > width:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _may_link(x: np.ndarray, n: int, y: np.ndarray, m: np.ndarray | int, threshold: int) -> np.ndarray:
    """Sketch x of a set of n tokens against sketches y of sets of m: False where too many bits differ for a link."""
    width = min(x.shape[-1], y.shape[-1])
    differ = np.bitwise_count(_halved(x, width) ^ _halved(y, width)).sum(-1, dtype=np.int64)
    shared = -(-threshold * (n + m) // (100 + threshold))  # at the least, if they link
    return differ <= n + m - 2 * shared


def prefix(n: int, threshold: int) -> int:
    """Tokens of a set of n of which one at least is shared with any set that links."""
    return n - -(-threshold * n // 100) + 1


def _summaries(words: int):
    """(doc_id, mark, n, class, sketch) for each row, and (token, n) for tokens that are often met, under a null class."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = [(len(s), int(class_of(s)), sketch(s).tobytes()) for s in map(_hold(held), shingle_sets(text_bytes(batch.column(2)), words))]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)), pa.nulls(len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "mark", "n", "class", "token", "sketch"])
            size = sum(map(len, held))
            if size > LOCAL:
                yield _often(held)
                held.clear()
        yield _often(held)

    return sums


def _hold(held: list[np.ndarray]):
    def hold(s: np.ndarray) -> np.ndarray:
        held.append(s)
        return s

    return hold


def _often(held: list[np.ndarray]) -> pa.RecordBatch:
    tokens, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
    tokens, n = tokens[n >= OFTEN], n[n >= OFTEN]
    none = pa.nulls(len(n), pa.int64())
    columns = [none, none, pa.array(n.astype(np.int64)), none, pa.array(signed(tokens)), pa.nulls(len(n), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "class", "token", "sketch"])


def _prefixes(words: int, threshold: int, frequent, buckets: int):
    """Prefix tokens under the first order, once for each class in a task: (bucket, tokens, classes, sizes, places)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = frequent.value, set()
        for batch in batches:
            parts = [[], [], [], []]
            for s in shingle_sets(text_bytes(batch.column(0)), words):
                own = int(class_of(s))
                if not len(s) or own in seen:
                    continue
                seen.add(own)
                p = ranked(s, common, ORDERS[0])[: prefix(len(s), threshold)]
                for part, x in zip(parts, (p, np.full(len(p), own, np.uint64), np.full(len(p), len(s), np.int32), np.arange(len(p), dtype=np.int32)), strict=True):
                    part.append(x)
            if parts[0]:
                columns = [np.concatenate(x) for x in parts]
                yield by_bucket((mixed(columns[0], 9) % np.uint64(buckets)).astype(np.int64), columns, ["tokens", "classes", "sizes", "places"])

    return prefixes


def _fits(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, threshold: int) -> np.ndarray:
    """Sizes and the places of the first shared token allow a link: at most what follows it is shared."""
    least, most = np.minimum(n1, n2), np.maximum(n1, n2)
    shared = np.minimum(n1 - p1, n2 - p2).astype(np.int64)
    return (100 * least.astype(np.int64) >= threshold * most) & (100 * shared >= threshold * (n1.astype(np.int64) + n2 - shared))


def _stars(threshold: int):
    """(a, b): members with their group's first; and as (group, a, n, place) the groups of three or more."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, classes, sizes, places in gathered(batches, (np.uint64, np.uint64, np.int32, np.int32)):
            order = np.lexsort((classes, places, tokens))
            tokens, classes, sizes, places = tokens[order], classes[order], sizes[order], places[order]
            once = np.r_[True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])][: len(tokens)]
            tokens, classes, sizes, places = tokens[once], classes[once], sizes[once], places[once]
            start = np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)]
            group = np.cumsum(start) - 1
            first = np.flatnonzero(start)
            count = np.bincount(group) if len(group) else group
            hub = first[group] if len(group) else group
            pair = ~start & _fits(sizes, places, sizes[hub], places[hub], threshold)
            pairs = np.unique(np.stack([classes[hub[pair]], classes[pair]]), axis=1)
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(signed(pairs[0].copy())), pa.array(signed(pairs[1].copy())), none, none, none], ["a", "b", "group", "n", "place"])
            large = count[group] > 2 if len(group) else np.zeros(0, bool)
            if large.any():
                # groups with the same members are one, with each member's lowest place
                with np.errstate(over="ignore"):
                    name = np.add.reduceat(mixed(classes, 21), first)[group][large]
                c, n, p = classes[large], sizes[large], places[large]
                order = np.lexsort((p, c, name))
                c, n, p, name = c[order], n[order], p[order], name[order]
                keep = np.r_[True, (name[1:] != name[:-1]) | (c[1:] != c[:-1])]
                none = pa.nulls(int(keep.sum()), pa.int64())
                columns = [pa.array(signed(c[keep])), none, pa.array(signed(name[keep])), pa.array(n[keep].astype(np.int64)), pa.array(p[keep].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "group", "n", "place"])

    return stars


def _across(threshold: int, matcher):
    """(a, b): members of a group that are in different components and may link. Rows come sorted by group and task.

    ``matcher`` takes a cell's sketches, sizes, threshold and group, and gives a function that tells which of some members may link with one.
    """

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if _group_at(batch, 0) != _group_at(batch, -1) or _group_at(held[0], 0) != _group_at(batch, 0):
                table = pa.Table.from_batches(held)
                group, task = table.column(0).to_numpy(), table.column(1).to_numpy()
                cut = int(np.flatnonzero((group == group[-1]) & (task == task[-1]))[0])
                yield from _cross(table.slice(0, cut), threshold, matcher)
                held = table.slice(cut).to_batches()
        if held:
            yield from _cross(pa.Table.from_batches(held), threshold, matcher)

    return across


def _group_at(batch: pa.RecordBatch, i: int) -> tuple:
    return batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def _cross(table: pa.Table, threshold: int, matcher) -> Iterator[pa.RecordBatch]:
    group, task, a, n, place, label, is_end, is_other = (table.column(i).to_numpy() for i in range(8))
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (task[1:] != task[:-1])][: len(group)])
    for s, e in zip(starts, np.r_[starts[1:], len(group)][: len(starts)], strict=True):
        ends = s + np.flatnonzero(is_end[s:e])
        if not len(ends):
            continue
        own, near = label[s:e], matcher(table.column(8).slice(s, e - s).to_pylist(), n[s:e], threshold, group[s])
        for i in ends:
            other = np.flatnonzero(is_other[s:e] & (own != label[i]) & _fits(n[i : i + 1], place[i : i + 1], n[s:e], place[s:e], threshold))
            other = s + near(i - s, other)
            if len(other):
                b = a[other]
                pairs = np.minimum(a[i], b), np.maximum(a[i], b)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])


def _parity_bits(blobs: list[bytes], n: np.ndarray, threshold: int, group: int = 0):
    """Members whose parity bits allow a link."""
    sketches = [np.frombuffer(x, np.uint64) for x in blobs]
    width = np.array([len(x) for x in sketches])
    row, by_width = np.zeros(len(blobs), np.int64), {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        row[at], by_width[int(w)] = np.arange(len(at)), np.stack([sketches[j] for j in at])

    def near(i: int, other: np.ndarray) -> np.ndarray:
        found = [other[:0]]
        for w in np.unique(width[other]):
            at = other[width[other] == w]
            found.append(at[_may_link(sketches[i], n[i], by_width[int(w)][row[at]], n[at], threshold)])
        return np.concatenate(found)

    return near


def _compared(batches: Iterator[pa.RecordBatch], threshold: int, holds, made) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) for which ``holds(hub, other)``. Rows (hub, salt, is_hub, class, n, tokens) come sorted, a hub before those it is compared with."""
    hub, kept, size = None, None, 0
    for batch in batches:
        out = []
        for own, _, is_hub, c, n, blob in zip(*batch.to_pydict().values(), strict=True):
            if is_hub:
                if own != hub:
                    hub, kept, size = own, made(n, np.frombuffer(blob, np.uint64)), n
            elif own == hub and c != own and 100 * min(n, size) >= threshold * max(n, size) and holds(kept, made(n, np.frombuffer(blob, np.uint64))):
                out.append((own, c))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def _sketches_near(threshold: int):
    """The parity bits allow a link."""
    return lambda batches: _compared(batches, threshold, lambda x, y: _may_link(*x, *y, threshold), lambda n, bits: (bits, n))


def _prefixes_share(threshold: int):
    """Under a second order: of two prefixes, as many tokens are shared as sets of these sizes must share there to link."""

    def holds(x: tuple, y: tuple) -> bool:
        (n, p), (m, q) = x, y
        least = -(-threshold * (n + m) // (100 + threshold))
        need = max(1, min(len(p) - (n - least), len(q) - (m - least)))
        return len(np.intersect1d(p, q, assume_unique=True)) >= need

    return lambda batches: _compared(batches, threshold, holds, lambda n, tokens: (n, tokens))


def _sets_link(threshold: int, frequent):
    """Under a third order, and then by the sets themselves."""

    def made(n: int, tokens: np.ndarray) -> tuple:
        return tokens, ranked(tokens, frequent.value, ORDERS[2])[: prefix(n, threshold)]

    def holds(x: tuple, y: tuple) -> bool:
        (s, p), (t, q) = x, y
        if not np.isin(p, q, assume_unique=True).any():
            return False
        shared = len(np.intersect1d(s, t, assume_unique=True))
        return 100 * shared >= threshold * (len(s) + len(t) - shared)

    return lambda batches: _compared(batches, threshold, holds, made)


def _where(pairs: DataFrame, sets: DataFrame, compare) -> DataFrame:
    """The pairs that ``compare`` finds. Each set goes once to each hub it is compared with.

    A hub with many sets has several tasks, and a set with many hubs is handed out by
    several: of both, the counts are known before anything moves.
    """
    total = max(1, pairs.count())
    fans = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("fans", F.ceil(F.col("n") / FAN).cast("int"))
    hubs = fans.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.lit(True).alias("is_hub"), F.col("a").alias("class"))
    spokes = attach_groups(pairs.withColumnRenamed("a", "hub"), fans.select(F.col("a").alias("hub"), "fans", "n"), "hub", "n", total)
    spokes = spokes.select("hub", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("salt"), F.lit(False).alias("is_hub"), F.col("b").alias("class"))
    asked = written(hubs.unionByName(spokes))
    often = asked.groupBy("class").agg(F.count("*").alias("times")).withColumn("shares", F.ceil(F.col("times") / FAN).cast("int"))
    often = written(often.filter("shares > 1"))
    few = often.count() <= HEAVY_GROUPS
    wanted = asked.join(F.broadcast(often), "class", "left") if few else attach_groups(asked, often, "class", "times", 2 * total)
    handed = sets.join(F.broadcast(often) if few else often.hint("merge"), "class", "left")
    wanted = wanted.withColumn("share", F.pmod(F.xxhash64("hub", "salt"), F.coalesce("shares", F.lit(1))).cast("int"))
    handed = handed.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    met = wanted.select("hub", "salt", "is_hub", "class", "share").join(handed.select("class", "share", "n", "tokens").hint("merge"), ["class", "share"])
    met = met.select("hub", "salt", "is_hub", "class", "n", "tokens")
    met = met.repartition(partitions(pairs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub"))
    return written(arrow_map(met, compare, "a long, b long"))


def _sets_of(rows: DataFrame, classes: DataFrame, wanted: DataFrame, words: int, cut) -> DataFrame:
    """(class, n, tokens) of the wanted classes, from the document with the least id of each, and of a few others.

    Documents are chosen by a filter of ids of bounded size; a text whose id is not in it is not hashed.
    """
    ids = written(classes.join(wanted.distinct(), "class", "left_semi").select(F.xxhash64("least").alias("h")))
    bits = filter_bits(ids.count())
    filled = rows.sparkSession.sparkContext.broadcast(bitmap_bytes(ids.select(F.expr(f"h & {bits - 1}").alias("slot")), bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = in_bitmap(filled.value, batch.column(0).to_numpy().view(np.uint64))
            texts = text_bytes(batch.column(1).filter(pa.array(chosen)))
            out = [(int(np.uint64(class_of(s)).view(np.int64)), len(s), cut(s).tobytes()) for s in shingle_sets(texts, words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["class", "n", "tokens"])

    return arrow_map(rows.select(F.xxhash64("doc_id"), "text"), sets, "class long, n long, tokens binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("class"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Documents link when 100 * shared >= threshold * union of their shingles; component_id is
    the smallest doc_id that can be reached over links. Null, blank and empty texts have no
    shingles and link with nothing: their component_id is their doc_id. Null ids are passed
    over when the smallest is taken, and are the component's id only where all are null.
    Repeated rows are equal sets. Further columns are not read; doc_id must be a whole number.

    Tasks hold one bucket of prefix tokens at a time; the list of frequent tokens (an order's
    hint, 2 MB at most) and the filters of candidates (16 MB at most) are broadcast. Neither
    changes a result. Sets are known by 64-bit hashes of shingles and of sets.
    """
    grouped = _grouped(_marked(docs, id_col, text_col), words, threshold)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return grouped.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text): rows with equal ids and texts have equal marks, and no others as good as surely."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _grouped(rows: DataFrame, words: int, threshold: int) -> DataFrame:
    """(doc_id, mark, n, component, component_id) for every row; component is the same in a group, and null without shingles."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    summed = written(arrow_map(rows, _summaries(words), "doc_id long, mark long, n long, class long, token long, sketch binary"))
    digests = summed.filter("token is null").drop("token", "sketch")
    often = summed.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MOST).select("token").collect()
    frequent = sc.broadcast(np.sort(np.array([r.token for r in often], np.int64).view(np.uint64)))
    total, tokens = digests.agg(F.count("*"), F.sum("n")).first()
    filled = summed.filter("token is null and n > 0").groupBy("class")
    classes = written(filled.agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    buckets = max(partitions(spark), (tokens or 0) * (100 - threshold) // 100 // 400_000)
    firsts = arrow_map(rows.select("text"), _prefixes(words, threshold, frequent, buckets), "bucket int, tokens binary, classes binary, sizes binary, places binary")
    met = written(dealt(firsts, "bucket").mapInArrow(_stars(threshold), "a long, b long, group long, n long, place long"))
    pairs = met.filter("group is null").select("a", "b").distinct()
    # groups of the same members come from several buckets
    groups = met.filter("group is not null").groupBy("group", "a").agg(F.first("n").alias("n"), F.min("place").alias("place"))
    sketches = classes.select("class", "n", F.col("sketch").alias("tokens"))

    def head(tokens: np.ndarray) -> np.ndarray:
        return np.sort(ranked(tokens, frequent.value, ORDERS[1])[: prefix(len(tokens), threshold)])

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.distinct())
        near = _where(pairs, _sets_of(rows, classes, _ends(pairs), words, head), _prefixes_share(threshold))
        return _where(near, _sets_of(rows, classes, _ends(near), words, lambda tokens: tokens), _sets_link(threshold, frequent))

    links = linked(_where(written(pairs), sketches, _sketches_near(threshold)))
    across = _pairs_across(groups, components(links), classes.select("class", "sketch"), threshold, _parity_bits)
    if not across.isEmpty():
        links = links.unionByName(linked(across))
    return _with_components(digests, classes, links, total)


def _pairs_across(groups: DataFrame, labels: DataFrame, sketches: DataFrame, threshold: int, matcher) -> DataFrame:
    """(a, b) in different components, of the members (group, a, n, place) of a group, that ``matcher`` finds by their sketches."""
    labelled = written(groups.join(labels.withColumnRenamed("id", "a"), "a", "left").select("group", "a", "n", "place", F.coalesce("component", "a").alias("label")))
    # every pair across labels has an end outside one of the largest label's members; these ends are dealt out
    counts = labelled.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"))
    mixed_groups = counts.filter("members > most").withColumn("rows", F.ceil((F.col("members") - F.col("most")) / SHARE).cast("int"))
    mixed_groups = written(mixed_groups.withColumn("columns", F.ceil(F.col("members") / SHARE).cast("int")).drop("most"))
    met_groups = attach_groups(labelled, mixed_groups, "group", "members", labelled.count()).filter("main is not null")
    # a group's tasks are a table: an end goes to all tasks of its row, and each member, to be compared with, to all of its column
    end, row, column = F.col("label") != F.col("main"), F.pmod(F.xxhash64("a"), F.col("rows")), F.pmod(F.xxhash64("a", F.lit(1)), F.col("columns"))
    placed = met_groups.withColumn("end", end).withColumn("row", row).withColumn("column", column)
    cells = lambda n, row, column, is_end, other: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct((row(k) * F.col("columns") + column(k)).cast("long").alias("task"), is_end(k).alias("is_end"), F.lit(other).alias("is_other")))
    others = cells("rows", lambda k: k, lambda k: F.col("column"), lambda k: F.col("end") & (k == F.col("row")), True)
    own = F.filter(cells("columns", lambda k: F.col("row"), lambda k: k, lambda k: F.col("end"), False), lambda c: F.col("end") & (c.task != F.col("row") * F.col("columns") + F.col("column")))
    ends = placed.withColumn("cell", F.explode(F.concat(others, own))).select("group", "a", "n", "place", "label", "cell.*")
    ends = ends.join(sketches.withColumnRenamed("class", "a"), "a").select("group", "task", "a", "n", "place", "label", "is_end", "is_other", "sketch")
    return written(dealt(ends, "group", "task").mapInArrow(_across(threshold, matcher), "a long, b long"))


def _with_components(digests: DataFrame, classes: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """``digests`` with component and component_id, from the links between classes; null for the class of those without shingles."""
    labels = components(links).withColumnRenamed("id", "class")
    known = classes.select("class", "least", "copies").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"))
    named = written(attach_groups(known, least, "component", "sets", total).select("class", "component", "component_id", "copies"))
    return attach_groups(digests, named, "class", "copies", total).drop("class", "copies")


def one_of_each(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, with all columns, and every row without shingles.

    The row with the smallest doc_id stays (a null one only where all are null); of several with it, one.
    Rows are known by their id and a hash of their text; repeated rows, of which one stays, differ in nothing that
    chooses between them. Ids may clash or be null: each row is judged by its own text.
    """
    grouped = written(_grouped(_marked(docs, id_col, text_col), words, threshold))
    alike = grouped.filter("component is not null").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("copies"))
    first = alike.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "copies")).alias("row")).select("row.*")
    alone = grouped.filter("component is null").select("doc_id", "mark").distinct().withColumn("copies", F.lit(1).cast("long"))
    stay = written(first.drop("last").unionByName(alone).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("copies").alias("_copies")))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kept = kept.withColumn("_at", F.xxhash64(F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")).cast("binary")))
    own = (F.col("_at") == F.col("_mark")) & F.col(f"doc.`{id_col}`").cast("long").eqNullSafe(F.col("_id"))
    once = kept.join(stay.filter("_copies = 1"), own, "left_semi").select("doc.*")
    several = stay.filter("_copies > 1")
    if several.isEmpty():
        return once
    return once.unionByName(kept.join(several, own).dropDuplicates(["_id", "_mark"]).select("doc.*"))
