"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions alone.

The first pass counts how many documents hit each slot of the filter and keeps, as
bitmaps, the slots hit twice or more. In the second pass a document is possibly
repeated only if all of its slots are such; those rows alone are shuffled, and the
rest pass straight through. What is broadcast is the filter: 16 bits a document for
each of its two slots, 32 MB at most. A fuller filter sends more rows through the shuffle, of
digests alone where groups are asked for, and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm._shared import BITMAP_BITS, ascii_lower, attach_groups, bitmap_table, filter_bits, written

#: Slots of a document in the filter.
SLOTS = 2


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case, in lowercase hex; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _slot(digest: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits).cast("long"))


def possibly_repeated(digests: DataFrame, bits: int) -> DataFrame:
    """Bitmaps (bucket, bits) of the slots that two documents or more hit; the k-th slots of documents follow one another, ``bits`` for each k."""
    slots = F.explode(F.array(*[_slot(F.col("digest"), k, bits) + k * bits for k in range(SLOTS)]))
    hits = digests.select(slots.alias("slot")).groupBy("slot").count().filter("count > 1")
    return written(bitmap_table(hits))


def mark_suspects(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """``rows`` with column ``suspect``; the bitmaps are broadcast, SLOTS * bits / 8 bytes at most."""
    hit, names = F.lit(True), rows.columns
    for k in range(SLOTS):
        named = bitmaps.select(F.col("bucket").alias(f"_b{k}"), F.col("bits").alias(f"_m{k}"))
        rows = rows.withColumn(f"_s{k}", _slot(F.col("digest"), k, bits) + k * bits)
        rows = rows.join(F.broadcast(named), F.expr(f"_s{k} div {BITMAP_BITS}") == F.col(f"_b{k}"), "left")
        at = F.col(f"_s{k}") % BITMAP_BITS
        byte = F.conv(F.hex(F.substring(F.col(f"_m{k}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = hit & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.select(*names, hit.alias("suspect"))


def keepers(suspects: DataFrame, tie: Column) -> DataFrame:
    """(digest, keep_id, keep_tie, group_size): counted before the shuffle, so a hot text is a row for each task.

    The largest doc_id stays, a null one only if all are; of those with it, the least ``tie``.
    """
    most = F.max(F.struct("doc_id", (-tie).alias("tie"))).alias("most")
    groups = suspects.groupBy("digest").agg(most, F.count("*").alias("group_size"))
    return written(groups.select("digest", F.col("most.doc_id").alias("keep_id"), (-F.col("most.tie")).alias("keep_tie"), "group_size"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of rows with equal texts the largest doc_id stays; a null doc_id is below all
    others. Of repeated rows, equal in doc_id and text, one is kept. Null and empty
    texts are one group. Further columns are not read. One pass over the texts makes
    a table of digests; all else works on that. A hot text's group is one row, broadcast.
    """
    digests = written(
        docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    total = digests.count()
    bits = filter_bits(total)
    marked = written(mark_suspects(digests, possibly_repeated(digests, bits), bits))
    once = marked.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256")
    )
    suspects = marked.filter("suspect").drop("suspect")
    met = attach_groups(suspects, keepers(suspects, F.col("row")), "digest", "group_size", total)
    return once.unionByName(met.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_tie")).alias("kept"), F.col("digest").alias("text_sha256")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns.

    Same rule as duplicate_groups. Rows outside the filter pass without a shuffle. Of
    the others, those that are not their group's keeper go once the keepers, of which a
    hot group's is broadcast, are known; repeated rows of a keeper become one.
    """
    names = docs.columns
    rows = docs.withColumn("digest", text_digest(F.col(text_col)))
    digests = written(rows.select(F.col(id_col).alias("doc_id"), "digest"))
    total = digests.count()
    bits = filter_bits(total)
    bitmaps = possibly_repeated(digests, bits)
    groups = keepers(mark_suspects(digests, bitmaps, bits).filter("suspect"), F.lit(0))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    packed = packed.withColumn("digest", text_digest(F.col(f"doc.`{text_col}`"))).withColumn("doc_id", F.col(f"doc.`{id_col}`"))
    marked = mark_suspects(packed, bitmaps, bits)
    once = marked.filter("not suspect").select("doc")
    chosen = attach_groups(marked.filter("suspect").drop("suspect"), groups, "digest", "group_size", total)
    chosen = chosen.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return once.unionByName(chosen.dropDuplicates(["digest"]).select("doc")).select("doc.*")
