"""Exact dedup by deterministic naming: blocks get integer names, pairs of names get names, until a document has one.

Texts are compared without white space. Each text is cut into blocks of ``BLOCK`` characters. Equal blocks, and only they, get
the same integer: the number of their first occurrence in sort order (row number, then position). Then each pair of adjacent
names gets a name in the same way, round by round. After all rounds a text has one integer, and two texts with the same number
of blocks are equal if and only if their integers are. Block contents decide, not hashes; a hash only carries a block's name
back to its occurrences, and contents are compared again where two different blocks share one.

DataFrame functions only. A frequent block or pair is counted down before it is moved, and carried back by an equality join
with a stored table, which adaptive execution splits.

Edge cases: null counts as empty; an empty text is one empty block. Rows are told apart by number, so repeated rows and null
ids are rows of their own; of rows that tie in length and id the first by row number stays. Null ids come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES, saved, text_or_empty

BLOCK = 4096


def numbered_blocks(docs: DataFrame, size: int) -> DataFrame:
    """One stored row per document: its number, id, length, digest and blocks. The store fixes the numbers."""
    text = F.translate(text_or_empty(), SPACES, "")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long"),
        F.length(text_or_empty()).cast("long").alias("n_points"),
        text.alias("bare"),
    )
    count = F.greatest(F.lit(1), F.ceil(F.length("bare") / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("bare", i * size + 1, F.lit(size)))
    return saved(rows.select("rid", "doc_id", "n_points", F.sha2("bare", 256).alias("text_sha256"), count.alias("n_blocks"), cut.alias("blocks")), "blocks")


def _block_names(blocks: DataFrame) -> DataFrame:
    """(rid, pos, name) of all blocks (rid, pos, block)."""
    blocks = blocks.withColumn("h", F.xxhash64("block"))
    # The number of a row is used in this one aggregate only; it depends on the stored rows, so reruns repeat it.
    named = blocks.select("h", "block", F.monotonically_increasing_id().alias("at")).groupBy("h", "block").agg(F.min("at").alias("name"))
    names = saved(named.select("h", "name"), "names")
    shared = saved(names.groupBy("h").count().where("count > 1").select("h"), "shared_hashes")
    plain = blocks.select("rid", "pos", "h").join(names, "h").select("rid", "pos", "name")
    if shared.isEmpty():
        return plain
    told = blocks.join(saved(named.join(shared, "h", "left_semi"), "told"), ["h", "block"]).select("rid", "pos", "name")
    return plain.join(shared.join(names, "h").select("name"), "name", "left_anti").select("rid", "pos", "name").unionByName(told)


def _pair_names(level: DataFrame) -> DataFrame:
    """(rid, pos, name) of the pairs of a level (rid, pos, name, left, right); an odd last name is paired with -1."""
    pairs = level.groupBy("rid", F.shiftright("pos", 1).alias("at")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
    )
    pairs = saved(pairs, "pairs")
    at = F.monotonically_increasing_id().alias("number")
    names = saved(pairs.select("left", "right", at).groupBy("left", "right").agg(F.min("number").alias("name")), "names")
    return pairs.join(names, ["left", "right"]).select("rid", F.col("at").alias("pos"), "name")


def identities(rows: DataFrame) -> DataFrame:
    """(rid, n_blocks, identity) of ``numbered_blocks``: equal (n_blocks, identity) means equal text and the reverse."""
    level = _block_names(rows.select("rid", F.posexplode("blocks").alias("pos", "block")))
    counts = rows.select("rid", "n_blocks")
    level = saved(level.join(counts, "rid"), "level")
    done = level.where("n_blocks = 1").select("rid", "n_blocks", F.col("name").alias("identity"))
    left, width = level.where("n_blocks > 1"), 1
    most = left.agg(F.max("n_blocks")).first()[0] or 1
    while width < most:
        width *= 2
        level = saved(_pair_names(left.select("rid", "pos", "name")).join(counts, "rid"), "level")
        done = done.unionByName(level.where(F.col("n_blocks") <= width).select("rid", "n_blocks", F.col("name").alias("identity")))
        left = level.where(F.col("n_blocks") > width)
    return done


def groups(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``."""
    rows = numbered_blocks(docs, size)
    named = saved(identities(rows), "identities")
    digest = ["rid", "doc_id", "n_points", "text_sha256"]
    full = saved(named.join(rows.select(*digest), "rid"), "named")
    key = ["n_blocks", "identity"]
    down = lambda c: F.coalesce(F.bitwise_not(c), F.lit(-(2**63)))  # noqa: E731  smallest first, null last
    order = F.struct("n_points", down("doc_id").alias("by_id"), down("rid").alias("by_row"), "doc_id")
    keep = saved(full.groupBy(*key).agg(F.max(order).alias("top"), F.count("*").alias("group_size")), "keep")
    kept = F.bitwise_not("top.by_row") == F.col("rid")
    return full.join(keep, key).select(full["doc_id"], F.col("top.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
