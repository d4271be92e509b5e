"""Mixing sources to target weights by entropy balancing.

Each source gets a share of all words by its weight; a target ends at ``most`` times the source's size, and what is cut is
shared again by weight among the others. Document rates r_i are as close to 1 in relative entropy as the constraint
sum(size_i * r_i) = target of the source allows: r_i = min(most, exp(lambda * size_i / mean size)), where lambda solves the
convex dual. Newton steps, kept inside a bracket, run for all sources at once as one aggregate over a (source, size) histogram
each. Rates become whole copies: the whole part, and one more where a hash of the document lies below the fraction plus a
shift of the source; the shift that meets the target to within one document is found by two rounds of histograms. At last a
few rounds give or take a copy of the one document whose size is nearest to the rest.

Edge cases: null texts have size 0 and take 0 words. A source without words has target 0. A null source is a source, ordered
last. Rows with one doc_id are told apart by a hash of the text only, so equal rows are taken alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE_CLASS, SPACES, ranked, saved, text_or_empty

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
STEPS, CLOSE = 40, 1e-9
#: Rounds that give or take one copy of one document of each source at the end.
CORRECTIONS = 3
_CELLS = 4096


def _row():
    return F.xxhash64(text_or_empty()).alias("row")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, size, unit): words of each row, a hash of its text, and a number in [0, 1) from id and text."""
    bare = F.btrim(text_or_empty(), F.lit(SPACES))
    size = F.when(F.length(bare) == 0, 0).otherwise(F.size(F.split(bare, SPACE_CLASS + "+", -1)))
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text_or_empty(), F.lit(10)), F.lit(2**40)) / F.lit(float(2**40))
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), _row(), size.cast("long").alias("size"), unit.alias("unit")
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of ``sources`` (source, source_size): shares by weight, cut at ``most`` sizes."""
    rows = ranked(sources, [F.col("source").asc_nulls_last()], "rank")
    choose = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = saved(rows.select("source", "source_size", choose.alias("weight"), F.lit(False).alias("full")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(float(most))
    while True:
        cut, free = rows.agg(F.sum(F.when(F.col("full"), limit).otherwise(0.0)), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0))).first()
        share = (F.lit(float(total)) - (cut or 0.0)) * F.col("weight") / F.lit(free or 1.0)
        over = ~F.col("full") & (share > limit)
        if not rows.where(over).limit(1).count():
            return rows.select("source", "source_size", F.when(F.col("full"), limit).otherwise(share).alias("target"))
        rows = saved(rows.withColumn("full", F.col("full") | over), "weights")


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null included."""
    b = b.withColumnRenamed("source", "_source")
    return a.join(b, a["source"].eqNullSafe(b["_source"]), how).drop("_source")


def tilts(histogram: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(source, source_size, target, mean, tilt): lambda of each source. ``histogram`` has (source, size, n)."""
    means = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    # A source at its limit needs every rate at the limit, and one without words any rate: both are settled.
    state = _same(goals, means).withColumns({
        "open": (F.col("target") < F.col("source_size") * most * (1 - 1e-12)) & (F.col("target") > 0),
        "low": F.lit(-64.0), "high": F.lit(64.0), "tilt": F.lit(0.0),
    })
    state = saved(state, "tilt")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.lit(50.0), F.col("tilt") * x))
        rate = F.least(F.lit(float(most)), raw)
        words = F.col("size") * F.col("n")
        sums = _same(histogram, state.where("open").select("source", "mean", "tilt")).groupBy("source").agg(
            F.sum(words * rate).alias("got"), F.sum(F.when(raw < most, words * raw * x).otherwise(0.0)).alias("slope")
        )
        step = _same(state, sums, "left")
        miss = F.col("got") - F.col("target")
        near = F.abs(miss) <= F.lit(CLOSE) * F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        moved = F.when(inside, newton).otherwise((low + high) / 2)
        step = step.select(
            "source", "source_size", "target", "mean", (F.col("open") & ~near).alias("open"),
            F.when(F.col("open"), low).otherwise(F.col("low")).alias("low"), F.when(F.col("open"), high).otherwise(F.col("high")).alias("high"),
            F.when(F.col("open") & ~near, moved).otherwise(F.col("tilt")).alias("tilt"),
        )
        state = saved(step, "tilt")
        if not state.where("open").limit(1).count():
            break
    return state.select("source", "source_size", "target", "mean", "tilt")


def _shifts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, shift): rows (source, size, base, turn) take one copy more where turn <= shift, to meet the target.

    ``turn`` lies in [-1, 1). Two rounds of ``_CELLS`` cells leave one document, mostly; of the last cell the side that is
    nearer to the target is taken.
    """
    have = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("base")).alias("have"))
    state = saved(_same(goals, have).select("source", (F.col("target") - F.col("have")).alias("need"), F.lit(-1.0).alias("from")), "shift")
    width = 2.0
    for last in (False, True):
        cell = F.floor((F.col("turn") - F.col("from")) / F.lit(width / _CELLS)).cast("int")
        inside = _same(rows.where("turn is not null"), state).withColumn("cell", cell).where((F.col("cell") >= 0) & (F.col("cell") < _CELLS))
        sums = saved(inside.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells")
        upto = Window.partitionBy("source").orderBy("cell")  # at most _CELLS rows for a source
        run = _same(sums.withColumn("upto", F.sum("words").over(upto)), state)
        # The first cell that reaches the need; the rest of the need is for the cells inside it.
        passed = run.where(F.col("upto") >= F.col("need")).groupBy("source").agg(F.min(F.struct("cell", "upto", "words")).alias("hit"))
        step = _same(state, passed, "left")
        before = F.col("hit.upto") - F.col("hit.words")
        edge = F.when(F.col("hit").isNull(), F.lit(_CELLS)).otherwise(F.col("hit.cell"))
        if last:  # with or without the cell, whichever is nearer
            take = F.col("hit").isNotNull() & (F.col("hit.upto") - F.col("need") < F.col("need") - before)
            edge = edge + take.cast("int")
        state = saved(step.select("source", F.when(F.col("hit").isNull(), F.col("need")).otherwise(F.col("need") - before).alias("need"), (F.col("from") + edge * F.lit(width / _CELLS)).alias("from")), "shift")
        width /= _CELLS
    return state.select("source", F.col("from").alias("shift"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row per row of ``docs``."""
    rows = saved(sized(docs), "sized")
    histogram = saved(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = tilts(histogram, targets(sources, weights, most), most)
    rows = _same(rows, solved)
    at_limit = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    rate = F.when(at_limit, F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("tilt") * F.col("size") / F.col("mean")))))
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).otherwise(rate)
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("int"))
    turn = F.when((F.col("base") < most) & (F.col("size") > 0) & (F.col("target") > 0), F.col("unit") - (F.col("rate") - F.col("base")))
    rows = saved(rows.withColumn("turn", turn).drop("rate", "tilt", "mean", "unit"), "rates")
    shifts = _shifts(rows, solved.select("source", "target"))
    copies = F.col("base") + F.coalesce((F.col("turn") < F.col("shift")).cast("int"), F.lit(0))
    rows = saved(_same(rows, shifts).withColumn("copies", copies).drop("base", "turn", "shift"), "copies")
    for _ in range(CORRECTIONS):
        rows = saved(_corrected(rows, most), "copies")
    return rows.select("doc_id", "source", "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _corrected(rows: DataFrame, most: int) -> DataFrame:
    """Give or take a copy of the one document of each source whose size is nearest to what its target still lacks."""
    gaps = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    gaps = saved(gaps, "gaps")
    able = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    left = F.abs(F.abs("gap") - F.col("size"))
    near = _same(rows, gaps).where(able & (left < F.abs("gap"))).groupBy("source").agg(F.min(F.struct(left.alias("left"), "row", "doc_id", "gap")).alias("best"))
    near = saved(near.select("source", F.col("best.row").alias("best_row"), F.col("best.doc_id").alias("best_id"), F.signum("best.gap").cast("int").alias("sign")), "nearest")
    hit = (F.col("row") == F.col("best_row")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    moved = F.greatest(F.lit(0), F.least(F.lit(most), F.col("copies") + F.when(hit, F.col("sign")).otherwise(0)))
    return _same(rows, near, "left").withColumn("copies", moved).drop("best_row", "best_id", "sign")


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    chosen = mixed(docs).where("copies > 0").groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("row").alias("_mix_row"))
    chosen = saved(chosen.agg(F.max("copies").alias("_mix_copies")), "copies")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_mix_id")) & docs["source"].cast("string").eqNullSafe(F.col("_mix_source"))
    joined = docs.join(chosen, same & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_mix_row")))
    return joined.withColumn("_mix_each", F.explode(F.sequence(F.lit(1), "_mix_copies"))).select(*(docs[c] for c in docs.columns))
