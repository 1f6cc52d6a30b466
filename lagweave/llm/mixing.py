"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order, null last, get the weights in turn; they
share all words by weight, no source gets more than ``max_copies`` times its
words, and the excess is shared anew by weight (closed form: one level that
fills up, sources taken in order of their cap per weight).

Copies: a source takes target / source size copies of all its documents, of which
the whole part is certain. The words that it then lacks are drawn with inclusion
probabilities in proportion to a document's own words, min(1, c * words): documents
that reach 1 are certain once more, and c makes the expected words those that are
lacking. The others are taken in order of ``u/(1-u) * (1-p)/p``, their random odds
divided by their inclusion odds, as long as their words fit: a sample of fixed
size, in words. u is made of the id, so reruns agree. Last, of the documents not
taken, the one whose words come nearest to what is still lacking is taken, if that
is nearer than none.

c comes from sums over the sizes that occur in a source. The cut in the order is
found by sums over bins of the ranking variable, refined twice, never by sorting
a source: each pass pre-aggregates before its shuffle, and only the rows of one
bin in 2**28 are ordered together. A source that holds any part of all rows is no
special case.

Nulls: a null text has no words and takes part with 0; a null source is a source
of its own. Rows that repeat an id rank alike and are taken together. An empty
table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
BITS = 14


def n_words(text: Column) -> Column:
    """The number of words; null has none. Words are what is left between runs of the six separators."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(flat, F.lit("[^ ]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], max_copies: float) -> DataFrame:
    """source, source_size, target of each row of sizes (source, source_size); as many rows as there are sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * max_copies)
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything)).withColumn("all_w", F.sum("w").over(everything))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("at", F.row_number().over(fill)).withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    rows = rows.withColumn("flood", F.min(F.when(F.col("open"), F.struct("at", "level"))).over(everything)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("flood") * F.col("w")), F.col("cap")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1, made of the first 13 hex digits of an MD5."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["of"])


def _ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (id, source, size, ...) with their source's plan, the ranking variable q (null: not sampled) and its bins."""
    u = uniform(F.col("id"), seed)
    rows = rows.join(plan, _same(rows, plan)).drop("of").withColumn("p", F.least(F.lit(1.0), F.col("c") * F.col("size")))
    rank = F.when(F.col("p") > 0, F.when(F.col("p") < 1, u / (1 - u) * ((1 - F.col("p")) / F.col("p"))).otherwise(0.0))
    share = F.col("q") / (1 + F.col("q"))
    return rows.withColumn("q", rank).withColumn("b1", F.floor(share * (1 << BITS)).cast("int")).withColumn("b2", (F.floor(share * (1 << 2 * BITS)) % (1 << BITS)).cast("int")).drop("c", "p")


def inclusion(skinny: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with c: the sum of min(1, c * size) * size over a source's documents is what it lacks; 0 where it lacks nothing.

    Sizes in descending order; those from some size on are certain, and c is what
    the others' squares need. The window has a row for each size that occurs.
    """
    tally = skinny.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words, square = F.col("size") * F.col("n"), (F.col("size").cast("double") * F.col("size")) * F.col("n")
    tally = tally.withColumn("certain", F.coalesce(F.sum(words).over(down), F.lit(0))).withColumn("squares", F.sum(square).over(up))
    tally = tally.join(plan.select("of", "lack"), tally["source"].eqNullSafe(F.col("of")))
    tally = tally.withColumn("c", (F.col("lack") - F.col("certain")) / F.col("squares"))
    best = tally.where((F.col("lack") > 0) & (F.col("c") * F.col("size") <= 1)).groupBy(F.col("of").alias("of2")).agg(F.max_by("c", "size").alias("c"))
    return plan.join(best, F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2").withColumn("c", F.when(F.col("lack") > 0, F.coalesce("c", F.lit(1.0))).otherwise(0.0))


def plan_mix(skinny: DataFrame, weights: tuple[float, ...], max_copies: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, source, size): each source's target with its certain copies and c, and where its sample ends."""
    sizes = skinny.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.least(F.floor(ratio), F.lit(max_copies)).cast("long")).withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("lack", F.when(F.col("whole") < max_copies, F.greatest("lack", F.lit(0.0))).otherwise(0.0))
    plan = kept(inclusion(skinny, kept(plan.withColumnRenamed("source", "of"), "mix-targets", one_file=True)), "mix-plan", one_file=True)
    ranked = _ranked(skinny, plan, seed).where(F.col("q").isNotNull() & (F.col("size") > 0))
    open_rows, cut = ranked, plan.select("of", "lack")
    for k, b in enumerate(("b1", "b2"), 1):
        held = open_rows.groupBy("source", b).agg(F.sum("size").alias("held"))
        so_far = Window.partitionBy("source").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("before", F.coalesce(F.sum("held").over(so_far), F.lit(0)))
        at = held.join(cut, _same(held, cut)).where((F.col("before") <= F.col("lack")) & (F.col("lack") < F.col("before") + F.col("held")))
        # A source without a cut lacks all that it has (sums of doubles may leave a hair): all of it is taken.
        cut = kept(at.select("of", (F.col("lack") - F.col("before")).alias("lack"), F.col(b).alias(f"c{k}"), *[f"c{j}" for j in range(1, k)]), f"mix-cut{k}", one_file=True)
        own = cut.select("of", f"c{k}")
        open_rows = open_rows.join(own, _same(open_rows, own) & (open_rows[b] == own[f"c{k}"])).drop("of", f"c{k}")
    last = open_rows.groupBy("source", "q", "id").agg(F.sum("size").alias("held"))
    so_far = Window.partitionBy("source").orderBy("q", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.sum("held").over(so_far))
    last = last.join(cut.select("of", F.col("lack").alias("left")), last["source"].eqNullSafe(F.col("of"))).where(F.col("upto") <= F.col("left"))
    edge = last.groupBy(F.col("of").alias("of2")).agg(F.max(F.struct("q", "id")).alias("edge"), F.max("upto").alias("upto"))
    cut = cut.join(edge, F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2")
    cut = kept(cut.withColumn("lack", F.col("lack") - F.coalesce("upto", F.lit(0))).drop("upto"), "mix-edge", one_file=True)
    # What is still lacking: the one document that comes nearest.
    rest = ranked.drop("lack").join(cut, _same(ranked, cut)).where(~_inside()).groupBy("of", "lack", "q", "id").agg(F.sum("size").alias("held"))
    rest = rest.withColumn("off", F.abs(F.col("held") - F.col("lack"))).where(F.col("off") < F.col("lack"))
    fill = rest.groupBy(F.col("of").alias("of2")).agg(F.min(F.struct("off", "q", "id"))["id"].alias("id"))
    fill = fill.select("of2", F.struct("id").alias("fill"))
    return plan, kept(cut.drop("lack").join(fill, F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2"), "mix-fill", one_file=True)


def _inside() -> Column:
    """Whether a ranked row with its source's cut comes before it, or is the cut's last one."""
    there = (F.col("b2") < F.col("c2")) | ((F.col("b2") == F.col("c2")) & F.coalesce(F.struct("q", "id") <= F.col("edge"), F.lit(False)))
    return F.col("c1").isNull() | (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & there)


def _copies(rows: DataFrame, plan: DataFrame, cut: DataFrame, seed: int) -> DataFrame:
    """rows (id, source, size, ...) with their source's plan and the number of copies that the mix takes. Both tables have a row for each source, whose rows they meet in a map or a join that may be split."""
    rows = _ranked(rows, plan, seed)
    rows = rows.join(cut, _same(rows, cut), "left").drop("of")
    taken = _inside() | F.coalesce(F.col("fill").isNotNull() & F.col("fill.id").eqNullSafe(F.col("id")), F.lit(False))
    return rows.withColumn("copies", F.col("whole") + F.when(F.col("q").isNotNull() & taken, 1).otherwise(0)).drop("whole", "lack", "q", "b1", "b2", "c1", "c2", "edge", "fill")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 7) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words the mix takes of it)."""
    skinny = kept(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "mix-sizes")
    plan, cut = plan_mix(skinny, weights, max_copies, seed)
    return _copies(skinny, plan, cut, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 7) -> DataFrame:
    """The rows of the mix, with all columns of docs; a row is there as often as it is taken. Texts aren't shuffled."""
    skinny = kept(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "mix-sizes")
    plan, cut = plan_mix(skinny, weights, max_copies, seed)
    rows = _copies(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), plan, cut, seed)
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
