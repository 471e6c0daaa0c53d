"""Mix sources to target weights by capped water-filling and seeded repetition (operator 10).

1. Sizes: words of each document, summed per source.
2. Water-filling: every source wants its share of the total by weight; a source whose share is above
   ``max_epochs`` times its size is clamped there, and what it leaves is reshared by weight among the
   others, until none is above.
3. Sampling: a source with target T and size S takes every document floor(T / S) times. The remainder
   is a seeded fraction: documents in the order of a keyed MD5 are taken once more while the middle
   of their words lies below the remaining amount, which misses the target by half a document at most.
   Then the one document per source whose size is closest to what is still missed is added or left
   out, if that helps: small sources with a few long documents come near their target too.

The order statistic needs no sort of a source in one task. MD5 values (of doc_id and a digest of the text)
are dealt into ``BINS`` equal bins; bin sums per source (partial aggregation before the shuffle) locate the
bin in which the target is crossed. Only that bin's draws are ordered by a window, after rows of one draw
have collapsed into one with their number, which gives the one draw per source at which the target is
crossed. All other rows are decided by comparison with it; its own rows, if some are taken and some not, are
numbered in slices.

Defined cases: null text has size 0; null source is a source, last in the order of weights; a null doc_id
draws as the empty string; rows that share a doc_id but not the text have draws of their own; rows repeated
as a whole share one, are documents of their own all the same, and as many of them are taken as come near
the target; the correction toggles one row; sources of size 0 have target 0; an empty table gives an empty
result; a text of any length is counted in the JVM; further columns are kept by ``mix_documents``, whatever
they are called. Sizes are counted in one pass over the texts and kept in the shared folder, with the place
of each row, as later steps read them several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import WORD
from corpuslab.session import materialise

#: Hex digits of the MD5 that name a bin.
BIN_DIGITS = 3
BINS = 16**BIN_DIGITS
#: Slices in which the rows of a draw are numbered, where not all of them are taken alike.
SLICES = 1024


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size) to (source, source_size, target), exactly, without a loop.

    A source is clamped when its fill level max_epochs * size / weight lies below the water level. In
    the order of fill levels, the clamped ones are a prefix: source i is clamped if the level that
    would hold were all before it clamped is above its own. Sources are one row each, so the window
    over all of them sees the source list, not the corpus.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("clamped", F.col("left") * F.col("weight") > F.col("cap") * F.col("open"))
    )
    # the level that holds: that of the first source, in this order, which is not clamped
    level = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), (F.col("left") / F.col("open")).alias("level")))).over(everything)["level"]
    return filled.select(
        "source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level)).alias("target")
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _repeated(documents: DataFrame, kept: list[str], max_epochs: int, weights: tuple[int, ...], seed: str) -> DataFrame:
    """(row: the columns to keep, size, source_size, target, repetitions) of every document."""
    draw = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    sized = documents.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("source").alias("source"), word_count("text").alias("size"), draw.alias("draw"))
    # the place of a row is fixed by writing it
    docs = materialise(sized.withColumn("place", F.monotonically_increasing_id()), "sizes").withColumn("bin", F.substring("draw", 1, BIN_DIGITS))
    bins = materialise(docs.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    targets = water_fill(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), max_epochs, weights).withColumnRenamed("source", "plan_source")
    # words that remain after the whole repetitions; the bin in which their number is crossed
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialise(
        bins.join(targets, _same("source", "plan_source"))
        .drop("plan_source")
        .withColumn("before", F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bin_size"))
        .groupBy("source")
        .agg(
            F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("whole").alias("whole"), F.first("rest").alias("rest"),
            F.max(F.when(F.col("before") <= F.col("rest"), F.struct("bin", "before"))).alias("cut"),
        )
        .withColumnRenamed("source", "plan_source"),
        "plan",
    )
    # the draws of each source's cut bin, with the number of their rows of which the middle lies below the rest
    at_cut = docs.select("source", "size", "draw", "bin").join(plan, _same("source", "plan_source")).filter(F.col("bin") == F.col("cut.bin"))
    draws = at_cut.groupBy("source", "draw").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("cut.before").alias("bin_before"))
    own = F.col("size") * F.col("n")
    before = F.col("bin_before") + F.sum(own).over(Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)) - own
    first_fits = before + F.col("size") / F.lit(2.0) < F.col("rest")
    fit = F.when(~first_fits, 0).when((F.col("n") == 1) | (F.col("size") == 0), F.col("n")).otherwise(F.least("n", F.ceil((F.col("rest") - before) / F.col("size") - 0.5)))
    crossed = draws.withColumn("fit", fit.cast("long")).filter("fit < n").groupBy("source").agg(F.min(F.struct("draw", "fit")).alias("crossed")).withColumnRenamed("source", "crossed_source")
    plan = materialise(plan.join(crossed, _same("plan_source", "crossed_source"), "left").drop("crossed_source"), "plan")
    joined = docs.join(plan, _same("source", "plan_source")).drop("plan_source")
    last = F.coalesce("crossed.draw", F.concat("cut.bin", F.lit("g")))  # behind all hex digits: the whole bin is taken
    split = (F.col("draw") == F.col("crossed.draw")) & (F.col("crossed.fit") > 0)
    split = F.coalesce(split, F.lit(False))
    taken = (F.col("draw") < last).cast("long")

    def decided(columns: list[str]) -> DataFrame:
        """The rows with extra, 0 or 1; those of a draw that is taken in part are numbered, slice by slice."""
        rows = joined.select("source", "size", "draw", "place", "source_size", "target", "whole", "rest", "crossed", split.alias("split"), taken.alias("extra"), *columns)
        part = rows.filter("split").withColumn("slice", F.pmod(F.xxhash64("place"), F.lit(SLICES)))
        slices = part.groupBy("source", "draw", "slice").agg(F.count(F.lit(1)).alias("n"))
        ahead = F.sum("n").over(Window.partitionBy("source", "draw").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        slices = slices.select(F.col("source").alias("slice_source"), F.col("draw").alias("slice_draw"), F.col("slice").alias("slice_number"), ahead.alias("ahead"))
        here = part.join(slices, _same("source", "slice_source") & (F.col("draw") == F.col("slice_draw")) & (F.col("slice") == F.col("slice_number")))
        number = F.col("ahead") + F.row_number().over(Window.partitionBy("source", "draw", "slice").orderBy("place"))
        numbered = here.withColumn("extra", (number <= F.col("crossed.fit")).cast("long")).select(*rows.columns)
        return rows.filter("NOT split").unionByName(numbered)

    small = decided([])
    missed = small.groupBy("source").agg((F.first("rest") - F.sum(F.col("size") * F.col("extra"))).alias("miss")).withColumnRenamed("source", "miss_source")
    # the row that is toggled: one not taken where words are missing, one taken where there are too many
    candidates = small.join(missed, _same("source", "miss_source")).withColumn("still", F.abs(F.abs("miss") - F.col("size")))
    toggles = materialise(
        candidates.filter((F.col("still") < F.abs("miss")) & (F.col("extra") == F.when(F.col("miss") > 0, 0).otherwise(1)))
        .groupBy("source")
        .agg(F.min(F.struct("still", "draw", "place"))["place"].alias("toggle"))
        .withColumnRenamed("source", "toggle_source"),
        "toggles",
    )
    extra = F.when(F.col("place") == F.col("toggle"), 1 - F.col("extra")).otherwise(F.col("extra"))
    return decided(["row"]).join(toggles, _same("source", "toggle_source"), "left").select("row", "size", "source_size", "target", (F.col("whole") + extra).alias("repetitions"))


def mix(documents: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), repetitions, taken."""
    found = _repeated(documents, ["doc_id", "source"], max_epochs, weights, seed)
    return found.select("row.doc_id", "row.source", "size", "source_size", "target", "repetitions", (F.col("size") * F.col("repetitions")).alias("taken"))


def mix_documents(documents: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: each document as many times as the mix takes it, all columns kept.

    The rows are written once with their sizes; texts are not shuffled.
    """
    found = _repeated(documents, documents.columns, max_epochs, weights, seed)
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("repetitions").cast("int")))).select("row.*")


#: The same rows in DuckDB SQL, for max_epochs 3, weights 1, 2, 3 and seed "mix".
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT source, source_size, CAST(3 * source_size AS DOUBLE) AS cap,
         CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM sources),
filled AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_of_all,
         sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM ranked),
levels AS (
  SELECT min(struct_pack(fill := cap / weight, level := rest_of_all / open_weight)) AS l FROM filled WHERE NOT rest_of_all * weight > cap * open_weight),
targets AS (
  SELECT source, source_size, CASE WHEN rest_of_all * weight > cap * open_weight THEN cap ELSE least(cap, weight * (SELECT l.level FROM levels)) END AS target
  FROM filled),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n FROM targets),
ordered AS (
  SELECT d.doc_id, d.source, d.size, d.draw, w.source_size, w.target, w.n, w.target - w.n * w.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0 AS middle
  FROM docs d JOIN whole w ON d.source IS NOT DISTINCT FROM w.source),
decided AS (
  SELECT *, CASE WHEN middle < rest THEN 1 ELSE 0 END AS extra FROM ordered),
missed AS (
  SELECT *, rest - sum(size * extra) OVER (PARTITION BY source) AS miss, row_number() OVER (PARTITION BY source, draw, extra) AS copy FROM decided),
toggles AS (
  SELECT source, min(struct_pack(still := abs(abs(miss) - size), draw := draw, extra := extra)) AS t
  FROM missed WHERE abs(abs(miss) - size) < abs(miss) AND extra = CASE WHEN miss > 0 THEN 0 ELSE 1 END GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target,
       CAST(d.size * (d.n + CASE WHEN d.draw = t.t.draw AND d.extra = t.t.extra AND d.copy = 1 THEN 1 - d.extra ELSE d.extra END) AS BIGINT) AS taken
FROM missed d LEFT JOIN toggles t ON d.source IS NOT DISTINCT FROM t.source
"""
