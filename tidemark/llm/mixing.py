"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most `most` times its own size; what is over goes to the others
by weight (`targets`). With ratio = target / size every document gets floor(ratio) whole copies for certain, and what is left of the target is
a sample without replacement of unequal probabilities: a document's inclusion is min(1, c w), w its size rounded down to four
binary digits, with the one c that makes the expected words of the source's sample what is left (`inclusions`). Documents of inclusion 1 are
certain and get one more whole copy. The others are ranked by the odds of their random number over the odds of their inclusion,
(u / (1 - u)) / (p / (1 - p)), and the first ones in that order are taken: the size of the sample is fixed in words, so they are
taken while their words fit, and the words still missing go to the one document left that fits them best.

u comes from MD5 of seed, doc_id, text and a row's number among equal rows, so a rerun takes the same documents and rows of one id
are drawn one by one.

Ranks are not made by sorting a source: words are summed in `BUCKETS` ranges of rank per source, running sums over those
tell the range in which the sample ends, and only that range is sorted. Sizes have eight values of w an octave, so a source has some hundred.

Defined cases: a NULL or empty text has size 0 and takes 0 words; the NULL source is a source, last in order; a source
without words has target 0; rows with the same id and text are told apart by number; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

BUCKETS = 4096
BLANKS = " \t\n\x0b\x0c\r"
SEED = "mix-1"
MOST = 3
#: Bits of MD5 that make the random number.
DRAWN = 52
#: Columns with a row's number and with its copies.
ROW, COPIES = "mix_row", "mix_copies"


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """row (its number in the table), doc_id, source, size (words), tie and u, the random number in (0, 1), of every row; staged."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = staged(docs.select(
        F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id().alias(ROW), "doc_id", "source", words(F.col("text")).alias("size"),
        name.alias("name"),
    ))
    # equal rows are numbered by part of the table, since one text may be a third of it
    often = rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    part = F.shiftright(F.col(ROW), 20).alias("part")
    again = staged(rows.select(ROW, "name", part).join(often, "name", "left_semi"))
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = again.groupBy("name", "part").agg(F.count("*").alias("n")).select("name", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("upto"))
    inside = F.row_number().over(Window.partitionBy("name", "part").orderBy(ROW))
    numbers = again.withColumn("inside", inside).join(parts, ["name", "part"]).select(ROW, (F.col("inside") + F.col("upto")).alias("number"))
    told = F.md5(F.concat(F.lit(f"{seed}:"), "name", F.lit(":"), F.coalesce("number", F.lit(1)).cast("string")).cast("binary"))
    drawn = (F.conv(F.substring(told, 1, DRAWN // 4), 16, 10).cast("double") + 0.5) / F.lit(float(1 << DRAWN))
    return staged(rows.join(numbers, ROW, "left").select(ROW, "doc_id", "source", "size", told.alias("tie"), drawn.alias("u")))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """`sources` (source, source_size, weight) with target.

    A target is min(most * size, weight * level). The sources that reach their limit are the first by limit / weight; the
    level follows from what is left for the others.
    """
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = sources.withColumn("limit", most * F.col("source_size").cast("double")).select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    )
    level = (F.col("total") - F.col("before")) / F.col("left")
    fits = F.when(F.col("weight") * level <= F.col("limit"), F.col("limit") / F.col("weight"))
    named = ranked.withColumns({"level": level, "fits": fits})
    first = F.min_by("level", "fits").over(Window.partitionBy())
    return named.withColumn("target", F.least("limit", F.col("weight") * first)).select("source", "source_size", "weight", "target")


def weighted(docs_sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight): weights repeat over the sources by code point, NULL last. One row per source."""
    sums = docs_sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1).cast("double"))


def coarse(size: Column) -> Column:
    """The size rounded down to four binary digits."""
    scale = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - 4, F.lit(0)))
    return F.floor(size / scale) * scale


def inclusions(rows: DataFrame, per: DataFrame) -> DataFrame:
    """(s, w, p) for each source and coarse size of `rows`: the inclusion of its documents, so that expected words are `per`'s rest.

    The largest sizes are certain; c follows from the words the certain ones leave, at the first size for which c w is under 1.
    """
    sums = rows.where("size > 0").groupBy(F.col("source").alias("s"), coarse(F.col("size")).alias("w")).agg(F.sum("size").cast("double").alias("words"))
    largest = Window.partitionBy("s").orderBy(F.desc("w"))
    known = sums.join(per.withColumnRenamed("s", "of"), sums.s.eqNullSafe(F.col("of"))).drop("of").withColumns({
        "above": F.coalesce(F.sum("words").over(largest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "spread": F.sum(F.col("words") * F.col("w")).over(largest.rowsBetween(0, Window.unboundedFollowing)),
    })
    c = (F.col("rest") - F.col("above")) / F.col("spread")
    known = known.withColumn("c", c).withColumn("c", F.max_by("c", F.when(F.col("c") * F.col("w") < 1, F.col("w"))).over(Window.partitionBy("s")))
    return known.select("s", "w", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c") * F.col("w"))).alias("p"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: str = SEED) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken (words, repeats counted), copies, inclusion of every row."""
    rows = sized(docs, seed)
    per = staged(targets(weighted(rows, weights), most)).select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"),
    ).withColumn("base", F.floor("ratio")).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    shares = staged(inclusions(rows, per.select("s", "rest")))
    found = rows.join(per, rows.source.eqNullSafe(per.s)).withColumn("w", coarse(F.col("size")))
    found = found.join(shares.select(F.col("s").alias("of"), F.col("w").alias("at"), "p"), F.col("s").eqNullSafe(F.col("of")) & (F.col("w") == F.col("at")), "left")
    p = F.when(F.col("size") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = staged(found.drop("of", "at").withColumn("p", p).withColumn("q", F.when((F.col("p") > 0) & (F.col("p") < 1), odds)))
    # what the certain documents leave of the rest
    sure = ranked.where("p >= 1").groupBy(F.col("s").alias("of")).agg(F.sum("size").alias("certain"))
    ranked = ranked.join(sure, F.col("s").eqNullSafe(F.col("of")), "left").drop("of").withColumn("rest", F.col("rest") - F.coalesce("certain", F.lit(0)))
    # q / (1 + q) runs from 0 to 1 with the rank
    ranked = ranked.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS))
    drawn = ranked.where("q IS NOT NULL")
    sums = drawn.groupBy("s", "bucket", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
    ends = staged(sums.select("s", "bucket", "rest", "words", upto.alias("upto")).where("upto > rest").groupBy("s").agg(
        F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("before")))
    ends = ends.withColumnRenamed("s", "at")
    last = ranked.join(ends, ranked.s.eqNullSafe(ends["at"])).where("bucket = cut").select("s", "q", "tie", "size", "rest", "before")
    order = Window.partitionBy("s").orderBy("q", "tie").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(order))
    # the last document that fits, and the words that are missing after it
    fitting = last.where("upto <= rest").groupBy("s").agg(F.max(F.struct("q", "tie")).alias("end"), F.max("upto").alias("have"))
    stop = staged(ends.join(fitting, ends["at"].eqNullSafe(fitting.s), "left").select("at", "cut", "end", F.coalesce("have", "before").alias("have")))
    key = F.struct("q", "tie")
    placed = ranked.join(stop, ranked.s.eqNullSafe(stop["at"]), "left").withColumn(
        "fits",
        F.when(F.col("q").isNull(), F.col("p") >= 1).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), True)
        .when(F.col("bucket") > F.col("cut"), False).otherwise(F.coalesce(key <= F.col("end"), F.lit(False))),
    )
    missing = F.col("rest") - F.col("have")
    closest = staged(
        placed.where("q IS NOT NULL AND cut IS NOT NULL AND NOT fits").where(F.abs(F.col("size") - missing) < missing)
        .groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - missing).alias("off"), "q", "tie")).alias("best"))
    ).select(F.col("s").alias("c"), "best.tie").withColumnRenamed("tie", "best")
    filled = placed.join(closest, placed.s.eqNullSafe(closest.c), "left")
    chosen = F.coalesce(F.col("tie") == F.col("best"), F.lit(False)) & ~F.col("fits")
    copies = F.col("base") + F.when(F.col("fits") | chosen, 1).otherwise(0)
    return filled.select(
        ROW, "doc_id", "source", "size", F.col("source_size"), "target",
        (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"), F.round("p", 6).alias("inclusion"),
    )


def drawn_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, whole, each as often as it is taken."""
    rows = staged(docs.withColumn(ROW, F.monotonically_increasing_id()))
    plan = mixed(rows, weights, most, seed).where("copies > 0").select(ROW, F.col("copies").alias(COPIES))
    taken = rows.join(plan.hint("shuffle_hash"), ROW)
    return taken.withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(*docs.columns)


def _sql() -> str:
    blank = r"[\x20\x09-\x0D]"
    coarse_sql = "(floor(size / pow(2.0, greatest(length(bin(size)) - 4, 0))) * pow(2.0, greatest(length(bin(size)) - 4, 0)))"
    return rf"""
    WITH named AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS name,
            len(list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
    told AS (SELECT *, md5('{SEED}:' || name || ':' || row_number() OVER (PARTITION BY name ORDER BY rid)) AS tie FROM named),
    rows AS (SELECT *, {coarse_sql} AS w, (('0x' || substr(tie, 1, {DRAWN // 4}))::BIGINT::DOUBLE + 0.5) / {float(1 << DRAWN)}::DOUBLE AS u FROM told),
    sums AS (SELECT source AS s, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
    weighted AS (SELECT *, (row_number() OVER (ORDER BY s NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS wt,
        {MOST}.0::DOUBLE * source_size AS most FROM sums),
    ranked AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(most) OVER (ORDER BY most / wt, s NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(wt) OVER (ORDER BY most / wt, s NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM weighted),
    level AS (SELECT min_by((total - before) / left_w, most / wt) AS level FROM ranked WHERE wt * (total - before) / left_w <= most),
    per AS (SELECT s, source_size, least(most, wt * level) AS target FROM ranked, level),
    shares AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS base FROM per),
    sizes AS (SELECT source, w, sum(size)::DOUBLE AS words FROM rows WHERE size > 0 GROUP BY source, w),
    level_c AS (SELECT z.source, z.w, (target - base * source_size
            - coalesce(sum(words) OVER (PARTITION BY z.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(words * w) OVER (PARTITION BY z.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
        FROM sizes z JOIN shares p ON z.source IS NOT DISTINCT FROM p.s),
    cs AS (SELECT source, max_by(c, w) FILTER (c * w < 1) AS c FROM level_c GROUP BY source),
    odds AS (SELECT r.*, p.*, CASE WHEN size > 0 THEN coalesce(least(1.0, greatest(0.0, c * w)), 0.0) ELSE 0.0 END AS p, target - base * source_size AS gap
        FROM rows r JOIN shares p ON r.source IS NOT DISTINCT FROM p.s LEFT JOIN cs ON cs.source IS NOT DISTINCT FROM r.source),
    placed AS (SELECT *, gap - coalesce(sum(size) FILTER (p >= 1) OVER (PARTITION BY s), 0) AS rest,
        CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM odds),
    running AS (SELECT *, sum(size) OVER (PARTITION BY s ORDER BY q, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM placed WHERE q IS NOT NULL),
    have AS (SELECT s, max(upto) FILTER (WHERE upto <= rest) AS have FROM running GROUP BY s),
    left_over AS (SELECT r.*, rest - coalesce(have, 0) AS missing FROM running r
        JOIN have h ON r.s IS NOT DISTINCT FROM h.s WHERE upto > rest),
    best AS (SELECT rid FROM left_over WHERE abs(size - missing) < missing
        QUALIFY row_number() OVER (PARTITION BY s ORDER BY abs(size - missing), q, tie) = 1),
    extra AS (SELECT rid FROM running WHERE upto <= rest UNION ALL SELECT rid FROM best UNION ALL SELECT rid FROM placed WHERE p >= 1)
    SELECT doc_id, source, size, source_size, target, (size * (base + (e.rid IS NOT NULL)::INT))::BIGINT AS taken,
        (base + (e.rid IS NOT NULL)::INT)::INT AS copies, round(p, 6) AS inclusion FROM placed p LEFT JOIN extra e ON p.rid = e.rid"""


SQL = _sql()
