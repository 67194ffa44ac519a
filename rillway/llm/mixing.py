"""Mixing sources to target weights with hash-threshold histograms.

A document's hash decides when it is taken: a source gives the documents whose hash lies below its threshold once
more than the others. The threshold comes from histograms of size by source and leading hash bits; each round looks
only into the bucket in which a source's budget ends, with the next bits, until that bucket holds one document or the
bits are used up. Nothing is sorted, and a larger budget's selection contains a smaller one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillway.llm.staging import discard, stage, unused, with_rank, words_pattern

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, of all sizes together.
BUDGET = 1.5
#: Times that a document can be taken at most.
MOST = 2
_BITS, _LEVEL = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(words_pattern())), F.lit(0)).cast("long")


def place_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text, so that any engine finds the same; a null id counts as 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """__source, __total, __target (double): shares of the budget by weight, none above most times the source's size.

    The excess of capped sources goes to the others by weight until no share is above its cap. Each round is one
    aggregate over the sources, so their number isn't bounded by the driver.
    """
    by_source = sizes.groupBy("__source").agg(F.sum("__size").alias("__total"))
    ranked = with_rank(by_source, [F.col("__source").asc_nulls_last()], "__rank", "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")).cast("long")
    table = stage(ranked.select("__source", "__total", weight.alias("__weight")), "weights")
    share, n = 0.0, -1
    while True:
        capped = F.lit(n >= 0) & (F.col("__total") * most <= F.col("__weight") * F.lit(share))
        row = table.agg(
            F.sum("__total").alias("all"), F.sum(F.when(capped, F.col("__total") * most)).alias("held"),
            F.sum(F.when(~capped, F.col("__weight"))).alias("weight"), F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if row["weight"] is None or row["n"] == n:
            break
        n = row["n"]
        share = (budget * row["all"] - (row["held"] or 0)) / row["weight"]
    return table.select("__source", "__total", F.least((F.col("__total") * most).cast("double"), F.col("__weight") * F.lit(float(share))).alias("__target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """For each source of rows of __source, __hash and __size: __total, __target, __times and __upto; and the number of hash bits that __upto is of.

    A source whose target is __times its size and a rest takes every document that often and, of those with the
    lowest hashes, as many once more as come nearest to the rest: the ones whose leading bits are below __upto.
    """
    whole = F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(F.lit(0))
    state = targets.withColumn("__times", whole.cast("long"))
    state = state.withColumn("__rest", F.col("__target") - F.col("__times") * F.col("__total"))
    state = stage(state.withColumns({"__prefix": F.lit(0).cast("long"), "__below": F.lit(0).cast("long"), "__bucket": F.col("__total"), "__rows": F.lit(None).cast("long")}), "mix")
    keep = ["__total", "__target", "__times", "__rest"]
    bits = 0
    while bits < _BITS:
        inside = F.shiftright("__hash", _BITS - bits) == F.col("__prefix") if bits else F.lit(True)
        bits += _LEVEL
        same = sizes["__source"].eqNullSafe(state["__source"])
        some = sizes.join(state.drop("__bucket", "__rows"), same).where(inside).drop(state["__source"])
        histogram = some.groupBy("__source", *keep, "__below", F.shiftright("__hash", _BITS - bits).alias("__next")).agg(F.sum("__size").alias("__bucket"), F.count("*").alias("__rows"))
        upto = W.partitionBy("__source").orderBy("__next").rowsBetween(W.unboundedPreceding, -1)
        summed = histogram.withColumn("__below", F.col("__below") + F.coalesce(F.sum("__bucket").over(upto), F.lit(0)))
        # the first bucket that ends beyond the rest; a source whose rest takes in everything has its last bucket
        beyond = F.col("__below") + F.col("__bucket") > F.col("__rest")
        first = F.row_number().over(W.partitionBy("__source").orderBy((~beyond), F.when(beyond, F.col("__next")).otherwise(-F.col("__next"))))
        narrowed = stage(summed.withColumn("__first", first).where("__first = 1").select("__source", *keep, F.col("__next").alias("__prefix"), "__below", "__bucket", "__rows"), "mix")
        discard(state)
        state = narrowed
        if not state.where("__rows > 1").limit(1).count():
            break
    # the boundary bucket goes in if that comes nearer to the rest than leaving it out
    nearer = F.abs(F.col("__below") + F.col("__bucket") - F.col("__rest")) < F.abs(F.col("__below") - F.col("__rest"))
    upto = F.col("__prefix") + F.when(nearer, F.lit(1)).otherwise(F.lit(0))
    return state.select("__source", "__total", "__target", "__times", upto.alias("__upto")), bits


def times_taken(docs: DataFrame, found: tuple[DataFrame, int], source: Column, place: Column, takes: str, *kept: str) -> DataFrame:
    """Adds takes (long), and those of __total and __target that are kept, to each row. The table of sources is joined as its size allows; the rows aren't moved if it is small."""
    table, bits = found
    of, times, upto = unused([*docs.columns, takes, *kept], "of", "times", "upto")
    table = table.select(F.col("__source").alias(of), F.col("__times").alias(times), F.col("__upto").alias(upto), *kept)
    once = F.when(F.shiftright(place, _BITS - bits) < F.col(upto), F.lit(1)).otherwise(F.lit(0))
    return docs.join(table, source.eqNullSafe(F.col(of))).withColumn(takes, F.col(times) + once).drop(of, times, upto)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Staged rows of __doc, __source, __size and __hash."""
    size = word_count(F.col(text_col))
    return stage(docs.select(F.col(id_col).alias("__doc"), F.col(source_col).cast("string").alias("__source"), size.alias("__size"), place_hash(F.col(id_col)).alias("__hash")), "sizes")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row.

    Sizes are words; a null text has none and is taken 0 words. A null source is a source, the last one. Rows with
    the same doc_id share a hash and are taken alike. Sources of no words have target 0. Extra columns aren't read.
    An empty table gives no rows.
    """
    sizes = measured(docs)
    found = thresholds(sizes, source_targets(sizes, weights, budget, most))
    mixed = times_taken(sizes, found, F.col("__source"), F.col("__hash"), "__takes", "__total", "__target")
    return mixed.select(
        F.col("__doc").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__takes")).alias("taken"),
    )


def select_mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it: 0 to most times, with all their columns, whatever their names.

    Nulls, texts without words, repeated ids and empty tables as in mix_sources.
    """
    sizes = measured(docs, id_col, source_col=source_col)
    table, bits = thresholds(sizes, source_targets(sizes, weights, budget, most))
    found = stage(table, "thresholds"), bits
    discard(sizes)
    takes, copy = unused(docs.columns, "takes", "copy")
    taken = times_taken(docs, found, F.col(f"`{source_col}`").cast("string"), place_hash(F.col(f"`{id_col}`")), takes).where(F.col(takes) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(takes)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's share in the mix; nulls, repeated ids and empty tables as in mix_sources."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sized GROUP BY source),
weighed AS (SELECT source, total, CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM totals),
rising AS (
  SELECT *, row_number() OVER o AS k, coalesce(sum(2 * total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY 2.0 * total / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         sum(total) OVER () AS everything
  FROM weighed WINDOW o AS (ORDER BY 2.0 * total / w, source NULLS LAST)),
levels AS (SELECT *, (1.5 * CAST(everything AS DOUBLE) - CAST(held AS DOUBLE)) / CAST(open_w AS DOUBLE) AS level FROM rising),
share AS (SELECT level FROM levels WHERE 2.0 * total > w * level ORDER BY k LIMIT 1),
targets AS (SELECT source, total, CASE WHEN (SELECT level FROM share) IS NULL THEN CAST(2 * total AS DOUBLE) ELSE least(CAST(2 * total AS DOUBLE), w * (SELECT level FROM share)) END AS target FROM weighed),
budgets AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS q FROM targets),
hashes AS (SELECT source, h, sum(size) AS bucket FROM sized GROUP BY source, h),
summed AS (
  SELECT source, h, bucket, coalesce(sum(bucket) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hashes),
judged AS (
  SELECT s.source, s.h,
         CASE WHEN s.below + s.bucket <= b.target - b.q * b.total THEN 1
              WHEN s.below <= b.target - b.q * b.total AND abs(s.below + s.bucket - (b.target - b.q * b.total)) < abs(s.below - (b.target - b.q * b.total)) THEN 1
              ELSE 0 END AS once
  FROM summed s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.source, d.size, b.total AS source_size, b.target, CAST(d.size * (b.q + j.once) AS BIGINT) AS taken
FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source JOIN judged j ON d.source IS NOT DISTINCT FROM j.source AND d.h = j.h
"""
