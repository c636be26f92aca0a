"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target of words by water-filling: shares go by weight, no target exceeds its cap, and what a capped source
leaves is reshared by weight. A document's expected copies are target / source size; their prefix sum within the source, plus
one random offset per source, is emitted once per integer boundary that it crosses.

The order of the prefix sum is by size band, then by hash bucket, size and doc_id, so the words taken differ from the target by
about one document. Expected copies are the same for all documents of a source, so the prefix sum is rank x rate, and the rank
is a cell's offset plus the row number in its cell. Cells (source, band, bucket) hold about ``CELL_ROWS`` rows, and a band has at
most ``CELLS_PER_BAND`` of them, so neither a hot source, nor a third of all rows being copies of one size, meets in one task.

Defined cases: null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in the order of
weights; repeated rows are separate documents; an empty table gives no rows; extra columns are left out of query results and
kept by :func:`resample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, small_side, spool, table

#: Weights of sources in code point order, repeating; share of all words to take; cap as a multiple of a source's words.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
CELL_ROWS, CELLS_PER_BAND = 256, 1024


def text_size(text: Column) -> Column:
    """Words of a text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """From (source, size) rows: source, source_size, target (words), one row per source.

    The windows below run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    # Sources in the order in which rising water reaches their caps; those before the first that stays below are capped.
    rising = W.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", F.col("most") * F.col("weight_left") > F.col("left") * F.col("weight"))
    )
    t = t.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("left") / F.col("weight_left")))).over(every))
    level = F.col("level").getField("col2")
    target = F.when(level.isNull() | (F.col("most").cast("double") <= level * F.col("weight")), F.col("most").cast("double")).otherwise(level * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def hashed(value: Column) -> Column:
    """28 bits of a text's md5, as a number."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 7), 16, 10).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): a hash, so that reruns agree."""
    return hashed(F.concat(F.lit(f"{seed}/"), F.coalesce(source, F.lit("/")))) / F.lit(float(1 << 28))


def size_band(size: Column) -> Column:
    """Eight bands for each doubling of the size."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.expr("0") + F.floor(size / F.pow(F.lit(2.0), bits - 4)).cast("long") - 8)


def systematic(docs: DataFrame, slim: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source_size, target and copies for each row of ``docs`` (doc_id, source, size, ...); other columns stay.

    slim: doc_id, source and size of the same rows, cheap to read again.
    """
    targets = source_targets(slim.select("source", "size"), weights, share, cap).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )
    slim = slim.withColumn("__band", size_band(F.col("size")))
    cells = F.least(F.ceil(F.count("*") / F.lit(CELL_ROWS)), F.lit(CELLS_PER_BAND)).cast("long")
    bands = small_side(slim.groupBy(F.col("source").alias("__s"), F.col("__band").alias("__b")).agg(cells.alias("__cells")), "mix-bands")

    def dealt(df: DataFrame) -> DataFrame:
        bucket = F.pmod(hashed(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.col("__cells"))
        return df.join(bands, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__band") == F.col("__b"))).withColumn("__bucket", bucket).drop("__s", "__b", "__cells")

    key = ["source", "__band", "__bucket"]
    per_cell = dealt(slim).groupBy(*key).agg(F.count("*").alias("__n"))
    below = W.partitionBy("source").orderBy("__band", "__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = per_cell.select(
        F.col("source").alias("__s"), F.col("__band").alias("__b"), F.col("__bucket").alias("__k"), F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__start"),
    ).join(targets.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    starts = small_side(starts, "mix-cells")
    rows = dealt(docs.withColumn("__band", size_band(F.col("size"))))
    ranked = rows.withColumn("__row", F.row_number().over(W.partitionBy(*key).orderBy("size", "doc_id")))
    out = ranked.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__band") == F.col("__b")) & (F.col("__bucket") == F.col("__k")))
    rank = F.col("__start") + F.col("__row")
    shift = offset(F.col("source"), seed)
    copies = F.floor(rank * F.col("rate") + shift) - F.floor((rank - 1) * F.col("rate") + shift)
    return out.withColumn("copies", copies.cast("long")).drop("__s", "__b", "__k", "__start", "__row", "__band", "__bucket", "rate")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_size(F.col("text").cast("string")).alias("size"))
    slim = spool(rows, "mix-sizes")
    return systematic(slim, slim, seed).withColumn("taken", F.col("copies") * F.col("size"))


def resample(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of the mixture with the columns of ``docs``: each document as often as the mixture takes it."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("__doc"))
    rows = rows.select("__doc", F.col("__doc.doc_id").cast("long").alias("doc_id"), F.col("__doc.source").cast("string").alias("source"), text_size(F.col("__doc.text").cast("string")).alias("size"))
    slim = spool(rows.select("doc_id", "source", "size"), "mix-sizes")
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array().cast("array<bigint>"))
    taken = systematic(rows, slim, seed).select("__doc", F.explode(copies).alias("__copy"))
    return taken.select(*[F.col("__doc").getField(n).alias(n) for n in names])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3_mix."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 2 AS most, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals
), rising AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER o, 0)::DOUBLE AS left_words, ((sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0))::DOUBLE AS left_weight, most::DOUBLE / weight AS ratio
  FROM weighed WINDOW o AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT min(left_words / left_weight) FILTER (WHERE rk = 1) AS level FROM (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS rk FROM rising WHERE most * left_weight > left_words * weight)
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR most <= level * weight THEN most::DOUBLE ELSE level * weight END AS target FROM weighed, level
), banded AS (
  SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)::INT) - 8 END AS band FROM sized
), bands AS (
  SELECT source AS s, band AS b, least(ceil(count(*) / 256.0), 1024)::BIGINT AS cells FROM banded GROUP BY source, band
), dealt AS (
  SELECT x.*, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT % cells AS bucket FROM banded x JOIN bands ON x.source IS NOT DISTINCT FROM s AND band = b
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, bucket, size, doc_id) AS rank FROM dealt
), copied AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.source, r.rank, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('0/' || coalesce(r.source, '/')), 1, 7))::BIGINT / 268435456.0::DOUBLE AS shift
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), out AS (SELECT *, (floor(rank * rate + shift) - floor((rank - 1) * rate + shift))::BIGINT AS copies FROM copied)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM out
"""
