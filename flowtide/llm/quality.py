"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Counts of each whole text come from one Arrow stage. A sketch is a histogram of a metric in buckets whose width grows with the value,
seven bits of precision: sketches of any two sets of documents merge by adding counts, which Spark's partial aggregation does. The
sketches hold the texts that pass the base rule, and smoothed rates, (count + 1) / (size + 2), which spread with the sizes of texts
where most counts are 0. Each language x source gets fences per metric from the quartiles of its sketch: an upper one for the rates, one
on either side for the mean word length. A fence is the median times ``EXPONENT`` powers of the spread times ``ROOM``. The spread is the
smaller of the ratios of median and quartiles, so junk in less than half of a group doesn't widen it; a rate's fence lies at most halfway
from the median to the largest rate. Groups of fewer than ``LEAST_ROWS`` use their language's merged sketch, or that of all documents.
The fences are joined back and a document whose plain rate is beyond any fence isn't kept.

Defined cases: null text has no words, so it fails the base rule; null lang or source is a group of its own; a group whose texts all
fail the base rule has no fences; a value on a fence is kept; a text of any length is one row in memory; an empty table gives no rows;
repeated rows count each; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, redealt, spool, table, utf8

SYMBOLS = b"#*$%&|<>"
#: Base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
#: Parts of a whole, and count and size of each rate.
UNIT = 1_000_000
RATES = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words")}
#: Metrics with a fence on either side, in ten-thousandths of a character.
TWO_SIDED = ("word_length",)
METRICS = (*RATES, *TWO_SIDED)
#: Powers of the spread in a fence, and what one more occurrence may matter: a factor for rates and for mean lengths.
EXPONENT, ROOM = {"rate": 5, "mean": 10}, {"rate": 2.0, "mean": 1.25}
#: Rows below which a group uses a wider sketch; bits of precision of a bucket.
LEAST_ROWS, BITS = 100, 7
FENCES = (*(f"{m}_fence" for m in METRICS), *(f"{m}_low" for m in TWO_SIDED))
_COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def count_text(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word of a whole text in UTF-8."""
    words = raw.split()  # splits bytes at ASCII white space only
    a = np.frombuffer(raw, np.uint8)
    points = int(((a & 0xC0) != 0x80).sum())
    blanks = int(((a == 32) | ((a >= 9) & (a <= 13))).sum())
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), points - blanks, int(_SYMBOL[a].sum()), dup, repeated_words(words), lines


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that stand in the text twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    windows = np.zeros(n, np.uint64)
    for k in range(width):  # exact: numbers of words are mixed, and equal hashes are compared below
        windows = (windows ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(29)
    _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[place] > 1)
    if not len(starts):
        return 0
    exact: dict[bytes, list[int]] = {}
    for s in starts.tolist():
        exact.setdefault(ids[s : s + width].tobytes(), []).append(s)
    covered = np.zeros(len(words) + 1, np.int64)
    for group in exact.values():
        if len(group) > 1:
            for s in group:
                covered[s] += 1
                covered[s + width] -= 1
    return int((np.cumsum(covered) > 0).sum())


def text_counts(docs: DataFrame) -> DataFrame:
    """The counts of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([count_text(raw) for raw in utf8(batch["text"])], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["source"], *(pa.array(c) for c in counts.T)], [x.split()[0] for x in _COUNTS.split(", ")])

    return arrow_map(rows, run, _COUNTS)


def rates(counts: DataFrame) -> DataFrame:
    """Metrics in whole numbers: rates in millionths, the mean word length in ten-thousandths of a character."""
    per = lambda a, b, unit: F.expr(f"{a} * {unit} div greatest({b}, 1)")
    return counts.withColumns({**{m: per(a, b, UNIT) for m, (a, b) in RATES.items()}, "word_length": per("word_chars", "n_words", 10_000)})


def smoothed(metric: str) -> Column:
    """What a sketch holds of a metric."""
    return F.expr("({} + 1) * {} div ({} + 2)".format(RATES[metric][0], UNIT, RATES[metric][1])) if metric in RATES else F.col(metric)


def bucket(value: Column, bits: int = BITS) -> Column:
    """The lower end of a value's bucket: with seven bits exact below 128, then 64 buckets for each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.when(value < 1 << bits, value).otherwise(F.floor(value / F.pow(F.lit(2.0), shift)) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable sketches of the metrics: lang, source, metric, bucket, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(smoothed(m)).alias("bucket")) for m in METRICS]))
    return rows.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def merged_quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of the sketches merged to ``keys`` x metric: q1, q2, q3 and rows. A merged sketch has some hundred buckets at most."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = merged.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("rows"))

    def quantile(q: float) -> Column:
        step = lambda acc, x: F.struct(
            (acc["seen"] + x["n"]).alias("seen"),
            F.when(acc["value"].isNull() & (acc["seen"] + x["n"] >= F.col("rows") * q), x["bucket"]).otherwise(acc["value"]).alias("value"),
        )
        return F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value")), step, lambda acc: acc["value"])

    return whole.select(*keys, "metric", "rows", quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(0.75).alias("q3"))


def power(x: Column, n: int) -> Column:
    """x to the n by multiplication, so that every engine gets the same double."""
    out = x
    for _ in range(n - 1):
        out = out * x
    return out


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and the columns FENCES, from the group's sketch or the next wider one."""
    g, by_lang, everything = merged_quantiles(sketch, ["lang", "source"]).alias("g"), merged_quantiles(sketch, ["lang"]).alias("l"), merged_quantiles(sketch, []).alias("a")
    both = g.join(by_lang, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.metric") == F.col("l.metric"))).join(everything, F.col("g.metric") == F.col("a.metric"))
    chosen = lambda n: F.when(F.col("g.rows") >= LEAST_ROWS, F.col(f"g.{n}")).when(F.col("l.rows") >= LEAST_ROWS, F.col(f"l.{n}")).otherwise(F.col(f"a.{n}"))
    rows = both.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), F.col("g.metric").alias("metric"), *[chosen(n).cast("double").alias(n) for n in ("q1", "q2", "q3")])
    rows = rows.withColumn("spread", F.least(F.col("q3") / F.col("q2"), F.col("q2") / F.col("q1")))
    wide = {kind: power(F.col("spread"), n) * ROOM[kind] for kind, n in EXPONENT.items()}
    two_sided = F.col("metric").isin(*TWO_SIDED)
    high = F.when(two_sided, F.col("q2") * wide["mean"]).otherwise(F.least(F.col("q2") * wide["rate"], (F.col("q2") + UNIT) / 2))
    rows = rows.select("lang", "source", "metric", F.floor(high).alias("fence"), F.floor(F.col("q2") / wide["mean"]).alias("low"))
    of = lambda m, n, name: F.max(F.when(F.col("metric") == m, F.col(n))).alias(name)
    return rows.groupBy("lang", "source").agg(*[of(m, "fence", f"{m}_fence") for m in METRICS], *[of(m, "low", f"{m}_low") for m in TWO_SIDED])


def judge(docs: DataFrame) -> DataFrame:
    """The counts, metrics, fences, base_failed and kept of each document."""
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    rows = rates(spool(text_counts(docs), "quality")).withColumn("base_failed", failed)
    limits = redealt(fences(sketches(rows.where(~F.col("base_failed")))).select(F.col("lang").alias("__l"), F.col("source").alias("__s"), *FENCES))
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left").drop("__l", "__s")
    passed = ~F.col("base_failed")
    for m in METRICS:
        passed = passed & (F.col(m) <= F.col(f"{m}_fence"))
    for m in TWO_SIDED:
        passed = passed & (F.col(m) >= F.col(f"{m}_low"))
    return out.withColumn("kept", passed)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7_quality."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents")).select(*names, *METRICS, *FENCES)


def _oracle() -> str:
    """DuckDB SQL of op7: counts, sketches, fences and verdicts."""
    both = lambda x: "" if not x else ", ".join(x) + ", "
    value = {**{m: f"({a} + 1) * {UNIT} // ({b} + 2)" for m, (a, b) in RATES.items()}, "word_length": "word_length"}
    plain = {**{m: f"{a} * {UNIT} // greatest({b}, 1)" for m, (a, b) in RATES.items()}, "word_length": "word_chars * 10000 // greatest(n_words, 1)"}

    def level(name: str, keys: list[str]) -> str:
        on = " AND ".join([f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in keys] + ["x.metric = y.metric"])
        pick = lambda q: f"min(bucket) FILTER (WHERE seen >= total * {q})"
        return f"""{name} AS (
  SELECT {both(keys)}metric, max(total) AS total, {pick(0.25)} AS q1, {pick(0.5)} AS q2, {pick(0.75)} AS q3 FROM (
    SELECT {both(keys)}metric, bucket, sum(n) OVER (PARTITION BY {both(keys)}metric ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY {both(keys)}metric) AS total
    FROM (SELECT {both(keys)}metric, bucket, sum(n) AS n FROM sketch GROUP BY {both(keys)}metric, bucket)) GROUP BY {both(keys)}metric
)""", on

    (g, _), (l, on_l), (a, on_a) = level("g", ["lang", "source"]), level("l", ["lang"]), level("a", [])
    chosen = lambda q: f"CASE WHEN x.total >= {LEAST_ROWS} THEN x.{q} WHEN y.total >= {LEAST_ROWS} THEN y.{q} ELSE z.{q} END::DOUBLE AS {q}"
    times = lambda kind: " * ".join(["spread"] * EXPONENT[kind])
    sketch = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {value[m]} AS v FROM rated WHERE NOT base_failed" for m in METRICS)
    columns = ", ".join([f"max(fence) FILTER (WHERE metric = '{m}') AS {m}_fence" for m in METRICS] + [f"max(low) FILTER (WHERE metric = '{m}') AS {m}_low" for m in TWO_SIDED])
    verdict = " AND ".join([f"{m} <= {m}_fence" for m in METRICS] + [f"{m} >= {m}_low" for m in TWO_SIDED])
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS key, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT key, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT key, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)
), grams AS (
  SELECT key, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM words WINDOW o AS (PARTITION BY key ORDER BY i)
), twice AS (
  SELECT key, i FROM (SELECT key, i, count(*) OVER (PARTITION BY key, s) AS c FROM grams WHERE s IS NOT NULL) WHERE c > 1
), repeated AS (
  SELECT key, count(DISTINCT i + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS d) GROUP BY key
), lines AS (
  SELECT key, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT key, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY key
), sized AS (
  SELECT key, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY key
), counted AS (
  SELECT doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM docs LEFT JOIN sized USING (key) LEFT JOIN lines USING (key) LEFT JOIN repeated USING (key)
), rated AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed, {", ".join(f"{x} AS {m}" for m, x in plain.items())} FROM counted
), sketch AS (
  SELECT lang, source, metric, v >> greatest(length(bin(v)) - {BITS}, 0)::INT << greatest(length(bin(v)) - {BITS}, 0)::INT AS bucket, count(*) AS n FROM ({sketch}) GROUP BY ALL
), {g}, {l}, {a}, chosen AS (
  SELECT x.lang, x.source, x.metric, {chosen("q1")}, {chosen("q2")}, {chosen("q3")} FROM g x JOIN l y ON {on_l} JOIN a z ON {on_a.replace("y.", "z.")}
), wide AS (
  SELECT *, least(q3 / q2, q2 / q1) AS spread FROM chosen
), fenced AS (
  SELECT lang, source, metric,
    floor(CASE WHEN metric IN ({", ".join(f"'{m}'" for m in TWO_SIDED)}) THEN q2 * ({times("mean")} * {ROOM["mean"]}::DOUBLE) ELSE least(q2 * ({times("rate")} * {ROOM["rate"]}::DOUBLE), (q2 + {UNIT}) / 2) END)::BIGINT AS fence,
    floor(q2 / ({times("mean")} * {ROOM["mean"]}::DOUBLE))::BIGINT AS low FROM wide
), limits AS (
  SELECT lang, source, {columns} FROM fenced GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({verdict}, false) AS kept, {", ".join(METRICS)}, {", ".join(FENCES)}
FROM rated r LEFT JOIN limits f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""


ORACLE = _oracle()
