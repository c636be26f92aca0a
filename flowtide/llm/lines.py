"""Line dedup by overlapping three-line windows.

Windows run over the lines that hold a word (lines of ASCII white space only are skipped). Windows that occur before, in a document
with a smaller id or earlier in the same one, are removed; covered positions merge, so a long repeated passage goes as a whole and
a single repeated line stays. Lines are compared byte by byte.

Defined cases: null text stays null; texts with fewer than three lines with a word have no window and stay as they are; of equal
windows the first one stays, by the order of :mod:`repeats`, which also says how repeated rows and null ids are told apart; a text of
any length is one row in memory; an empty table gives no rows; extra columns stay untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_map, table
from .repeats import covered_units, later_runs, merged, numbered_rows

WINDOW = 3


def worded_lines(raw: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and which of them hold a word."""
    lines = raw.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line and not line.isspace()]


def windows(raw: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The lines with a word and all windows over them."""
    lines, worded = worded_lines(raw)
    return [lines[i] for i in worded], [(s, s + WINDOW) for s in range(len(worded) - WINDOW + 1)]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc (the row, its text without the covered lines), n_lines (with a word) and n_removed of each row."""
    rows = numbered_rows(docs)
    names = docs.columns
    cut = covered_units(later_runs(rows, windows)).select("key", "spans")
    doc = StructType([StructField(f.name, StringType()) if f.name == "text" else f for f in docs.schema])
    schema = StructType([StructField("doc", doc), StructField("n_lines", LongType()), StructField("n_removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fields = dict(zip(names, part["doc"].flatten(), strict=True))
                texts, counts, removed = [], [], []
                for raw, spans in zip(fields["text"].cast(pa.string()).cast(pa.binary()).to_pylist(), part["spans"].to_pylist(), strict=True):
                    lines, worded = worded_lines(raw or b"")
                    counts.append(len(worded))
                    gone = set(np.array(worded, int)[merged(spans, len(worded))].tolist()) if spans else set()
                    removed.append(len(gone))
                    texts.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else raw)
                fields["text"] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(fields.values()), names), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["doc", "n_lines", "n_removed"])

    return arrow_map(rows.join(cut, "key", "left").select("doc", "spans"), run, schema)


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with cleaned texts and, where there is such a column, n_chars of the cleaned text."""
    own = lambda n: F.col("doc").getField(n)
    return dedup_lines(docs).select(*[(F.length(own("text")).cast("long") if n == "n_chars" else own(n)).alias(n) for n in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8_line_dedup: doc_id, n_lines, n_removed, kept_chars and the cleaned text's md5."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("doc.text", F.lit(""))
    return out.select("doc.doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("kept_chars"), F.md5(text.cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS key, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT key, i, l FROM (SELECT key, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)
), worded AS (
  SELECT key, i, l, row_number() OVER (PARTITION BY key ORDER BY i) AS k FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), win AS (
  SELECT a.key, a.k, a.l || chr(10) || b.l || chr(10) || c.l AS w
  FROM worded a JOIN worded b ON b.key = a.key AND b.k = a.k + 1 JOIN worded c ON c.key = a.key AND c.k = a.k + 2
), later AS (
  SELECT key, k FROM (SELECT key, k, row_number() OVER (PARTITION BY w ORDER BY key, k) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT key, k + d AS k FROM later, (SELECT unnest([0, 1, 2]) AS d)
), marked AS (
  SELECT n.key, n.i, n.l, w.k, g.k AS g FROM lines n LEFT JOIN worded w ON w.key = n.key AND w.i = n.i LEFT JOIN gone g ON g.key = w.key AND g.k = w.k
), kept AS (
  SELECT key, count(k) AS n_lines, count(g) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE g IS NULL), '') AS t FROM marked GROUP BY key
)
SELECT doc_id, n_lines, n_removed, length(t) AS kept_chars, md5(t) AS text_md5 FROM kept JOIN docs USING (key)
"""
