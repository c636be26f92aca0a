"""Substring dedup by sliding sentence spans.

A text is cut into sentences at ``.``, ``!``, ``?`` followed by white space, and at line breaks. Spans are the shortest runs of at least
``SENTENCES`` sentences with at least ``WORDS`` words that start or that end at a sentence, and sentences alone that have ``LONE_WORDS``.
A span depends on its own sentences only, so a passage has the same spans wherever it is copied, and each sentence of a passage within
these bounds lies in a span inside it: all of a repeated passage goes. Spans are compared by their words
in ASCII lower case. Sentences that any span covers which isn't its first occurrence are removed.

Defined cases: null or empty text has no sentence; a text shorter than any span stays; of equal spans the first one stays, by the
order of :mod:`repeats`, which also says how repeated rows and null ids are told apart; a text of any length is one row in memory, cut
in linear time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, utf8
from .repeats import covered_units, later_runs, merged, numbered_rows

SENTENCES, WORDS, LONE_WORDS = 2, 20, 50
_STOP = re.compile(rb"[.!?]++|\n")
_BLANKS = b" \t\n\x0b\x0c\r"


def sentences(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) bytes of each sentence that holds a word. A run of stops is looked at once, so the work is linear."""
    out, start, size = [], 0, len(raw)
    for end in (m.end() for m in _STOP.finditer(raw)):
        if end == size or raw[end] in _BLANKS or raw[end - 1] == 10:
            if not raw[start:end].isspace():
                out.append((start, end))
            start = end
    if start < size and not raw[start:].isspace():
        out.append((start, size))
    return out


def shortest_runs(sizes: list[int]) -> list[tuple[int, int]]:
    """The shortest run of at least SENTENCES sentences and WORDS words from each sentence that starts one."""
    runs, end, total = [], 0, 0
    for start, size in enumerate(sizes):
        while end < len(sizes) and (end - start < SENTENCES or total < WORDS):
            total += sizes[end]
            end += 1
        if end - start < SENTENCES or total < WORDS:
            break
        runs.append((start, end))
        total -= size
    return runs


def spans(raw: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Sentences in normal form and the spans over them, by place."""
    lower = raw.lower()
    words = [lower[s:e].split() for s, e in sentences(raw)]
    sizes = [len(w) for w in words]
    n = len(sizes)
    runs = {(i, i + 1) for i, size in enumerate(sizes) if size >= LONE_WORDS}
    runs.update(shortest_runs(sizes))
    runs.update((n - end, n - start) for start, end in shortest_runs(sizes[::-1]))
    return [b" ".join(w) for w in words], sorted(runs)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents that lose something: doc_id, n_sentences, n_removed, removed_chars, first_doc_ids, text (what is left)."""
    rows = numbered_rows(docs.select("doc_id", "text"))
    cut = covered_units(later_runs(rows, spans))
    rows = rows.select("key", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")).join(cut, "key").drop("key")
    schema = "doc_id long, n_sentences long, n_removed long, removed_chars long, first_doc_ids array<long>, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for raw, own in zip(utf8(part["text"]), part["spans"].to_pylist(), strict=True):
                    places = sentences(raw)
                    gone = merged(own, len(places))
                    left, last, chars = [], 0, 0
                    for (s, e), g in zip(places, gone.tolist(), strict=True):
                        if g:
                            left.append(raw[last:s])
                            chars += len(raw[s:e].decode())
                            last = e
                    left.append(raw[last:])
                    out.append((len(places), int(gone.sum()), chars, b"".join(left)))
                c = list(zip(*out, strict=True)) or [[]] * 4
                columns = [part["doc_id"], *(pa.array(v, pa.int64()) for v in c[:3]), part["first_doc_ids"], pa.array(c[3], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_sentences", "n_removed", "removed_chars", "first_doc_ids", "text"])

    return arrow_map(rows, run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4_substring_dedup: a row for each document that loses sentences, and the ids of those that held them first, joined by commas."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", "removed_chars", F.array_join("first_doc_ids", ",").alias("first_doc_ids"), F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS key, doc_id, coalesce(text, '') AS text FROM documents
), cuts AS (
  SELECT key, string_split(
    regexp_replace(regexp_replace(text, '([.!?]+)([\x09-\x0D\x20])', '\1' || chr(57344) || '\2', 'g'), '\n', chr(10) || chr(57344), 'g'), chr(57344)
  ) AS pieces FROM docs
), pieces AS (
  SELECT key, i, piece, list_filter(regexp_split_to_array(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS words
  FROM (SELECT key, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM cuts)
), units AS (
  SELECT key, i, array_to_string(words, ' ') AS unit, len(words) AS size, row_number() OVER (PARTITION BY key ORDER BY i) AS k,
    sum(len(words)) OVER (PARTITION BY key ORDER BY i) AS upto
  FROM pieces WHERE len(words) > 0
), whole AS (
  SELECT key, list(unit ORDER BY k) AS units, max(k) AS n FROM units GROUP BY key
), bounds AS (
  SELECT a.key, a.k AS s, min(b.k) AS e FROM units a JOIN units b ON b.key = a.key AND b.k > a.k AND b.upto - a.upto + a.size >= 20 GROUP BY a.key, a.k
  UNION
  SELECT b.key, max(a.k), b.k FROM units a JOIN units b ON b.key = a.key AND b.k > a.k AND b.upto - a.upto + a.size >= 20 GROUP BY b.key, b.k
  UNION
  SELECT key, k, k FROM units WHERE size >= 50
), spans AS (
  SELECT key, s, e, array_to_string(units[s:e], chr(10)) AS span FROM bounds JOIN whole USING (key)
), later AS (
  SELECT key, s, e, first FROM (
    SELECT key, s, e, min(key) OVER (PARTITION BY span) AS first, row_number() OVER (PARTITION BY span ORDER BY key, s, e) AS r FROM spans
  ) WHERE r > 1
), gone AS (
  SELECT DISTINCT key, unnest(range(s, e + 1)) AS k FROM later
), firsts AS (
  SELECT l.key, coalesce(array_to_string(list_sort(list(DISTINCT d.doc_id) FILTER (WHERE d.doc_id IS NOT NULL)), ','), '') AS first_doc_ids FROM later l JOIN docs d ON d.key = l.first GROUP BY l.key
), kept AS (
  SELECT p.key, count(u.k) AS n_sentences, count(g.k) AS n_removed, coalesce(sum(length(p.piece)) FILTER (WHERE g.k IS NOT NULL), 0)::BIGINT AS removed_chars,
    coalesce(string_agg(p.piece, '' ORDER BY p.i) FILTER (WHERE g.k IS NULL), '') AS t
  FROM pieces p LEFT JOIN units u ON u.key = p.key AND u.i = p.i LEFT JOIN gone g ON g.key = u.key AND g.k = u.k GROUP BY p.key
)
SELECT doc_id, n_sentences, n_removed, removed_chars, first_doc_ids, length(t) AS kept_chars, md5(t) AS text_md5
FROM kept JOIN firsts USING (key) JOIN docs USING (key)
"""
