"""Repeated runs of consecutive units (lines or sentences) of documents: found globally, first occurrences kept.

Each task hashes the runs of its texts, and the runs are written out once. For each run the first document that holds it is found by a
partial aggregation; later documents, and later places in the same document, lose the units that the run covers. A run that a third of
all documents share costs one row a task in that aggregation, and the join back is one that Spark can split.

Every row is a document of its own. Documents are ordered by doc_id. Where ids are null or used more than once, the rows are written out
with a number each, and the order is doc_id (null last), the md5 of the text (null as empty), and that number: so equal rows lose
what their first one holds, and rows that share an id but not the text keep their own cuts apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, redealt, spool, utf8

#: Cuts a text into its units; returns their normal forms and, in units, the (start, end) of each run.
Runs = Callable[[bytes], tuple[list[bytes], list[tuple[int, int]]]]


def numbered_rows(docs: DataFrame) -> DataFrame:
    """key (unique), place (what documents are ordered by) and doc (the whole row) of each row; names of columns can't clash."""
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc"))
    own_id = F.col("doc.doc_id").cast("long")
    ids = rows.groupBy(own_id.alias("id")).agg(F.count("*").alias("n"))  # reads one column
    if not ids.where("id is null or n > 1").limit(1).count():
        return rows.select(own_id.alias("key"), own_id.alias("place"), "doc")
    rows = spool(rows.select(F.monotonically_increasing_id().alias("key"), "doc"), "numbered")
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    place = F.struct(own_id.isNull().alias("no_id"), own_id.alias("id"), F.md5(text.cast("binary")).alias("text"), F.col("key").alias("row"))
    return rows.select("key", place.alias("place"), "doc")


def run_hashes(rows: DataFrame, runs_of: Runs) -> DataFrame:
    """One row per run: its document (key, place), hash (128 bits), units, and whether the same document holds it earlier (local)."""
    rows = rows.select("key", "place", F.col("doc.text").cast("string").alias("text"))
    place = rows.schema["place"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 500):
                part = batch.slice(cut, 500)
                sizes, digests, bounds, local = [], [], [], []
                for raw in utf8(part["text"]):
                    units, runs = runs_of(raw)
                    seen: set[bytes] = set()
                    sizes.append(len(runs))
                    bounds += runs
                    for s, e in runs:
                        digest = xxhash.xxh3_128_digest(b"\n".join(units[s:e]))
                        digests.append(digest)
                        local.append(digest in seen)
                        seen.add(digest)
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                at = np.array(bounds, np.int32).reshape(-1, 2)
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                columns = [part["key"].take(owner), part["place"].take(owner), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(local, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "place", "h1", "h2", "start", "end", "local"])

    return arrow_map(rows, run, f"key long, place {place}, h1 long, h2 long, start int, end int, local boolean")


def later_runs(rows: DataFrame, runs_of: Runs) -> DataFrame:
    """The runs that aren't the first occurrence: key, first_doc_id, start, end."""
    runs = spool(run_hashes(rows, runs_of), "runs")
    firsts = runs.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.max("local").alias("again"))
    firsts = redealt(firsts.where((F.col("first") < F.col("last")) | F.col("again")).drop("last", "again"))
    later = runs.join(firsts, ["h1", "h2"]).where((F.col("place") > F.col("first")) | F.col("local"))
    first_id = F.col("first") if dict(runs.dtypes)["place"] == "bigint" else F.col("first.id")
    return later.select("key", first_id.alias("first_doc_id"), "start", "end")


def covered_units(later: DataFrame) -> DataFrame:
    """key, spans (sorted, distinct) and first_doc_ids of each document that loses something; bounded by the document's own length."""
    return later.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids")
    )


def merged(spans: list[dict], n: int) -> np.ndarray:
    """Which of n units the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge[:-1]) > 0
