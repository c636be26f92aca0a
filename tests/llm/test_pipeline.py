import hashlib
import random
import re

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from flowtide.llm import bpe, langid, mixing
from flowtide.llm.common import BATCH_BYTES, arrow_map, spool

from .test_jaccard import brute
from .test_repeats import brute_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, docs):
    out = []
    for name, stage in P.STAGES:
        made = stage(spark, docs, "")
        if name != P.STAGES[-1][0]:
            assert made.columns == docs.columns, name
        docs = spool(made, name)
        out.append(docs)
    return out


def test_stages(spark, odd):
    ids, lined, single, mixed, tokens = run(spark, odd)
    assert {4, 5, 13, 14}.isdisjoint({r["doc_id"] for r in ids.collect()})
    assert lined.count() == ids.count() and single.count() < lined.count()
    assert {1, 6, 8, 9, 11} <= {r["doc_id"] for r in single.collect()} and 2 not in {r["doc_id"] for r in single.collect()}
    assert tokens.count() == mixed.count() and all(r["round_trip"] for r in tokens.collect())


def test_empty(spark):
    assert [d.count() for d in run(spark, spark.createDataFrame([], DOCS))] == [0] * 5


def made_rows():
    """Two languages, exact and near copies, shared passages of lines, junk and empty texts; ids are unique."""
    rng, rows = random.Random(11), []
    tongues = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(150)] for lang, letters in (("en", "abcdeghilmnoprst"), ("fr", "aeéèçouqujvxlrz"))}
    shared = "\n".join(" ".join(rng.choice(tongues["en"]) for _ in range(6)) for _ in range(4))
    for i in range(160):
        lang = rng.choice(list(tongues))
        text = "\n".join(" ".join(rng.choice(tongues[lang]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9)))
        kind = rng.randrange(8)
        if kind == 0 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 1 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = f"{text}\n{shared}\nend {i}"
        elif kind == 3 and i % 3 == 0:
            text = rng.choice([None, "", "12 34 !!"])
        rows.append((i, text, lang if i % 7 else None, rng.choice(["a", "b", "b", "b", None]), None))
    return rows


def test_stages_against_brute_force(spark):
    """Each stage's rows, from its own input, against plain Python, DuckDB or the tokenizers library."""
    rows = made_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    of = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    ids, lined, single, mixed, tokens = run(spark, docs)

    model = langid.fit(docs)
    sure = lambda t: bool(re.search(r"[^\W\d_]", t or "")) and model.predict(langid.features(t.encode())[np.newaxis])[0][1] >= P.LEAST_LANGUAGE_SCORE
    assert of(ids) == sorted(((r[0], r[1]) for r in rows if sure(r[1])), key=str)

    want = brute_lines(of(ids))
    assert of(lined) == sorted(((i, t) for i, _, _, t in want), key=str) and any(n for _, _, n, _ in want)
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())

    groups = brute(of(lined))
    assert [i for i, _ in sorted(of(single))] == sorted({component for _, _, component in groups}) and single.count() < lined.count()

    db = duckdb.connect()
    db.register("documents", single.toArrow())
    copies = dict(db.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall())
    assert of(mixed) == sorted(((i, t) for i, t in of(single) for _ in range(copies[i])), key=str)

    library = Tokenizer.from_file(bpe.default_path())
    digest = lambda t: hashlib.sha256(",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in tokens.collect()) == sorted((i, digest(t)) for i, t in of(mixed))


def test_batches_are_bounded_by_bytes(spark):
    """Rows of 64 KB, as packed shingles have them: a batch of 1000 such rows would be 64 MB in the JVM and again in the worker."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "cast(repeat('x', if(id = 500, 8000000, 64000)) as binary) as a")
    got = arrow_map(rows, run, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 1000 and max(r["bytes"] for r in got) < 2 * BATCH_BYTES + 8_000_000
    assert sorted(r["bytes"] for r in got)[-2] < 1.1 * BATCH_BYTES
