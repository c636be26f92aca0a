import hashlib
import random
import re
import time

from flowtide.llm import lines, substrings


def in_order(rows):
    """The rows as documents are ordered: by id, null last, then by the md5 of the text."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))


def brute_lines(rows):
    """(doc_id, lines with a word, removed, text left) of each row."""
    seen, out = set(), []
    for doc_id, text in in_order(rows):
        all_ = (text or "").encode().split(b"\n")
        worded = [i for i, x in enumerate(all_) if x.strip(b" \t\n\r\x0b\x0c")]
        gone = set()
        for s in range(len(worded) - 2):
            w = tuple(all_[i] for i in worded[s : s + 3])
            if w in seen:
                gone |= set(worded[s : s + 3])
            seen.add(w)
        out.append((doc_id, len(worded), len(gone), b"\n".join(x for i, x in enumerate(all_) if i not in gone).decode()))
    return sorted(out, key=str)


def line_result(df):
    return sorted(((r["doc"]["doc_id"], r["n_lines"], r["n_removed"], r["doc"]["text"] or "") for r in lines.dedup_lines(df).collect()), key=str)


def test_lines(spark, odd, odd_rows, empty):
    want = brute_lines([(r[0], r[1]) for r in odd_rows])
    assert line_result(odd) == want
    assert [w[2] for w in want if w[0] == 10] == [3] and lines.dedup_lines(empty).count() == 0
    assert lines.clean_documents(odd).columns == odd.columns and lines.clean_documents(odd).where("text is null").count() == 1


def test_repeats_inside_a_document(spark):
    text = "\n".join(["a b", "c d", "e f"] * 3 + ["end x"])
    rows = [(2, text), (1, "e f\n\na b\nc d\n"), (3, "a b\nc d\n \ne f")]
    got = line_result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_lines(rows) and got[2][3] == " "


three, unlike = "a b\nc d\ne f", "keep one\nkeep two\nkeep three"
REUSED = [
    (1, three), (2, "\n".join(f"l{i} x" for i in range(20)) + "\n" + three), (2, "short"), (2, unlike), (2, three), (None, three), (None, "q r\ns t\nu v"), (None, "q r\ns t\nu v"),
    (5, unlike + "\nown"), (5, unlike + "\nown"), (5, unlike + "\nown"), (6, None), (6, None), (None, None),
]


def test_reused_and_null_ids(spark):
    """Rows that share an id keep their own cuts apart, equal rows lose what the first of them holds, rows without an id come last."""
    schema = "doc_id long, text string, __id long, __spans string, __row string, doc string, key long, place long"
    df = spark.createDataFrame([(*r, 1, "a", "b", "c", 2, 3) for r in REUSED], schema)
    want = brute_lines(REUSED)
    for n in (1, 5):
        assert line_result(df.repartition(n)) == want
    assert (2, 3, 0, unlike) in want and sum(w[2] for w in want if w[0] == 5) == 9 + 2  # ids 2 keep the first of unlike, the last two rows of 5 go whole
    out = lines.clean_documents(df)
    assert out.columns == df.columns and out.count() == len(REUSED) and {tuple(r)[2:] for r in out.collect()} == {(1, "a", "b", "c", 2, 3)}
    passages = [(i, t and t.replace("\n", " words that make this sentence long enough to count.\n")) for i, t in REUSED]
    got = sorted((str(r["doc_id"]), r["n_sentences"], r["n_removed"]) for r in substrings.remove_repeats(spark.createDataFrame(passages, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted((str(i), n, k) for i, n, k, _ in brute_passages(in_order([(i, t or "") for i, t in passages])))


def same_as_sql(spark, folder, rows, query, sql):
    """Whether the query's rows are those of DuckDB."""
    import duckdb

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    got = query(spark, str(folder))
    return sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, db.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()))


def test_oracle_with_reused_ids(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, REUSED, lines.op8, lines.ORACLE)


def test_sql_of_substrings(spark, tmp_path):
    passages = [(i, t and t.replace("\n", " words that make this sentence long enough to count.\n")) for i, t in REUSED]
    long = " ".join(f"W{k}" for k in range(55))
    odd = [(20, f"Wait... what?! {long}. é end"), (21, f"{long.lower()}.\r\n\n\té e.g. x.y ."), (22, ""), (23, " \n . ")]
    assert same_as_sql(spark, tmp_path, passages + odd, substrings.op4, substrings.ORACLE)


def test_substrings(spark, odd, odd_rows, empty):
    got = sorted((str(r["doc_id"]), r["n_sentences"], r["n_removed"], len(r["text"].split())) for r in substrings.remove_repeats(odd).collect())
    assert got == sorted((str(i), *rest) for i, *rest in brute_passages(in_order([(r[0], r[1] or "") for r in odd_rows])))
    twelve = substrings.remove_repeats(odd).where("doc_id = 12").first()
    assert twelve["first_doc_ids"] == [11] and "Different end here." in twelve["text"] and "second sentence" not in twelve["text"]
    assert substrings.remove_repeats(empty).count() == 0


def test_stops_are_read_once():
    raw = b"A start here " + b"." * 1_000_000 + b"x goes on. An end"
    began = time.perf_counter()
    assert [raw[s:e][-9:] for s, e in substrings.sentences(raw)] == [b" goes on.", b" An end"[-9:]]
    assert time.perf_counter() - began < 2


def test_sentences():
    raw = b"One two. Three!  Four\nfive? x"
    assert [raw[s:e].strip() for s, e in substrings.sentences(raw)] == [b"One two.", b"Three!", b"Four", b"five?", b"x"]


def brute_passages(rows):
    """Sentences of each document that lie in any passage of two sentences and 20 words, or of one with 50 words, that occurs before."""
    seen, out = set(), []
    for doc_id, text in rows:
        units = [x.lower().split() for x in re.split(r"(?<=[.!?])\s+|\n", text) if x.strip()]
        gone = set()
        for s in range(len(units)):
            for e in range(s + 1, len(units) + 1):
                n = sum(map(len, units[s:e]))
                if n >= 20 and e - s >= 2 or n >= 50 and e - s == 1:
                    key = tuple(map(tuple, units[s:e]))
                    if key in seen:
                        gone |= set(range(s, e))
                    seen.add(key)
        if gone:
            out.append((doc_id, len(units), len(gone), sum(len(units[i]) for i in range(len(units)) if i not in gone)))
    return out


def test_whole_passages_go(spark):
    sentence = lambda n, salt: " ".join(f"{salt}{k}" for k in range(n)) + "."
    passage = lambda sizes, salt: " ".join(sentence(n, f"{salt}x{i}w") for i, n in enumerate(sizes))
    rng, rows = random.Random(3), []
    shapes = [[60, 45], [30, 30, 5, 4], [15, 3, 15], [5, 4, 70, 2], [3, 2]] + [[rng.choice([1, 3, 8, 14, 25, 55]) for _ in range(rng.randrange(2, 9))] for _ in range(25)]
    for i, sizes in enumerate(shapes):
        p = passage(sizes, f"p{i}")
        rows += [(10 * i + k, f"{sentence(6, f'h{i}q{k}')} {p} {sentence(7, f't{i}q{k}')}") for k in range(2)]
        rows.append((10 * i + 5, p + " " + p))
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], len(r["text"].split())) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: tuple(x) for i, *x in brute_passages(rows)}
    assert got[1][2] == 13 and got[11][2] == 13  # of copies of [60, 45] and [30, 30, 5, 4] only head and tail stay
