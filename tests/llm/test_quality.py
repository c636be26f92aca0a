import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowtide.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for k in range(5)}
    rows, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            rows += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), rows, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab#| \n\té 😀", max_size=120))
def test_counts(text):
    assert quality.count_text(text.encode())[:5] == brute(text)


def test_bucket(spark):
    got = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    for r in got:
        shift = max(0, r["id"].bit_length() - quality.BITS)
        assert r["b"] == r["id"] >> shift << shift


def counted(spark, rows):
    """Rows of (lang, source, n_symbols) as counts of texts with 998 characters in 98 words."""
    columns = "lang string, source string, n_symbols long, word_chars long, n_dup_lines long, n_lines long, n_repeat_words long, n_words long"
    return quality.rates(spark.createDataFrame([(*r, 998, 0, 8, 0, 98) for r in rows], columns))


def test_sketches_merge(spark):
    rows = counted(spark, [("en" if i % 2 else None, f"s{i % 3}", i) for i in range(900)])
    half = quality.sketches(rows.where("n_symbols < 300")).unionByName(quality.sketches(rows.where("n_symbols >= 300")))
    a, b = (sorted(map(tuple, quality.merged_quantiles(x, ["lang"]).collect()), key=str) for x in (half, quality.sketches(rows)))
    assert a == b
    q = quality.merged_quantiles(half, []).where("metric = 'symbol_rate'").first()
    assert abs(q["q1"] - 226_000) <= 4096 and abs(q["q3"] - 676_000) <= 8192


def test_fences_follow_a_metric(spark):
    """A source that uses more symbols gets a fence further up, one with a wider spread a wider fence: no constant decides."""
    low, high, wide = ([(("en", s, f(i))) for i in range(400)] for s, f in (("low", lambda i: 1 + i % 3), ("high", lambda i: 40 + i % 30), ("wide", lambda i: 1 + i % 60)))
    got = {r["source"]: r["symbol_rate_fence"] for r in quality.fences(quality.sketches(counted(spark, low + high + wide))).collect()}
    assert 3000 < got["low"] < 100_000 < got["high"] < got["wide"] < quality.UNIT
    shifted = {r["source"]: r["symbol_rate_fence"] for r in quality.fences(quality.sketches(counted(spark, [(a, b, n + 20) for a, b, n in low]))).collect()}
    assert shifted["low"] > got["low"]


def test_oracle(spark, odd, tmp_path):
    import duckdb

    rows = odd.select("doc_id", "text", "lang", "source")
    more = spark.range(600).selectExpr("100 + id as doc_id", "concat_ws(' ', transform(sequence(1, 12 + cast(id % 40 as int)), k -> concat(if((id * k) % 17 = 0, '#', 'w'), id % 7, '-', k))) as text", "concat('l', id % 2) as lang", "concat('s', id % 5) as source")
    rows.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = quality.op7(spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({quality.ORACLE})").fetchall()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))


def test_verdicts(spark, odd, odd_rows, empty):
    clean = [(i, " ".join(f"word{(i * 31 + k) % 997}" for k in range(40)), "en", "s") for i in range(300)]
    junk = [(1000 + i, "a#$% b&&& " * 20 + " ".join(f"q{i}{k}" for k in range(90)), "en", "s") for i in range(5)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i, *_ in clean) and not any(got[i]["kept"] for i, *_ in junk)
    rows = quality.judge(odd).collect()
    assert len(rows) == len(odd_rows) and all(r["kept"] is not None and not (r["base_failed"] and r["kept"]) for r in rows)
    assert quality.judge(empty).count() == 0


def test_fences_move_and_stay_reachable(spark):
    """Fences follow the word lengths of a group, on either side; junk in two fifths of a group doesn't lift its fences out of reach."""
    word = lambda n, seed, size: "".join("abcdefghijklmnopqrstuvwxyz"[(seed * 7 + k * (seed % 11 + 1) + n) % 26] for k in range(size))
    text = lambda i, size: " ".join(word(k, i * 131 + k * 17, size + (k + i) % 3 - 1) for k in range(20 + i % 7))
    rows = [(i, text(i, 4), "en", "short") for i in range(200)] + [(1000 + i, text(i, 12), "en", "long") for i in range(200)]
    rows += [(2000, text(1, 12), "en", "short"), (2001, text(1, 4), "en", "long")]
    lines = lambda i, dup: "\n".join(x for k in range(20) for x in ([f"u{i}x{k} v{k}y{i} w{i}z{k} r{k}s{i} t{i}q{k}"] + ["same"] * dup))
    rows += [(3000 + i, lines(i, 0), "en", "lines") for i in range(120)] + [(4000 + i, lines(i, 1 + i % 3), "en", "lines") for i in range(80)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0]["word_length_fence"] < got[1000]["word_length_low"]
    assert all(got[i]["kept"] for i in [*range(200), *range(1000, 1200), *range(3000, 3120)])
    assert not got[2000]["kept"] and not got[2001]["kept"]
    junk = [got[4000 + i] for i in range(80)]
    assert all(r["dup_line_rate"] >= 450_000 and not r["base_failed"] and r["dup_line_rate_fence"] < quality.UNIT for r in junk)
    assert not any(r["kept"] for r in junk)
