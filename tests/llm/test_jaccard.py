import random

import numpy as np

from flowtide.llm import jaccard as J
from flowtide.llm.repeats import numbered_rows

SCHEMA = "doc_id long, text string"


def brute(rows):
    """component_id and set size of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 75 * (len(x) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(sets[i]), low.get(find(i), -1) if sets[i] else (d if d is not None else -1)) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in J.near_duplicates(df).collect())


def test_odd(spark, odd, odd_rows, empty):
    assert result(odd) == brute([(r[0], r[1]) for r in odd_rows])
    assert J.near_duplicates(empty).count() == 0


def test_near_copies(spark):
    """Groups of near copies around the threshold, a shared passage, and clean documents, in many partitions."""
    rng = random.Random(5)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]
    rows, passage = [], words(40)
    for g in range(6):
        base = words(rng.choice([30, 80, 200]))
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(words(60) + passage + words(20))) for i in range(60)]
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_common_shingles(spark):
    """A passage that most documents share is counted once a task and still takes part in every overlap, in packs of any size."""
    rng = random.Random(9)
    words = lambda n: [f"{rng.choice('abc')}{rng.randrange(5000)}" for _ in range(n)]
    passage = words(50)
    rows = [(i, " ".join(words(rng.randrange(0, 25)) + passage + words(rng.randrange(0, 25)))) for i in range(150)]
    rows += [(len(rows) + i, " ".join(words(80))) for i in range(20)]
    whole = result(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert whole == brute(rows) and len({c for _, _, c in whole}) < len(rows) - 20
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    packed = J.packed_shingles(numbered_rows(df), 1 << 20)
    common = sum(len(J._unpack(r["a"])) for r in packed.where("frag >= 0").collect())
    assert common < sum(n for _, n, _ in whole) - 140 * 46 and packed.where(f"frag = {J.SETS}").count() == 3
    sets = J.named_sets(packed).collect()
    assert sorted(r["key"] for r in sets if r["key"] is not None) == [i for i, _ in rows]
    keys = {r["nid"]: len(r["keys"]) for r in sets if r["key"] is None}
    assert all(n == 46 for n in keys.values()) and len(keys) == sum(n <= 61 for _, n, _ in whole[:150]) > 20  # longer sets can have no link


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (3, 7), (20, 21), (21, 22), (22, 20)]
    got = {r["node"]: r["root"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 7: 1, 10: 9, 21: 20, 22: 20}


def test_drop(spark, odd):
    kept = [r["doc_id"] for r in J.drop_near_duplicates(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 4, 5, 6, 8, 9, 10, 11, 13, 14, 15, 16] and kept.count(None) == 1
    assert J.drop_near_duplicates(odd).columns == odd.columns


def test_drop_keeps_unlike_texts(spark):
    """Null ids and reused ids: each unlike text stays, and of a component with an id the row with the id."""
    text = lambda salt: " ".join(f"{salt}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("d")), (7, text("d")), (9, text("e")), (None, text("e")), (None, text("f") + " g"), (None, text("f")), (8, ""), (8, ""), (None, None)]
    kept = sorted(map(tuple, J.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    assert len(kept) == 9  # rows without words all stay
    assert set(kept) - {(None, text("f") + " g"), (None, text("f"))} == {(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (9, text("e")), (8, ""), (None, None)}


def test_drop_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, "x", 2, 3), (2, "a b c d e f", 1, "x", 2, 3), (None, "q r s", 4, "y", 5, 6)]
    names = "doc_id long, text string, __id long, key string, place long, n long, name1 long, doc string, `odd name` string"
    df = spark.createDataFrame([(*r, 7, "d", "o") for r in rows], names)
    for d in (df, df.where("doc_id = 1")):
        kept = J.drop_near_duplicates(d)
        assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, d.where("doc_id is null or doc_id = 1").collect()))


def test_pack():
    x = np.array([0, 5, 2**40, 2**63], np.uint64)
    assert (J._unpack(J._pack(x)) == x).all()
    assert [J.prefix_length(n) for n in (1, 4, 100)] == [1, 2, 26]


def test_oracle(spark, odd, tmp_path):
    """The SQL on rows with an id each: odd ones, chains of near copies, upper case and exact copies."""
    import duckdb

    base = [f"w{i}" for i in range(80)]
    chain = [" ".join([f"c{k}" if i < 3 * k else w for i, w in enumerate(base)]) for k in range(8)]
    texts = [*chain, *chain[:3], chain[5].upper(), "a b c d", "A b\tc\nd", "a b c d e", "É b", "é b"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], SCHEMA)
    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(more)
    rows.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = J.op2(spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({J.ORACLE})").fetchall()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))
    assert len({r[2] for r in want if 100 <= r[0] < 108}) < 8


def test_class_is_named_by_its_first_row(spark, odd):
    got = {r["doc_id"]: r["class_id"] for r in J.near_duplicates(odd).collect()}
    assert got[1] == got[2] == "1" and got[3] == "3" and got[6] == got[7] == "6" and got[4] is got[5] is got[13] is got[None] is None
