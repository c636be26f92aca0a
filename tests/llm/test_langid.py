import zlib

import numpy as np
import pytest

from flowtide.llm import langid

WORDS = {"en": "the of and with that this", "de": "der die und nicht mit auch", "fr": "le les et pour avec dans", "es": "el los y para con pero"}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, " ".join((WORDS[lang].split() * 9)[i % 5 : 30 + i % 7]) + f" {i}", lang, "s") for i, lang in enumerate(list(WORDS) * 60)]
    return spark.createDataFrame([*rows, (1000, None, "en", "s"), (1001, "12 ½ !!", "en", "s"), (1002, WORDS["fr"] * 2, None, None), (None, WORDS["de"] * 3, "de", "s")], "doc_id long, text string, lang string, source string")


def test_accuracy(labelled):
    got = langid.identify(labelled).join(labelled.drop("text"), "doc_id").collect()
    own = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert own and sum(r["lang"] == r["lang_pred"] for r in own) / len(own) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    by = {r["doc_id"]: r for r in langid.identify(labelled).collect()}
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and by[1000]["score"] == 0 and by[1002]["lang_pred"] == "fr" and by[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in by.values())


def test_labels_are_no_inputs(labelled):
    model = langid.fit(labelled)
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(labelled, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in langid.predict(labelled.selectExpr("doc_id", "text", "'es' lang", "'q' source"), model).collect()}
    assert a == b


def test_odd(spark, odd, empty):
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and {4, 5, 13, 14}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() == odd.count() - 4
    assert langid.identify(empty).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(nothing).first()["lang_pred"] == "und"
    one = spark.createDataFrame([(i, "abc", "xx") for i in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"xx"}


@pytest.fixture(scope="module")
def many(spark):
    """40 languages, sorted by language: each has letters of its own."""
    letters = [chr(0x4E00 + 40 * k) for k in range(40)]
    rows = [(40 * i + k, " ".join(c + chr(ord(c) + (i * j) % 7) + "a" for j in range(12)), f"l{k:02d}") for k, c in enumerate(letters) for i in range(90)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartitionByRange(8, "lang").cache()


def test_many_languages(spark, many):
    """No language is left out, and reruns over other partitions agree."""
    got = langid.identify(many).collect()
    truth = {r["doc_id"]: r["lang"] for r in many.collect()}
    own = [r for r in got if r["held_out"]]
    assert {r["lang_pred"] for r in got} == set(truth.values()) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in own) > 0.95 * len(own)
    assert sorted(map(tuple, langid.identify(many.repartition(3)).collect())) == sorted(map(tuple, got))


def test_each_language_is_sampled(spark):
    """With many languages, clustered, each keeps its share of the sample; the same rows are drawn whatever the partitions."""
    rows = spark.range(0, 16 * 600).selectExpr("id as doc_id", "concat('word ', id) as text", "concat('l', id div 600) as lang")
    counts = [dict(langid.training_sample(rows.repartitionByRange(n, "doc_id")).groupBy("lang").count().collect()) for n in (2, 5)]
    assert counts[0] == counts[1] and len(counts[0]) == 16
    assert all(170 < n < 330 for n in counts[0].values()) and sum(counts[0].values()) < 1.1 * langid.MOST_ROWS


def test_packed():
    x = langid.features("Öl und Wasser, 日本".encode())
    at, value = langid.unpacked(langid.packed(x))
    assert (x[at] == value).all() and len(at) == (x > 0).sum()


def test_vectors_one_at_a_time(labelled):
    """Vectors are read one by one, so a task holds one of them; a row's result doesn't depend on the rows beside it."""
    model = langid.fit(labelled)
    texts = [r["text"].encode() for r in labelled.where("text is not null").limit(65).collect()]
    alive, most = 0, 0

    class Vector(np.ndarray):
        def __del__(self):
            nonlocal alive
            alive -= 1

    def vectors():
        nonlocal alive, most
        for raw in texts:
            v = langid.features(raw).view(Vector)
            alive += 1
            most = max(most, alive)
            yield v
            del v

    together = model.predict(vectors())
    assert most <= 3 and together == [model.predict([langid.features(raw)])[0] for raw in texts]
