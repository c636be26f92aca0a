"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs inside it.

Features are square roots of hashed byte trigram counts of the whole lower-cased text, scaled to length one. A family has one linear
SVM against all others, so their number grows with the families only; each two languages of a family have one between them. The
classifiers are fitted on the driver on a bounded sample of labelled rows: about ``PER_LANGUAGE`` of each language, fewer where the
languages would exceed ``MOST_ROWS`` together, but ``LEAST_ROWS`` at least, drawn by hash; no language is left out. Prediction runs
on every row where it lies. ``lang``, ``source`` and ``doc_id`` are no inputs of a prediction.

Defined cases: null text or text without a letter is ``und`` with score 0; rows with a null lang or null doc_id aren't learned from;
with nothing to learn from, all is ``und``; with one language, each text with a letter gets it. A language that no family lists is a
family of its own. Of equal margins the language or family first by name wins. Empty tables give no rows, repeated rows repeat, a text
of any length is one row in memory, extra columns are ignored or, in :func:`keep_known`, kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_map, ids_and_text, release_memory, table, utf8

#: Bounds of the training sample, in expected rows: of each language, of all languages, and of each language where those are many.
PER_LANGUAGE, MOST_ROWS, LEAST_ROWS = 400, 4000, 100
DIMENSIONS = 1 << 12
EPOCHS, COST = 12, 4.0
UNKNOWN = "und"
#: Families of common languages; parameters of the fit.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "semitic": ("ar", "he", "am", "mt"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
    "sinitic": ("zh", "yue"),
    "uralic": ("fi", "et", "hu"),
}
_LETTER = regex.compile(r"\p{L}")


def counts(raw: bytes) -> np.ndarray:
    """Square roots of the hashed trigram counts of a whole text."""
    a = np.frombuffer(b" " + raw.lower() + b" ", np.uint8).astype(np.uint32)
    code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761) >> np.uint32(20) if len(a) > 2 else np.zeros(0, np.uint32)
    return np.sqrt(np.bincount(code, minlength=DIMENSIONS)).astype(np.float32)


def features(raw: bytes) -> np.ndarray:
    """The feature vector of a whole text."""
    x = counts(raw)
    norm = float(np.sqrt(x @ x))
    return x / norm if norm else x


#: A feature vector by its places and values that aren't 0.
Sparse = tuple[np.ndarray, np.ndarray]


def packed(x: np.ndarray) -> bytes:
    """A feature vector as places (16 bits) and values (32 bits)."""
    at = np.flatnonzero(x).astype(np.uint16)
    return at.tobytes() + x[at].tobytes()


def unpacked(raw: bytes) -> Sparse:
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint16, n).astype(np.int64), np.frombuffer(raw[2 * n :], np.float32)


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"={lang}")


def fit_svm(rows: list[Sparse], y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss, by dual coordinate descent; both classes weigh the same."""
    sizes = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    slack = 1 / (COST * len(y) / np.where(y > 0, sizes[1], sizes[-1]))  # 1 / (2 cost)
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    q = np.array([float(v @ v) + 1 for _, v in rows]) + slack
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            at, value = rows[i]
            g = y[i] * (w[at] @ value + bias) - 1 + alpha[i] * slack[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * value
                bias += step
                alpha[i] = new
    return np.append(w, bias).astype(np.float32)


def certainty(margin: float) -> float:
    """Between 0 and 1, one half at no margin."""
    return float(1 / (1 + np.exp(-4 * np.clip(margin, -10, 10))))


@dataclass
class Model:
    """Stacked binary machines: one for each family (none where there is one family only), then one for each two languages of a family.
    A vote of a machine goes to ``first`` where its margin is positive."""

    languages: list[str]
    families: list[str]
    machines: np.ndarray  # [n, DIMENSIONS + 1]
    pairs: list[tuple[int, int]]  # the machines after those of families, by number of language

    @classmethod
    def fit(cls, rows: list[Sparse], langs: list[str]) -> Model:
        languages = sorted(set(langs))
        families = sorted({family_of(v) for v in languages})
        numbers = {v: i for i, v in enumerate(languages)}
        lang_no = np.array([numbers[v] for v in langs], int)
        fam_no = np.array([families.index(family_of(v)) for v in languages], int)[lang_no]
        pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family_of(languages[a]) == family_of(languages[b])]
        machines = [fit_svm(rows, np.where(fam_no == f, 1, -1)) for f in range(len(families))] if len(families) > 1 else []
        for a, b in pairs:
            own = np.flatnonzero((lang_no == a) | (lang_no == b))
            machines.append(fit_svm([rows[i] for i in own.tolist()], np.where(lang_no[own] == a, 1, -1)))
        return cls(languages, families, np.array(machines, np.float32).reshape(-1, DIMENSIONS + 1), pairs)

    def predict(self, x: Iterable[np.ndarray]) -> list[tuple[str, float]]:
        """Language and score (0 to 1) of each feature vector. One vector is held at a time, and none depends on its neighbours."""
        weights, bias = np.ascontiguousarray(self.machines[:, :-1]), self.machines[:, -1]
        cut = len(self.families) if len(self.families) > 1 else 0
        members: list[list[int]] = [[i for i, v in enumerate(self.languages) if family_of(v) == name] for name in self.families]
        between = [[k for k, (a, _) in enumerate(self.pairs) if a in own] for own in map(set, members)]
        out = []
        for v in x:
            m = weights @ v + bias
            fam, p = 0, 1.0
            if cut:
                fam = int(np.argmax(m[:cut]))
                p = certainty((m[fam] - np.max(np.delete(m[:cut], fam))) / 2)
            own = members[fam]
            votes, sums, least = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0), dict.fromkeys(own, np.inf)
            for k in between[fam]:
                (a, b), margin = self.pairs[k], m[cut + k]
                votes[a if margin > 0 else b] += 1
                sums[a] += margin
                sums[b] -= margin
                least[a], least[b] = min(least[a], margin), min(least[b], -margin)
            best = max(own, key=lambda v: (votes[v], sums[v], -v))
            out.append((self.languages[best], p * (certainty(least[best]) if len(own) > 1 else 1.0)))
        return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame) -> DataFrame:
    """lang and features of the bounded sample."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not sizes:
        return rows.limit(0).select("lang", F.lit(b"").alias("x"))
    each = max(LEAST_ROWS, min(PER_LANGUAGE, MOST_ROWS / len(sizes)))
    rates = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, each / r["count"]))])
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < rates[F.col("lang")] * (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [packed(features(raw)) for raw in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(x, pa.binary())], ["lang", "x"])

    return arrow_map(rows.where(drawn).select("lang", "text"), run, "lang string, x binary")


def fit(docs: DataFrame) -> Model | None:
    """A model, or None where there is nothing to learn from."""
    sample = training_sample(docs).toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    if not sample.num_rows:
        return None
    model = Model.fit([unpacked(x) for x in sample["x"].to_pylist()], sample["lang"].to_pylist())
    del sample
    release_memory()  # the driver keeps nothing of the sample
    return model


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """doc_id, the columns named by ``keep``, lang_pred and score of each row."""
    rows = docs.select("doc_id", "text", *keep)
    kept = [f for f in rows.schema if f.name != "text" or "text" in keep]
    names = [f.name for f in kept]
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a machine (16 KB) for each family and each two languages of one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for cut in range(0, batch.num_rows, 1000):
                part = batch.slice(cut, 1000)
                raws = utf8(part["text"].cast(pa.string()))
                some = [i for i, raw in enumerate(raws) if model and raw and _LETTER.search(raw.decode("utf-8", "replace"))]
                langs, scores = [UNKNOWN] * len(raws), [0.0] * len(raws)
                if some:
                    for i, (lang, score) in zip(some, model.predict(features(raws[i]) for i in some), strict=True):
                        langs[i], scores[i] = lang, score
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return arrow_map(rows, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that aren't held out and predict every row: doc_id, held_out, lang_pred, score."""
    rows = ids_and_text(docs, "lang")
    return predict(rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), fit(rows), "held_out")


def keep_known(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is identified with at least ``least_score``; all columns stay as they are."""
    names = docs.columns
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("__doc"))
    found = predict(rows, fit(ids_and_text(docs, "lang")), "__doc")
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return found.select(*[F.col("__doc").getField(n).alias(n) for n in names])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6_langid."""
    return identify(table(spark, sf_dir, "documents"))
