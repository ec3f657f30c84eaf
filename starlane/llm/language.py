r"""Language identification by hierarchical discrimination.

First a multinomial naive Bayes model over hashed letter trigrams predicts the language's family; then linear support vector
machines, one for each pair of languages of that family, vote (one versus one). Families of well-known codes are given; a code that
is not listed is a family of its own.

The models are fitted on a sample of labelled rows, at most SAMPLE rows in all and PER_LANGUAGE for each language, taken by the order
of a hash of the id, each as a whole text and as two short pieces of it (so that short texts are known too). Everything else sees
all rows and whole texts.

Nulls, ties and the like: a null text and one without a letter is `und` with score 0; rows with a null id or null lang are never learned
from; where nothing can be learned everything is `und`; equal texts get equal results, and so do repeated rows; the letters of a long text are counted BLOCK bytes at a time; an empty table gives an empty result. Predictions
see the text only, and of other columns none is read, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, PER_LANGUAGE, PIECES = 2000, 400, 2
#: So many languages at most have the hashes of their ids bounded when the sample is drawn.
BOUNDED = 1 << 12
FEATURES = 4096
#: Bytes of a text whose letters are held as numbers at a time.
BLOCK = 1 << 20
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
# Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_WORDLIKE = re.compile(r"[^\W\d_]")
#: Bytes beyond ASCII and letters stay, everything else is a gap.
_LETTERS = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256)], np.uint32)


def held_out(doc_id: Column) -> Column:
    """Every fifth row by the CRC of its id; a null id is not held out (and is not learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def has_letter(text: str) -> bool:
    """Of what a pattern takes for a letter, some are numerals (one half, Roman one)."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def counts(text: str) -> np.ndarray:
    """How often each feature (a hash of three letters on end) stands in the text, BLOCK bytes at a time."""
    data, out = np.frombuffer(f" {text.lower()} ".encode(), np.uint8), np.zeros(FEATURES, np.int64)
    for at in range(0, data.size - 2, BLOCK):
        a = _LETTERS[data[at : at + BLOCK + 2]]
        out += np.bincount(((a[:-2] * 0x9E3779B1 + a[1:-1] * 0x85EBCA77 + a[2:] * 0xC2B2AE3D) & 0xFFFFFFFF) >> 20, minlength=FEATURES)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def pieces(text: str, seed: int) -> list[str]:
    """The text and two short pieces of it."""
    parts, rng, out = text.split(), np.random.default_rng(seed), [text]
    for _ in range(PIECES if parts else 0):
        first = int(rng.integers(len(parts)))
        out.append(" ".join(parts[first : first + int(rng.integers(1, 25))]))
    return out


def _svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge), by coordinate descent in the dual."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, a, q = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = max(0.0, a[i] - (y[i] * float(w @ x[i]) - 1 + a[i] * 0.5 / c) / q[i])
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                a[i] = new
    return w[:-1], float(w[-1])


class Model:
    """families[k]: languages; naive Bayes weights for each family; for each pair in a family a weight vector."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        by = defaultdict(list)
        for lang in sorted(set(langs)):
            by[_FAMILY.get(lang, f"only {lang}")].append(lang)
        self.families, y = [by[k] for k in sorted(by)], np.array(langs)
        theta = np.stack([x[np.isin(y, f)].sum(0) + 0.5 for f in self.families]) if self.families else np.zeros((0, FEATURES))
        self.bayes = np.log(theta / theta.sum(1, keepdims=True)).astype(np.float32)
        units, self.pairs = _unit(x), []
        for f in self.families:
            self.pairs.append({})
            for a, b in combinations(range(len(f)), 2):
                rows = np.isin(y, [f[a], f[b]])
                self.pairs[-1][a, b] = _svm(units[rows], np.where(y[rows] == f[a], 1.0, -1.0))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) for rows of counts."""
        logs = x.astype(np.float32) @ self.bayes.T
        logs -= logs.max(1, keepdims=True)
        share = np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
        family, units, out = share.argmax(1), _unit(x), [("und", 0.0)] * len(x)
        for k, langs in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            votes, sure = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for (a, b), (w, bias) in self.pairs[k].items():
                p = 1 / (1 + np.exp(-np.clip(4 * (units[rows] @ w + bias), -30, 30)))
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                sure[:, a] += p
                sure[:, b] += 1 - p
            best = (votes + sure / (10 * len(langs))).argmax(1)
            for i, j in zip(rows.tolist(), best.tolist(), strict=True):
                out[i] = langs[j], 0.0
            scores = share[rows, k] * (sure[np.arange(len(rows)), best] / max(1, len(langs) - 1) if len(langs) > 1 else 1)
            for i, s in zip(rows.tolist(), scores.tolist(), strict=True):
                out[i] = out[i][0], min(1.0, max(0.0, float(s)))
        return out


def training_rows(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most per_language rows of each language and sample in all, by the order of a hash of the id."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id"))
    # Of a language with many ids only as many as surely hold its first ones are dealt by language: those with hashes below a bound.
    # The largest BOUNDED languages have one; any other has at most one row in BOUNDED of them all.
    share = F.lit(4.0 * per_language + 200) / F.col("n")
    many = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).where(share < 1).orderBy(F.desc("n"), "lang").limit(BOUNDED)
    bounds = F.broadcast(many.select("lang", ((share * 2 - 1) * (2.0**63)).cast("long").alias("bound")))
    near_first = ids.join(bounds, "lang", "left").where(F.col("bound").isNull() | (F.col("h") <= F.col("bound"))).select("doc_id", "lang")
    ranked = near_first.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    chosen = ranked.where(F.col("rank") <= per_language).orderBy("rank", "lang").limit(sample).drop("rank")
    # chosen has at most `sample` rows.
    return known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, data = [], []
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            for piece in pieces(text.as_py(), zlib.crc32(text.as_buffer())):
                x = counts(piece)
                at = np.flatnonzero(x)
                langs.append(lang.as_py())
                data.append(np.concatenate([at, np.minimum(x[at], 65535)]).astype("<u2").tobytes())
        yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "data": pa.array(data, pa.binary())})


def fit(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Model:
    """The features of the bounded sample come to the driver, sparse: a few kB for each row of it."""
    rows = sorted(training_rows(docs, sample, per_language).mapInArrow(_featured, "lang string, data binary").collect(), key=lambda r: (r.lang, bytes(r.data)))
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        at, n = np.frombuffer(bytes(r.data), "<u2").reshape(2, -1)
        x[i, at] = n
    return Model(x, [r.lang for r in rows])


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, float]] = [("und", 0.0)] * batch.num_rows
            rows, x = [], []

            def flush() -> None:
                if rows and model.families:
                    for i, p in zip(rows, model.predict(np.stack(x)), strict=True):
                        out[i] = p
                rows.clear()
                x.clear()

            for i, value in enumerate(batch.column("text")):
                text = value.as_py() if value.is_valid else ""
                if has_letter(text):
                    rows.append(i)
                    x.append(counts(text))
                    if len(rows) == 256:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each of docs: doc_id, held_out, lang_pred, score."""
    model = fit(docs) if model is None else model
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_predictor(model), RESULT)
