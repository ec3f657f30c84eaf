r"""Toxicity by a linear-chain conditional random field over words.

The field tags each word as offending or not. Its features are the word and its first four to six letters, hashed;
its transitions tie neighbours. It is trained on labelled tokens: in documents marked toxic, words that have a feature seen far more
often in toxic than in other documents. Forward-backward gives each word's marginal; the largest marginal and the (log of the) sum
of marginals give the document's score through a logistic function fitted to the documents' labels, and words with a marginal of
one half or more are the offending offsets.

Fitting uses at most SAMPLE[1] toxic and SAMPLE[0] other documents, by the order of a hash of the id, and their whole texts. Which words are
labelled is counted over all of them, and the logistic function is fitted to all of them, both in tasks. The field is trained on the driver, on pieces of PIECE words, which come there
as numbers of features: those that hold a labelled word, MARKED at most, and of the others CLEAN[0] for each of these and CLEAN[1] more, both by the order of a
hash. Everything else sees all rows and whole texts. Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0.

Nulls, ties and the like: a null or empty text has no words and the score of a text without any; a document with several labels is
toxic if one says so; a text of millions of words takes time and memory in proportion to its length; repeated rows are scored alike and learned from once; null ids and null labels are not learned from; where either class has no sample every score is the share of
toxic labels; an empty table gives an empty result. Scores depend on the text only.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlane.llm.common import materialize
from starlane.llm.language import held_out

SAMPLE = (3000, 1500)
#: Pieces without a labelled word that the field is trained on: so many for each piece with one, and so many more.
CLEAN = (2, 500)
#: Pieces with a labelled word that the field is trained on at most. With CLEAN a bound on what the driver holds, about half a kilobyte for each piece.
MARKED = 20_000
HASH = 1 << 16
PIECE, LEAST, LIFT = 64, 3, 20.0
CACHE = 100_000
#: Bytes of text that a task holds as words at a time.
HELD = 4 << 20
_SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
RESULT = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offsets", T.ArrayType(_SPAN))]
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    parts = [f"w{word}", *(f"{k}{word[:k]}" for k in range(4, 7) if len(word) >= k)]
    return [zlib.crc32(p.encode()) % HASH for p in parts]


def _step(front: tuple, m: np.ndarray, e: np.ndarray) -> tuple:
    f0, f1 = front[0] * m[0, 0] + front[1] * m[1, 0], (front[0] * m[0, 1] + front[1] * m[1, 1]) * e
    s = f0 + f1
    return f0 / s, f1 / s


def forward_backward(u: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of padded rows: forward (state 1's share), backward (state 1's share), marginals of state 1, and exp of the scores."""
    n, steps = u.shape
    m, e = np.exp(trans), np.exp(np.clip(u, -30, 30))
    fore, back = np.zeros((steps, n)), np.zeros((steps, n))
    f = (1 / (1 + e[:, 0]), e[:, 0] / (1 + e[:, 0]))
    fore[0] = f[1]
    for t in range(1, steps):
        f = _step(f, m, e[:, t])
        fore[t] = f[1]
    b0 = b1 = np.full(n, 0.5)
    back[-1] = b1
    for t in range(steps - 2, -1, -1):
        x = e[:, t + 1] * b1
        n0, n1 = m[0, 0] * b0 + m[0, 1] * x, m[1, 0] * b0 + m[1, 1] * x
        s, ends = n0 + n1, t + 1 >= sizes
        b0, b1 = np.where(ends, 0.5, n0 / s), np.where(ends, 0.5, n1 / s)
        back[t] = b1
    one, zero = fore * back, (1 - fore) * (1 - back)
    return fore.T, back.T, (one / (one + zero)).T, e


def _in_pieces(u: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals of state 1 of texts that lie one after the other in u, each with a word or more.

    Texts are cut into pieces of PIECE words. The product of a piece's transfer matrices carries the forward vector over it (and the
    backward vector the other way), so that vectors at the edges of pieces take a step for each piece of the longest text, and
    inside of pieces all of them go at once: a long text costs no more steps than a short one does.
    """
    many = -(-sizes // PIECE)
    text_of = np.repeat(np.arange(sizes.size), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(PIECE, sizes[text_of] - nth * PIECE)
    inside = np.arange(PIECE) < length[:, None]
    e = np.ones((length.size, PIECE))
    e[inside] = np.exp(np.clip(u, -30, 30))
    e, inside, start = np.ascontiguousarray(e.T), inside.T, nth == 0
    m = np.exp(trans)
    # Before a text's first word there is no transition.
    first = [np.where(start, float(i == j), m[i, j]) for i in (0, 1) for j in (0, 1)]
    at = lambda t: first if t == 0 else (m[0, 0], m[0, 1], m[1, 0], m[1, 1])

    k = [np.ones(length.size), np.zeros(length.size), np.zeros(length.size), np.ones(length.size)]
    for t in range(PIECE if many.max() > 1 else 0):
        m00, m01, m10, m11 = at(t)
        new = [k[0] * m00 + k[1] * m10, (k[0] * m01 + k[1] * m11) * e[t], k[2] * m00 + k[3] * m10, (k[2] * m01 + k[3] * m11) * e[t]]
        total = sum(new)
        k = [np.where(inside[t], x / total, y) for x, y in zip(new, k, strict=True)]

    entry, leave = np.full((2, length.size), 0.5), np.full((2, length.size), 0.5)
    begin = np.cumsum(many) - many
    for r in range(1, many.max()):
        p = begin[many > r] + r - 1
        f0, f1 = entry[0, p] * k[0][p] + entry[1, p] * k[2][p], entry[0, p] * k[1][p] + entry[1, p] * k[3][p]
        entry[:, p + 1] = f0 / (f0 + f1), f1 / (f0 + f1)
    for r in range(many.max() - 1, 0, -1):
        p = begin[many > r] + r
        b0, b1 = k[0][p] * leave[0, p] + k[1][p] * leave[1, p], k[2][p] * leave[0, p] + k[3][p] * leave[1, p]
        leave[:, p - 1] = b0 / (b0 + b1), b1 / (b0 + b1)

    fore, f = np.empty((PIECE, length.size)), tuple(entry)
    for t in range(PIECE):
        m00, m01, m10, m11 = at(t)
        f0, f1 = f[0] * m00 + f[1] * m10, (f[0] * m01 + f[1] * m11) * e[t]
        f = f0 / (f0 + f1), f1 / (f0 + f1)
        fore[t] = f[1]
    b0, b1 = leave
    for t in range(PIECE - 1, -1, -1):
        one, zero = fore[t] * b1, (1 - fore[t]) * b0
        x = e[t] * b1
        # The transition into a text's first word is never asked for: nothing stands before it.
        n0, n1 = m[0, 0] * b0 + m[0, 1] * x, m[1, 0] * b0 + m[1, 1] * x
        s = n0 + n1
        b0, b1 = np.where(inside[t], n0 / s, b0), np.where(inside[t], n1 / s, b1)
        fore[t] = one / (one + zero)
    return fore.T[inside.T]


class Field:
    def __init__(self):
        self.weights, self.bias, self.trans = np.zeros(HASH), -2.0, np.zeros((2, 2))
        self.logistic = np.zeros(3)
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def scores(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.bias + float(self.weights[features(w)].sum())
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Of state 1, for each word of each text. Texts go side by side in pieces; see _in_pieces."""
        sizes = np.array([s.size for s in scores])
        if not sizes.sum():
            return [np.zeros(0) for _ in scores]
        flat = _in_pieces(np.concatenate(scores), sizes[sizes > 0], self.trans)
        return np.split(flat, np.cumsum(sizes)[:-1])

    def train(self, pieces: list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]], epochs: int = 6, rate: float = 0.2, batch: int = 128) -> None:
        """Largest conditional likelihood by AdaGrad; a piece is ((features of its words one after the other, how many each word has), labels)."""
        rng, seen, seen_t, seen_b = np.random.default_rng(11), np.full(HASH, 1e-6), np.full((2, 2), 1e-6), 1e-6
        flat, many = [f for (f, _), _ in pieces], [n for (_, n), _ in pieces]
        for _ in range(epochs):
            for block in np.array_split(rng.permutation(len(pieces)), max(1, len(pieces) // batch)):
                sizes = np.array([many[i].size for i in block])
                steps = int(sizes.max())
                mask = np.arange(steps) < sizes[:, None]
                ids, counts = np.concatenate([flat[i] for i in block]).astype(np.int64), np.concatenate([many[i] for i in block]).astype(np.int64)
                u, y = np.full((len(block), steps), -30.0), np.zeros((len(block), steps))
                u[mask] = self.bias + np.add.reduceat(self.weights[ids], np.cumsum(counts) - counts)
                y[mask] = np.concatenate([pieces[i][1] for i in block])
                fore, back, p, e = forward_backward(u, sizes, self.trans)
                d = (y - p) * mask
                g = np.bincount(ids, np.repeat(d[mask], counts), HASH)
                m, gt, pair = np.exp(self.trans), np.zeros((2, 2)), mask[:, 1:]
                fs, bs = (1 - fore[:, :-1], fore[:, :-1]), (1 - back[:, 1:], back[:, 1:] * e[:, 1:])
                xi = np.array([[fs[i] * m[i, j] * bs[j] for j in (0, 1)] for i in (0, 1)])
                xi /= xi.sum((0, 1))
                for i in (0, 1):
                    for j in (0, 1):
                        gt[i, j] = (((y[:, :-1] == i) & (y[:, 1:] == j) & pair) - xi[i, j] * pair).sum()
                g, gt, gb = g / len(block) - 1e-5 * self.weights, gt / len(block) - 1e-3 * self.trans, d.sum() / len(block)
                seen, seen_t, seen_b = seen + g * g, seen_t + gt * gt, seen_b + gb * gb
                self.weights += rate * g / np.sqrt(seen)
                self.trans += 0.2 * rate * gt / np.sqrt(seen_t)
                self.bias += rate * gb / np.sqrt(seen_b)
        self._known = {}

    @staticmethod
    def summary(p: np.ndarray) -> tuple[float, float, float]:
        return (1.0, float(p.max()), float(np.log1p(p.sum()))) if p.size else (1.0, 0.0, 0.0)

    def calibrate(self, x: np.ndarray, labels: np.ndarray, toxic_share: float) -> None:
        """Newton steps for the logistic function of summaries (a row for each document), its constant set for the share of toxic labels in all rows."""
        w = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (labels - p) - 0.05 * w)
        mean = labels.mean()
        w[0] += np.log(toxic_share / (1 - toxic_share)) - np.log(mean / (1 - mean))
        self.logistic = w

    def document(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.summary(p), self.logistic), -30, 30))))


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def names(word: str) -> list[str]:
    """What a word is counted under: itself and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in range(4, 7) if len(word) > k)]


def training_rows(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(text, y) of the sample, whole texts, each once; the count of labelled rows by y over all."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    first = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y])
    # At most sum(sample) ids.
    chosen = docs.select("doc_id", "text").join(F.broadcast(first(0).unionByName(first(1))), "doc_id")
    return chosen.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "y").distinct(), known.groupBy("y").agg(F.count("*").alias("n"))


def offending(rows: DataFrame) -> set[str]:
    """Words and beginnings that LEAST toxic texts or more have, LIFT times as frequent in them as in others; counted over whole texts in tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                found = sorted({n for w in set(tokens(text.as_py())) for n in names(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], ["name", "y"])

    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    by = rows.mapInArrow(each, "name string, y int").groupBy("name").agg(F.sum("y").alias("one"), F.sum(1 - F.col("y")).alias("zero"))
    lift = F.col("one") / float(max(1, n.get(1, 0))) >= LIFT * (F.col("zero") + 0.5) / float(max(1, n.get(0, 0)))
    return {r.name for r in by.where((F.col("one") >= LEAST) & lift).select("name").collect()}


def cut(rows: DataFrame, bad: set[str]) -> DataFrame:
    """Pieces of PIECE words of all texts: features of the words, how many each has, labels; marked if a word is labelled; place, a hash by which some are taken."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                words, out = tokens(text.as_py()), []
                for i in range(0, len(words), PIECE):
                    piece = words[i : i + PIECE]
                    ids = [features(w) for w in piece]
                    tags = bytes(bool(y) and not bad.isdisjoint(names(w)) for w in piece)
                    data = np.array([f for x in ids for f in x], np.uint16).tobytes(), bytes(map(len, ids)), tags
                    out.append((*data, any(tags), hashlib.md5(f"{i}:{y}:".encode() + data[0]).digest()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()), strict=True)], ["features", "many", "labels", "marked", "place"])

    return rows.mapInArrow(each, "features binary, many binary, labels binary, marked boolean, place binary")


def _arrays(rows: list) -> list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]]:
    return [((np.frombuffer(r.features, np.uint16), np.frombuffer(r.many, np.uint8)), np.frombuffer(r.labels, np.uint8).astype(float)) for r in rows]


def summaries(rows: DataFrame, field: Field) -> DataFrame:
    """y and what the logistic function sees of each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = field.marginals([field.scores(tokens(v.as_py())) for v in batch.column("text")])
            x = np.array([field.summary(p) for p in found])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x[:, 1]), pa.array(x[:, 2])], ["y", "most", "all"])

    return rows.mapInArrow(each, "y int, most double, all double")


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, clean: tuple[int, int] = CLEAN, marked: int = MARKED) -> Field:
    """Counts, pieces and summaries of the sample's whole texts are made in tasks; the driver gets pieces as numbers, as many as marked and clean say (see MARKED and CLEAN), and two numbers for each text."""
    rows, share = training_rows(docs, labels, sample)
    counts = {r.y: r.n for r in share.collect()}
    rows = materialize(rows, "toxicity-sample")
    classes = {r.y for r in rows.select("y").distinct().collect()}
    field, total = Field(), sum(counts.values())
    toxic_share = min(max(counts.get(1, 0) / total if total else 0.0, 1e-6), 1 - 1e-6)
    if len(classes) < 2:
        field.logistic = np.array([np.log(toxic_share / (1 - toxic_share)), 0.0, 0.0])
        return field
    rows = rows.repartition(min(sum(sample), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    pieces = materialize(cut(rows, offending(rows)), "toxicity-pieces")
    first = lambda which, most: pieces.where(which).orderBy("place").limit(most).collect()
    told = first("marked", marked)
    field.train(_arrays(told) + _arrays(first("NOT marked", clean[0] * len(told) + clean[1])))
    seen = np.array(sorted(map(tuple, summaries(rows, field).collect())))
    field.calibrate(np.column_stack([np.ones(len(seen)), seen[:, 1:]]), seen[:, 0], toxic_share)
    return field


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Character offsets in the text of runs of offending words; lower-casing may change lengths, so words are found in the text as it is where it does."""
    low = text.lower()
    found = [m.span() for m in _WORD.finditer(low if len(low) == len(text) else text)]
    if len(found) != p.size:
        return []
    out: list[list[int]] = []
    last = -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        if i == last + 1:
            out[-1][1] = found[i][1]
        else:
            out.append([*found[i]])
        last = i
    return [{"first": a, "last": b} for a, b in out]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of about HELD bytes of text, so that memory does not follow the number of rows in a batch."""
    for batch in batches:
        first = held = 0
        for i, value in enumerate(batch.column("text")):
            held += len(value.as_buffer()) if value.is_valid else 0
            if held >= HELD:
                yield batch.slice(first, i + 1 - first)
                first, held = i + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


def _scorer(field: Field):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in _pieces(batches):
            column = batch.column("text")
            scores = [field.scores(tokens(v.as_py())) if v.is_valid else np.zeros(0) for v in column]
            found = field.marginals(scores)
            docs = [field.document(p) for p in found]
            offsets = [_spans(column[i].as_py(), p) if p.size and p.max() >= 0.5 else [] for i, p in enumerate(found)]
            arrays = [pa.array(docs, pa.float64()), pa.array([int(d >= 0.5) for d in docs], pa.int32()), pa.array(offsets, span)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "score", "predicted", "offsets"])

    return score


def score(docs: DataFrame, field: Field) -> DataFrame:
    """docs with score, predicted and offsets (character spans of offending words); own columns of those names are replaced."""
    own = docs.drop("score", "predicted", "offsets")
    return own.mapInArrow(_scorer(field), T.StructType(own.schema.fields + RESULT))


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """docs, all columns as they are, without those predicted to be toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = field.marginals([field.scores(tokens(v.as_py())) if v.is_valid else np.zeros(0) for v in batch.column("text")])
            yield batch.filter(pa.array([field.document(p) < 0.5 for p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
