"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A text's features are its lower-cased words and their character n-grams (by UTF-8 byte, with a mark at both ends of a word),
hashed into ``BUCKETS`` embeddings. A word that was never seen still shares n-grams, and so vectors, with its spellings that
were. The average of the embeddings goes through a linear layer and a softmax over two classes; embeddings and layer
are trained together by Adagrad. For scoring, embedding times layer is folded into one number for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import written
from .textblocks import LOWERED, U64, blocks, mixed, span_hashes, wide, word_table

#: Labelled texts that the model is fitted on at most, toxic and other, taken in the order of a hash of doc_id.
MOST_TOXIC, MOST_OTHER = 1500, 3000
#: Bytes of text of that sample at most: labelled texts in the same order, as far as these reach.
MOST_BYTES = 32 << 20
BUCKETS, DIM, GRAMS = 1 << 18, 4, (3, 4, 5)
#: Passes over the sample: EPOCHS, or more of a small one so that there are STEPS batches.
EPOCHS, STEPS, BATCH, RATE, SCALE, SEED = 5, 600, 64, 0.5, 32.0, 5
#: Features of weight 0 that each average holds besides a text's own: a few words alone decide little.
PRIOR = 40
#: Letters of words: a-z and everything from 0x80 (A-Z are lower-cased before).
LETTERS = word_table(inside=bytes([*range(97, 123), *range(128, 256)]))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a block's texts, and the text of each, ascending within each kind of feature."""
    size = np.diff(offs)
    n_docs = len(size)
    spaced = np.full(len(data) + n_docs + 1, 32, np.uint8)  # a mark before, between and after the texts
    doc = np.repeat(np.arange(n_docs), size)
    spaced[np.arange(len(data)) + doc + 1] = LOWERED[data]
    letter = LETTERS[spaced]
    spaced[~letter] = 32
    owner = np.zeros(len(spaced), np.int64)
    owner[1:] = np.repeat(np.arange(n_docs), size + 1)
    view = wide(spaced)
    marks = np.r_[0, np.cumsum(~letter)]
    found, docs = [], []
    for n in GRAMS:
        i = np.arange(max(0, len(spaced) - n + 1))
        i = i[(marks[i + n - 1] == marks[i + 1]) & letter[i + 1]]
        found.append(span_hashes(view, i, i + n))
        docs.append(owner[i + 1])
    first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    last = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    found.append(mixed(span_hashes(view, first, last)))
    docs.append(owner[first])
    return (np.concatenate(found) & U64(BUCKETS - 1)).astype(np.int32), np.concatenate(docs).astype(np.int32)


class SubwordSoftmax:
    """fit() on texts and labels; score() gives the probability of label 1."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        self.weights, self.bias = np.zeros(BUCKETS, np.float32) if weights is None else weights, bias

    def fit(self, texts: list[str | None], labels: np.ndarray, odds: float | None = None) -> SubwordSoftmax:
        """odds: of label 1 where the texts come from, if they were not drawn alike from both classes.

        With one class only the score is 0 or 1 for every text, and 0 without any texts.
        """
        labels = np.asarray(labels, np.int64)
        share = float(labels.mean()) if len(labels) else 0.0
        if share in (0.0, 1.0):
            self.bias = 20.0 if share else -20.0
            return self
        index, value, cuts = self._bags(texts)
        rng = np.random.default_rng(SEED)
        emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
        layer, bias = rng.random((DIM, 2), np.float32) - 0.5, np.log(np.array([1 - share, share], np.float32))
        g_emb, g_layer, g_bias = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        epochs = max(EPOCHS, -(-STEPS // -(-len(labels) // BATCH)))
        for epoch in range(epochs):
            rate = np.float32(RATE * (1 - epoch / epochs))
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                size = cuts[rows + 1] - cuts[rows]
                flat = np.repeat(cuts[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                bucket, share_of, owner = index[flat], value[flat].astype(np.float32) / np.float32(1024), np.repeat(np.arange(len(rows)), size)
                near = emb[bucket]
                mean = np.stack([np.bincount(owner, share_of * near[:, k], minlength=len(rows)) for k in range(DIM)], axis=1).astype(np.float32) * np.float32(SCALE)
                z = mean @ layer + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), labels[rows]] -= 1
                p /= len(rows)
                back = (SCALE * (p @ layer.T)).astype(np.float32)
                for k in range(DIM):
                    step = np.bincount(bucket, share_of * back[owner, k], minlength=BUCKETS).astype(np.float32)
                    g_emb[:, k] += step**2
                    emb[:, k] -= rate * step / np.sqrt(g_emb[:, k])
                d_layer, d_bias = mean.T @ p, p.sum(axis=0)
                g_layer += d_layer**2
                layer -= rate * d_layer / np.sqrt(g_layer)
                g_bias += d_bias**2
                bias -= rate * d_bias / np.sqrt(g_bias)
        self.weights = (SCALE * (emb @ (layer[:, 1] - layer[:, 0]))).astype(np.float32)
        self.bias = float(bias[1] - bias[0]) + (float(np.log(odds * (1 - share) / share)) if odds else 0.0)
        return self

    @staticmethod
    def _bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct buckets with their shares, one text behind the other; in small blocks, as this is the driver's memory."""
        index, value, cuts = [], [], [0]
        for _, data, offs in blocks(iter([pa.RecordBatch.from_arrays([pa.array([t or "" for t in texts], pa.large_string())], ["text"])]), most=1 << 18):
            bucket, doc = features(data, offs)
            keys, n = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            owner = keys // BUCKETS
            total = np.bincount(doc, minlength=len(offs) - 1)
            index.append((keys % BUCKETS).astype(np.int32))
            value.append((1024 * n / (total[owner] + PRIOR)).astype(np.float16))  # shares of a few in ten thousand, out of its subnormal range
            cuts += (cuts[-1] + np.cumsum(np.bincount(owner, minlength=len(offs) - 1))).tolist()
        flat = np.concatenate(index)
        index.clear()
        return flat, np.concatenate(value), np.array(cuts)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        bucket, doc = features(data, offs)
        n = np.bincount(doc, minlength=len(offs) - 1) + PRIOR
        z = np.bincount(doc, self.weights[bucket], minlength=len(offs) - 1) / n + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id):
    """Rows whose labels are never learned from: crc32 of the decimal doc_id divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """i, text and toxic of at most MOST_TOXIC and MOST_OTHER labelled ids that are not held out and MOST_BYTES of text.

    Null labels are left out. Of rows of docs that share an id the least text counts, so the sample is bounded whatever repeats.
    """
    known = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i")))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("i"), "i").limit(most) for k, most in ((1, MOST_TOXIC), (0, MOST_OTHER))]
    picked = F.broadcast(parts[0].unionByName(parts[1]).distinct())  # at most MOST_TOXIC + MOST_OTHER ids
    found = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("text")).join(picked, "i").groupBy("i", "toxic").agg(F.min("text").alias("text"))
    found = written(found, "sample")
    upto = Window.orderBy(F.xxhash64("i"), "i", "toxic").rowsBetween(Window.unboundedPreceding, 0)
    fits = found.select("i", "toxic", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(upto).alias("size")).where(F.col("size") <= MOST_BYTES)
    return found.join(F.broadcast(fits.select("i", "toxic")), ["i", "toxic"]).select("i", "text", "toxic")


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> SubwordSoftmax:
    rows = sorted(training_texts(docs, labels).toLocalIterator(), key=lambda r: (r["i"], r["text"] or ""))
    share = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    odds = share / (1 - share) if share and share < 1 else None
    return SubwordSoftmax().fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), odds)


def score_toxicity(docs: DataFrame, model: SubwordSoftmax, column: str = "score") -> DataFrame:
    """docs with a column score (0 to 1) added or replaced; a null or empty text has the score of the model's bias alone.

    docs: a text column and any others, which stay. Scores depend on nothing but the text.
    """
    keep = [f for f in docs.schema.fields if f.name != column]
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SubwordSoftmax(*sent.value)
        for part, data, offs in blocks(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.score(data, offs))], [*part.schema.names, column])

    return docs.select([f.name for f in keep]).mapInArrow(score, T.StructType([*keep, T.StructField(column, T.DoubleType())]))
