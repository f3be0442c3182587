"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are byte n-grams (2 to 4 bytes, with a space for each word border) of the text with A-Z lower-cased and
other ASCII non-letters read as spaces. Their hashed embeddings are averaged and go through one linear layer; both are
trained by stochastic gradient descent in numpy. For scoring, embedding times layer is one table where that is the smaller one, with few languages; with
many, texts are averaged first. Either way a row of the table has DIM numbers at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import give_back, small_batches, table
from scenetables.llm.sampling import bounded_sample, held_out

BITS, DIM = 16, 16
GRAMS = (2, 3, 4)
PER_LANGUAGE, MAX_CHARS = 800, 8_000  # bounds of the training sample
SNIPPETS, EPOCHS, RATE = 5, 3, 8.0
CHUNK = 1 << 16
PRECISION = 0.99
CALIBRATION = 20_000_000  # numbers that the calibration holds: texts times languages
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def subwords(raw: bytes) -> Iterator[np.ndarray]:
    """Hashed subwords of a whole text, a chunk at a time; n-grams across two words are left out."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    for at in range(0, len(b), CHUNK):
        c = _LETTERS[b[at : at + CHUNK + max(GRAMS) - 1]].astype(np.uint32)
        for n in GRAMS:
            size = min(CHUNK, len(c) - n + 1)
            if size <= 0:
                continue
            h = c[:size].copy()
            keep = np.ones(size, bool)
            for i in range(1, n):
                h |= c[i : i + size] << np.uint32(8 * i)
                if i < n - 1:
                    keep &= c[i : i + size] != 32
            keep &= (c[:size] != 32) | (c[n - 1 : n - 1 + size] != 32)
            h = (h[keep] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield h >> np.uint32(32 - BITS)


class Model(NamedTuple):
    languages: list[str]
    vectors: np.ndarray  # (2 ** BITS, at most DIM): embeddings, or embeddings times layer
    layer: np.ndarray | None  # (DIM, languages), where the vectors are embeddings
    bias: np.ndarray
    temperature: float
    threshold: float  # a lower score is a rejection

    def score(self, raw: bytes) -> np.ndarray:
        total, n = np.zeros(self.vectors.shape[1]), 0
        for h in subwords(raw):
            total += self.vectors[h].sum(0, dtype=np.float64)
            n += len(h)
        mean = total / max(n, 1)
        return softmax(((mean if self.layer is None else mean @ self.layer) + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(sample: list[tuple[str, str]], seed: int = 0) -> Model:
    """Fits on texts and on random snippets of them, so that short texts are known too. A tenth is kept for calibration."""
    rng = np.random.default_rng(seed)
    languages = sorted({y for _, y in sample})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), None, np.zeros(0), 1.0, 0.0)
    number = {y: k for k, y in enumerate(languages)}
    parts: list[tuple[np.ndarray, np.ndarray, int]] = []
    for text, y in sample:
        raw = text.encode()
        cuts = [raw] + [raw[i : i + int(rng.integers(20, 200))] for i in rng.integers(0, max(1, len(raw) - 20), SNIPPETS - 1)]
        for c in cuts:
            h = np.concatenate([*subwords(c), np.zeros(0, np.uint32)])
            if len(h):
                u, n = np.unique(h, return_counts=True)
                parts.append((u, (n / len(h)).astype(np.float32), number[y]))
    order = rng.permutation(len(parts))
    apart, fit = order[: len(order) // 10], order[len(order) // 10 :]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        for step, k in enumerate(rng.permutation(fit)):
            rate = RATE * (1 - (epoch + step / len(fit)) / EPOCHS)
            u, n, y = parts[k]
            mean = n @ emb[u]
            g = softmax(mean @ layer + bias)
            g[y] -= 1
            back = layer @ g
            layer -= 0.1 * rate * np.outer(mean, g)
            bias -= 0.01 * rate * g
            emb[u] -= rate * n[:, None] * back
    vectors, head = (emb @ layer, None) if len(languages) <= DIM else (emb, layer)
    test = [parts[k] for k in (apart if len(apart) else fit)][: max(100, CALIBRATION // len(languages))]
    z = np.array([(n @ vectors[u] if head is None else n @ vectors[u] @ head) + bias for u, n, _ in test])
    y = np.array([t[2] for t in test])
    losses = {t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    best = min(losses, key=losses.get)
    p = softmax(z / best)
    top, right = p.max(1), p.argmax(1) == y
    descending = np.argsort(-top)
    precision = np.cumsum(right[descending]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    threshold = float(top[descending][good[-1]]) if len(good) else 1.0
    return Model(languages, vectors, head, bias.astype(np.float64), float(best), threshold)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model:
    """Trains on a bounded sample (per_language documents of each language of at most max_chars characters) of the rows
    that are not held out. docs has doc_id, text and lang."""
    model = train(bounded_sample(docs.select("doc_id", "text", "lang"), "lang", per_language, max_chars))
    give_back()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected): one row per row of docs, repeated rows too; an empty table gives an empty result. `und`, score 0 and rejected for a null text, a text
    without a letter, or a model without languages; else the likeliest language (the first by code point in ties), rejected under the model's threshold. A very long text
    is read CHUNK bytes at a time. Only the id and the text are read, so other columns may have any names."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.when(F.regexp_like(F.col(text_col), F.lit(r"\p{L}")), F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text"):
                if not t.is_valid or not model.languages:
                    rows.append(("und", 0.0, True))
                    continue
                p = model.score(t.as_py().encode())
                k = int(p.argmax())
                rows.append((model.languages[k], float(p[k]), bool(p[k] < model.threshold)))
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *new], ["doc_id", "lang_pred", "score", "rejected"])

    return small_batches(d).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of documents."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
