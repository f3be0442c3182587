"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy by tasks.

A word's input is a hashed word embedding and the sum of hashed character n-gram embeddings (prefixes of 3 to 8 bytes
and inner 4-grams). Windows of WINDOW words, each overlapping half of the next, go through a forward and a backward GRU;
attention pools the states into one logit. A document's logit is its highest window's, calibrated on documents that
training left apart. Labels belong to whole documents, so training alternates between choosing the windows that carry
a label and fitting on them; the first choice comes from how the features' document counts differ by label.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import give_back, small_batches, table
from scenetables.llm.sampling import held_out, in_order, sample_rows

WINDOW, STRIDE = 32, 16
HIDDEN, DIM = 8, 8
WORD_BITS, GRAM_BITS = 18, 17
PREFIXES = (3, 4, 5, 6, 7, 8)
GRAM_SCALE = 0.25
PER_LABEL, MAX_CHARS = 1_200, 8_000  # bounds of the training sample
ROUNDS, EPOCHS, BATCH, RATE = 3, 4, 128, 0.01
LEAST_STEPS = 150  # of a round; a small sample is gone over more often
THRESHOLD = 0.7
LANES = 2_048  # windows that run side by side
SLICE = 256  # texts whose words are held at once
BLOCK_WORDS = 1 << 18  # words whose inputs are held at once

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[:128] = 32
_FOLDED[48:58] = np.arange(48, 58)
_FOLDED[97:123] = _FOLDED[65:91] = np.arange(97, 123)
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


class Words(NamedTuple):
    """Distinct words as feature buckets; the last word is padding without features."""

    word: np.ndarray  # (V,)
    prefix: np.ndarray  # (V, len(PREFIXES)); bucket 0 is unused and stays zero
    gram: np.ndarray  # inner n-grams of all words
    starts: np.ndarray  # first gram of each word
    counts: np.ndarray


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def word_features(words: pa.Array) -> Words:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    terms = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * _POWERS[place & 4095], out=terms[1:])
    word = _bucket(terms[offsets[1:]] - terms[offsets[:-1]], WORD_BITS)
    prefix = np.zeros((len(sizes) + 1, len(PREFIXES)), np.int64)
    for j, n in enumerate(PREFIXES):
        has = sizes >= n
        at = offsets[:-1][has]
        prefix[:-1, j][has] = np.maximum(_bucket((terms[at + n] - terms[at]) * np.uint64(2 * n + 1), GRAM_BITS), 1)
    four = np.zeros(len(raw), np.uint64)
    for i in range(4):
        four[: max(len(raw) - i, 0)] |= raw[i:].astype(np.uint64) << np.uint64(8 * i)
    inner = place + 4 <= np.repeat(sizes, sizes)
    gram = np.maximum(_bucket(four[inner] * np.uint64(0xD6E8FEB86659FD93), GRAM_BITS), 1)
    counts = np.append(np.maximum(sizes - 3, 0), 0)
    return Words(np.append(word, -1), prefix, gram, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as numbers of those, and where each text's words begin."""
    texts = texts.fill_null("").cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    folded = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_FOLDED[raw]))
    lists = pc.ascii_split_whitespace(folded)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), bounds


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every window, and its text; a text without words has none."""
    sizes = np.diff(bounds)
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][text] + nth * STRIDE
    return start, np.minimum(WINDOW, bounds[1:][text] - start), text


class Net:
    """The network's parameters; float32 throughout. What is sent of them are the rows that training changed."""

    def __init__(self, seed: int = 0):
        self.seed = seed
        rng = np.random.default_rng(seed)
        small = lambda *shape, s: rng.standard_normal(shape, np.float32) * np.float32(s)
        self.words, self.grams = small(1 << WORD_BITS, DIM, s=0.02), small(1 << GRAM_BITS, DIM, s=0.02)
        self.grams[0] = 0
        self.p = {}
        for d in "fb":
            self.p |= {f"w{d}": small(3 * HIDDEN, 2 * DIM, s=0.3), f"c{d}": np.zeros((3 * HIDDEN, 1), np.float32), f"u{d}": small(3 * HIDDEN, HIDDEN, s=0.3)}
        self.p |= {"att": small(2 * HIDDEN, s=0.3), "out": small(2 * HIDDEN, s=0.5), "bias": np.float32([-1.0])}
        self.scale, self.shift = 1.0, 0.0  # calibration

    def __getstate__(self) -> dict:
        new, state = Net(self.seed), {k: v for k, v in self.__dict__.items() if k not in ("words", "grams")}
        for k in ("words", "grams"):
            at = np.flatnonzero((getattr(self, k) != getattr(new, k)).any(1))
            state["new_" + k] = at, getattr(self, k)[at]
        return state

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["seed"])
        for k in ("words", "grams"):
            at, rows = state.pop("new_" + k)
            getattr(self, k)[at] = rows
        self.__dict__.update(state)

    def inputs(self, v: Words) -> np.ndarray:
        """(2 DIM, V): word part, then character part."""
        chars = self.grams[v.prefix].sum(1)
        if len(v.gram):
            some = v.counts > 0
            chars[some] += np.add.reduceat(self.grams[v.gram], v.starts[some], axis=0)
        word = np.append(self.words[v.word[:-1]], np.zeros((1, DIM), np.float32), axis=0)
        return np.ascontiguousarray(np.concatenate([word, GRAM_SCALE * chars], axis=1).T)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: self.p[f"w{d}"] @ x + self.p[f"c{d}"] for d in "fb"}

    def forward(self, px: dict[str, np.ndarray], tok: np.ndarray, valid: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. tok and valid: (WINDOW, n); keep gathers what backward() needs."""
        steps, n, H = *tok.shape, HIDDEN
        att, out = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
        for k, d in enumerate("fb"):
            h, u = np.zeros((H, n), np.float32), self.p[f"u{d}"]
            va, vo = self.p["att"][k * H : k * H + H], self.p["out"][k * H : k * H + H]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                gx, gh = px[d].take(tok[t], axis=1), u @ h
                zr = gx[: 2 * H] + gh[: 2 * H]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                new = np.tanh(gx[2 * H :] + zr[H:] * gh[2 * H :])
                step = new + zr[:H] * (h - new)
                if keep is not None:
                    keep[d, t] = (h, zr, new, gh[2 * H :])
                h = h + valid[t] * (step - h)
                att[t] += va @ h
                out[t] += vo @ h
                if keep is not None:
                    keep["h" + d, t] = h
        att = np.where(valid > 0, att, -1e9)
        a = np.exp(att - att.max(0))
        a /= a.sum(0)
        if keep is not None:
            keep["pool"] = (a, out)
        return (a * out).sum(0) + self.p["bias"]

    def backward(self, keep: dict, tok: np.ndarray, valid: np.ndarray, d_logit: np.ndarray, n_words: int) -> tuple[dict, dict]:
        """Gradients of the parameters and of the projected inputs."""
        steps, H = len(tok), HIDDEN
        a, out = keep["pool"]
        d_out, d_att = a * d_logit, a * (out - (a * out).sum(0)) * d_logit
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"] += d_logit.sum()
        gx = {}
        for k, d in enumerate("fb"):
            u, part = self.p[f"u{d}"], slice(k * H, k * H + H)
            dh, each = 0, np.zeros((steps, 3 * H, tok.shape[1]), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, (hp, zr, new, ghn) = keep["h" + d, t], keep[d, t]
                g["att"][part] += h @ d_att[t]
                g["out"][part] += h @ d_out[t]
                dh = dh + self.p["att"][part, None] * d_att[t] + self.p["out"][part, None] * d_out[t]
                z, r, dm = zr[:H], zr[H:], dh * valid[t]
                dn = dm * (1 - z) * (1 - new * new)
                each[t, :H] = dm * (hp - new) * z * (1 - z)
                each[t, H : 2 * H] = dn * ghn * r * (1 - r)
                each[t, 2 * H :] = dn
                back = np.concatenate([each[t, : 2 * H], dn * r])
                g[f"u{d}"] += back @ hp.T
                dh = dh * (1 - valid[t]) + dm * z + u.T @ back
            at = tok.ravel()
            flat = each.transpose(1, 0, 2).reshape(3 * H, -1)
            gx[d] = np.stack([np.bincount(at, row, n_words) for row in flat]).astype(np.float32)
        return g, gx

    def window_logits(self, v: Words, tok: np.ndarray, valid: np.ndarray, pad: int) -> np.ndarray:
        """Logits of windows whose inputs are made for their words alone."""
        used, local = np.unique(np.append(tok.ravel(), pad), return_inverse=True)
        return self.forward(self.project(self.inputs(_subset(v, used))), local[:-1].reshape(tok.shape), valid)

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The highest window logit of each text; that of one empty window for a text without words."""
        if len(texts) > SLICE:  # the words of so many texts at a time
            return np.concatenate([self.logits(texts.slice(i, SLICE)) for i in range(0, len(texts), SLICE)])
        best = np.full(len(texts), np.nan, np.float32)
        dictionary, ids, bounds = tokens(texts)
        at = 0
        while at < len(texts):  # texts in blocks, each of some words
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_WORDS, "right")) - 1)
            start, size, text = windows(bounds[at : end + 1])
            if len(start):
                used, local = np.unique(ids[bounds[at] : bounds[end]], return_inverse=True)
                px = self.project(self.inputs(word_features(dictionary.take(pa.array(used)))))
                w = np.concatenate([self.forward(px, *laid_out(local, start[i : i + LANES] - bounds[at], size[i : i + LANES], len(used))) for i in range(0, len(start), LANES)])
                np.fmax.at(best, at + text, w)
            at = end
        return np.where(np.isnan(best), self.p["bias"], best)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts).astype(np.float64) + self.shift, -50, 50)))


def laid_out(ids: np.ndarray, start: np.ndarray, size: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (WINDOW, n), padded, and which of them are valid."""
    t = np.arange(WINDOW)[:, None]
    valid = t < size
    return np.where(valid, ids[np.minimum(start + t, len(ids) - 1)], pad), valid.astype(np.float32)


def _contrasts(v: Words, ids: np.ndarray, bounds: np.ndarray, label: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much more often than by chance the buckets of words and of n-grams occur in texts of label 1: clipped z-scores of
    document counts. Texts are counted some at a time, so memory follows the number of buckets."""
    sizes = (1 << WORD_BITS, 1 << GRAM_BITS)
    n, pos = [np.zeros(k) for k in sizes], [np.zeros(k) for k in sizes]
    for t in np.flatnonzero(use):
        w = np.unique(ids[bounds[t] : bounds[t + 1]])
        grams = np.concatenate([v.prefix[w].ravel(), v.gram[_ranges(v.starts[w], v.counts[w])]])
        for k, found in enumerate((np.unique(v.word[w]), np.unique(grams))):
            n[k][found] += 1
            pos[k][found] += label[t]
    rate = label[use].mean()
    wz, gz = (np.clip((p - c * rate) / np.sqrt(np.maximum(c, 1) * rate * (1 - rate) + 0.5), -8, 8).astype(np.float32) for c, p in zip(n, pos))
    gz[0] = 0
    return wz, gz


def train(sample: list[tuple[str, int]], seed: int = 0) -> Net:
    net, rng = Net(seed), np.random.default_rng(seed)
    label = np.array([int(y) for _, y in sample])
    if not len(label) or label.min() == label.max():
        net.p["bias"][:] = 0 if not len(label) else 8 * label[0] - 4
        net.p["out"][:] = 0
        return net
    texts = pa.array([t for t, _ in sample], pa.string())
    dictionary, ids, bounds = tokens(texts)
    v = word_features(dictionary)
    n_words = len(dictionary)
    start, size, text = windows(bounds)
    apart = rng.random(len(label)) < 0.2
    wz, gz = _contrasts(v, ids, bounds, label, ~apart)
    net.words[:, 0] += wz / 4
    net.grams[:, 0] += gz / 4
    evidence = np.append(wz[v.word[:-1]] + gz[v.prefix[:-1]].max(1), -20)
    tok, valid = laid_out(ids, start, size, n_words)
    tok = tok.astype(np.int32)
    power = evidence[tok].max(0)
    harmless = ids[np.repeat(label == 0, np.diff(bounds))]
    slots = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    sums = {"words": np.full(1 << WORD_BITS, 1e-4, np.float32), "grams": np.full(1 << GRAM_BITS, 1e-4, np.float32)}
    t_adam = 0
    for round_ in range(ROUNDS):
        if round_:
            power = np.concatenate([net.window_logits(v, tok[:, i : i + LANES], valid[:, i : i + LANES], n_words) for i in range(0, len(start), LANES)])
        top = np.full(len(label), -np.inf)
        np.maximum.at(top, text, power)
        yes = (label[text] == 1) & ~apart[text] & (power >= np.minimum(top[text], 2.0 if round_ else 12.0))
        no = (label[text] == 0) & ~apart[text] & ((power == top[text]) | (rng.random(len(text)) < 0.1))
        chosen = np.flatnonzero(yes | no)
        y = yes[chosen].astype(np.float32)
        # one word over and over, which no window of the sample may show: negative whenever a harmless text has the word
        stutter = rng.choice(harmless, max(1, len(chosen) // 10))
        y = np.append(y, np.zeros(len(stutter), np.float32))
        tok_now = np.concatenate([tok[:, chosen], np.tile(stutter, (WINDOW, 1))], axis=1)
        valid_now = np.concatenate([valid[:, chosen], np.ones((WINDOW, len(stutter)), np.float32)], axis=1)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        weight = np.minimum(weight, 5)
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // max(1, len(y) // BATCH)))):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                used, local = np.unique(tok_now[:, part], return_inverse=True)
                if used[-1] != n_words:
                    used = np.append(used, n_words)
                local = local.reshape(WINDOW, -1)
                sub = _subset(v, used)
                x = net.inputs(sub)
                keep: dict = {}
                logit = net.forward(net.project(x), local, valid_now[:, part], keep)
                d = (1 / (1 + np.exp(-logit)) - y[part]) * weight[part] / len(part)
                g, gx = net.backward(keep, local, valid_now[:, part], d.astype(np.float32), len(used))
                dx = np.zeros_like(x)
                for k in "fb":
                    g[f"w{k}"] += gx[k] @ x.T
                    g[f"c{k}"] += gx[k].sum(1, keepdims=True)
                    dx += net.p[f"w{k}"].T @ gx[k]
                t_adam += 1
                for k, (m, s) in slots.items():
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] ** 2 - s)
                    net.p[k] -= RATE * (m / (1 - 0.9**t_adam)) / (np.sqrt(s / (1 - 0.999**t_adam)) + 1e-8)
                dw, dc = dx[:DIM].T[:-1], GRAM_SCALE * dx[DIM:].T
                _adagrad(net.words, sums["words"], sub.word[:-1], dw)
                _adagrad(net.grams, sums["grams"], np.concatenate([sub.prefix.ravel(), sub.gram]), np.concatenate([np.repeat(dc, len(PREFIXES), 0), np.repeat(dc, sub.counts, 0)]))
                net.grams[0] = 0
    del tok, valid, tok_now, valid_now, evidence, power
    _calibrate(net, texts, label, apart)
    return net


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def _subset(v: Words, used: np.ndarray) -> Words:
    counts = v.counts[used]
    return Words(v.word[used], v.prefix[used], v.gram[_ranges(v.starts[used], counts)], np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)


def _adagrad(values: np.ndarray, sums: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
    u, inverse = np.unique(at, return_inverse=True)
    g = np.stack([np.bincount(inverse, grad[:, j], len(u)) for j in range(grad.shape[1])], 1).astype(np.float32)
    sums[u] += (g**2).mean(1)
    values[u] -= 0.1 * g / np.sqrt(sums[u])[:, None]


def _calibrate(net: Net, texts: pa.Array, label: np.ndarray, apart: np.ndarray) -> None:
    """Fits score = sigmoid(scale * logit + shift) on the documents left apart (all, if one label is missing there)."""
    use = apart if 0 < label[apart].sum() < apart.sum() else np.ones_like(apart)
    z, y = net.logits(texts.filter(pa.array(use))).astype(np.float64), label[use]
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [((p - soft) * z).sum(), (p - soft).sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    net.scale, net.shift = max(float(a), 0.05), float(b)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Net:
    """Trains on at most per_label documents of each label, of at most max_chars characters, from the rows not held out. One task trains, since its sample is bounded and the
    driver's memory is scarcer; the driver gets the network alone."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample_rows(docs.select("doc_id", "text"), "toxic", per_label, max_chars, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        net = pickle.dumps(train(in_order(rows)))
        del rows
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([net], pa.binary())], ["net"])

    found = [] if sample is None else small_batches(sample.repartition(1)).mapInArrow(run, "net binary").collect()
    return pickle.loads(found[0].net) if found else train([])


def toxicity(docs: DataFrame, net: Net, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`, the score from 0 to 1 of the whole text; a column of that name is an error.

    A null text scores as an empty one does, and so does a text without words. Equal texts score equally, repeated rows each get a
    row, an empty table gives an empty result, and other columns stay, whatever their names. A very long text is scored in all its windows,
    BLOCK_WORDS words at a time."""
    if out in docs.columns:
        raise ValueError(f"docs already has a column {out}")
    state = {"net": net}

    @F.pandas_udf("double")
    def score(texts):
        return _series(state["net"].score(pa.array(texts, pa.string(), from_pandas=True)))

    return small_batches(docs).withColumn(out, score(F.col(text_col)))


def _series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
