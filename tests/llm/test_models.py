import os
import pickle
import random
import zlib

import numpy as np
import pyarrow as pa

from scenetables.llm import language_id as li
from scenetables.llm import toxicity as tx


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = tx.Net(1)
    v = tx.word_features(pa.array(["alpha", "be", "gammas", "delta"]))
    x = net.inputs(v)
    tok, valid = rng.integers(0, 4, (tx.WINDOW, 5)), np.ones((tx.WINDOW, 5), np.float32)
    valid[20:, 2] = 0
    d = rng.normal(size=5).astype(np.float32)
    keep = {}
    net.forward(net.project(x), tok, valid, keep)
    g, gx = net.backward(keep, tok, valid, d, x.shape[1])
    loss = lambda: float((net.forward(net.project(x), tok, valid).astype(np.float64) * d).sum())
    for k in ("uf", "ub", "att", "out", "bias"):
        flat, at = net.p[k].reshape(-1), rng.integers(net.p[k].size)
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-2 - g[k].reshape(-1)[at]) < 2e-2 * max(1, abs(g[k].reshape(-1)[at])), k
    assert abs(gx["f"].sum(1)).max() > 0


def texts(rng, n):
    plain = ["lo", "rem", "ip", "sum", "dol", "or", "sit", "am"]
    word = lambda: "".join(rng.choice(plain) for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(rng.randint(3, 120))]
        y = int(rng.random() < 0.3)
        if y:
            w[rng.randrange(len(w))] = rng.choice(["nasty", "Vile!", "grotzen" + word()])
        out.append((" ".join(w), y))
    return out


def test_toxicity_on_held_out_rows(spark, documents, corpus_dir):
    rng = random.Random(3)
    rows = texts(rng, 900)
    d = documents([(k, t) for k, (t, _) in enumerate(rows)] + [(None, None), (5000, ""), (5000, "")])
    labels = spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(rows)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    out = tx.op5_toxicity(spark, corpus_dir(documents=d, labels=labels)).collect()
    assert len(out) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    test = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in test)
    right = sum(r.predicted == rows[r.doc_id][1] for r in test)
    assert right / len(test) > 0.95
    assert all(r.predicted == 0 for r in out if r.doc_id is None or r.doc_id == 5000)


def test_training_leaves_the_driver_small(spark, documents, monkeypatch):
    """A task trains, on the sample that the driver would collect; what is sent of a network is what training changed."""
    from scenetables.llm import sampling

    rows = texts(random.Random(6), 150)
    docs = documents([(k, t) for k, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    want = tx.train(sampling.bounded_sample(docs.select("doc_id", "text"), "toxic", 60, 8000, labels))

    def elsewhere(sample, driver=os.getpid(), train=tx.train):
        assert os.getpid() != driver
        return train(sample)

    monkeypatch.setattr(tx, "train", elsewhere)
    got = tx.fit(docs, labels, 60, 8000)
    some = pa.array([t for t, _ in rows])
    assert np.allclose(got.score(some), want.score(some), atol=1e-4) and np.ptp(want.score(some)) > 0.5
    sent = pickle.dumps(want)
    same = pickle.loads(sent)
    assert len(sent) < 2_000_000 and (same.words == want.words).all() and (same.grams == want.grams).all() and (same.score(some) == want.score(some)).all()


def test_long_text_equals_its_highest_window():
    net = tx.train(texts(random.Random(4), 300))
    words = ("lorem ipsum " * 40).split() + ["nasty"] + ("dolor sit " * 5_000).split()
    short = pa.array([" ".join(words[64:96])])
    assert net.score(pa.array([" ".join(words), "", None]))[0] >= net.score(short)[0] - 1e-6


def test_no_labels_and_empty_tables(spark, documents):
    net = tx.train([])
    assert (net.score(pa.array(["a b", ""])) < 0.7).all() and tx.toxicity(documents([]), net).count() == 0
    assert li.identify(documents([(1, "abc")]), li.train([])).first().lang_pred == "und"


def test_language_on_held_out_rows(spark, documents, corpus_dir):
    rng = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["é", "eau", "oi", "è"]}
    rows = []
    for k in range(600):
        lang = rng.choice(list(parts))
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 80))), lang))
    rows += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "kalo mitu", None), (None, "", None)]
    d = documents(rows)
    out = li.op7_language_id(spark, corpus_dir(documents=d)).collect()
    assert len(out) == 604 and {r.lang_pred for r in out} == {"aa", "bb", "cc", "und"}
    assert all((r.lang_pred == "und") == (r.doc_id in (None, 1000, 1001)) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in test) / len(test) > 0.98
    clash = d.withColumnRenamed("source", "lang_pred").withColumnRenamed("n_chars", "score")
    assert li.identify(clash, li.fit(clash)).count() == 604 and li.identify(clash.limit(0), li.fit(clash)).count() == 0


def test_subwords_do_not_depend_on_chunks(monkeypatch):
    raw = ("Abc dé, f1 " * 50).encode()
    whole = np.sort(np.concatenate(list(li.subwords(raw))))
    monkeypatch.setattr(li, "CHUNK", 17)
    assert (np.sort(np.concatenate(list(li.subwords(raw)))) == whole).all()


def plain_logit(net, text):
    """The highest window logit of a text, a word and a step at a time in float64."""
    w = "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text).split()
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    logits, at = [], 0
    while True:
        part = w[at : at + tx.WINDOW]
        x = [net.inputs(tx.word_features(pa.array([v])))[:, 0].astype(np.float64) for v in part]
        states = {}
        for d in "fb":
            h, u, hs = np.zeros(tx.HIDDEN), net.p[f"u{d}"], []
            for v in x if d == "f" else x[::-1]:
                gx, gh = net.p[f"w{d}"] @ v + net.p[f"c{d}"][:, 0], u @ h
                z, r = sigmoid(gx[: tx.HIDDEN] + gh[: tx.HIDDEN]), sigmoid(gx[tx.HIDDEN : 2 * tx.HIDDEN] + gh[tx.HIDDEN : 2 * tx.HIDDEN])
                h = (1 - z) * np.tanh(gx[2 * tx.HIDDEN :] + r * gh[2 * tx.HIDDEN :]) + z * h
                hs.append(h)
            states[d] = hs if d == "f" else hs[::-1]
        both = np.array([np.concatenate(s) for s in zip(states["f"], states["b"])])
        a = np.exp(both @ net.p["att"])
        logits.append(float(a / a.sum() @ (both @ net.p["out"]) + net.p["bias"][0]))
        if at + tx.WINDOW >= len(w):
            return max(logits)
        at += tx.STRIDE


def test_scores_against_plain_windows():
    rng = random.Random(11)
    net = tx.train(texts(rng, 120))
    some = [t for t, _ in texts(rng, 12)] + ["one", "É Ü ß mixed-Case, words!", " ".join(f"w{k % 7}" for k in range(33)), " ".join(f"w{k}" for k in range(49))]
    got = net.logits(pa.array(some))
    assert all(abs(g - plain_logit(net, t)) < 2e-3 * max(1, abs(g)) for g, t in zip(got, some))


def test_recurrent_states_add_to_single_words():
    """Ablation: whether `mark` harms depends on the word before it, and all texts hold the same words. With their order lost, the scores say little."""
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        y = rng.random() < 0.5
        fill = [rng.choice(["lo", "rem", "ip"]) for _ in range(12)]
        i, j = sorted(rng.sample(range(12), 2))
        pairs = [("bad", "mark"), ("good", "thing")] if y else [("good", "mark"), ("bad", "thing")]
        rng.shuffle(pairs)
        rows.append((" ".join([*fill[:i], *pairs[0], *fill[i:j], *pairs[1], *fill[j:]]), int(y)))
    net = tx.train(rows[:1200])
    test = rows[1200:]
    right = lambda of: np.mean([(s >= 0.5) == y for s, (_, y) in zip(net.score(pa.array([of(t) for t, _ in test])), test)])
    assert right(str) > 0.95 and right(lambda t: " ".join(rng.sample(t.split(), len(t.split())))) < 0.75


def test_language_scores_against_plain_counting():
    rng = np.random.default_rng(3)
    model = li.Model(["a", "b", "c"], rng.normal(0, 1, (1 << li.BITS, 3)).astype(np.float32), None, np.array([0.1, -0.2, 0.0]), 1.7, 0.5)

    def plain(text):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in b" " + text.encode() + b" ")
        total, n = np.zeros(3), 0
        for k in li.GRAMS:
            for i in range(len(b) - k + 1):
                g = b[i : i + k]
                if 32 in g[1:-1] or (g[0] == 32 and g[-1] == 32):
                    continue
                h = int.from_bytes(g, "little") ^ (k * 0x9E3779B1 & 0xFFFFFFFF)
                total += model.vectors[(h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - li.BITS]
                n += 1
        e = np.exp((total / max(n, 1) + model.bias) / model.temperature)
        return e / e.sum()

    for t in ("Ab, cd!", "", "é", "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. " * 3):
        assert np.allclose(model.score(t.encode()), plain(t), atol=1e-6)


def test_chunks_of_a_long_text_count_alike(monkeypatch):
    text = ("Some words, and été; " * 400).encode()
    whole = np.sort(np.concatenate(list(li.subwords(text))))
    monkeypatch.setattr(li, "CHUNK", 97)
    assert np.array_equal(whole, np.sort(np.concatenate(list(li.subwords(text)))))


def test_many_languages_share_a_small_table(spark, documents, monkeypatch):
    """Beyond DIM languages the table keeps DIM numbers a subword, and scores are those of embedding times layer."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)]
    sample = [(" ".join(rng.choice(words[8 * k : 8 * k + 8], 30)), f"l{k:02d}") for k in range(50) for _ in range(12)]
    monkeypatch.setattr(li, "CALIBRATION", 50 * 200)
    model = li.train(sample)
    assert model.vectors.shape == (1 << li.BITS, li.DIM) and model.layer.shape == (li.DIM, 50)
    whole = model._replace(vectors=model.vectors @ model.layer, layer=None)
    assert all(np.allclose(model.score(t.encode()), whole.score(t.encode()), atol=1e-4) for t, _ in sample[::40])
    got = li.identify(documents([(k, t) for k, (t, _) in enumerate(sample)]), model).collect()
    assert np.mean([r.lang_pred == sample[r.doc_id][1] for r in got]) > 0.9


def test_samples_of_more_labels_than_rows_fit(spark, documents, monkeypatch):
    """12,000 labels: all that have a short enough text are there, within the characters that the driver may collect."""
    from scenetables.llm import sampling

    monkeypatch.setattr(sampling, "SAMPLE_CHARS", 12_000 * 40)
    monkeypatch.setattr(sampling, "BROADCAST_LABELS", 100)
    rows = [(k, "x" * (20 if k % 24_000 < 12_000 else 90), f"l{k % 12_000}") for k in range(48_000)]
    got = sampling.bounded_sample(documents(rows).select("doc_id", "text", "lang"), "lang", 5, 100)
    taught = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and len(r[1]) == 20}
    assert {y for _, y in got} == taught and len(taught) > 10_000
    assert sum(len(t) for t, _ in got) <= sampling.SAMPLE_CHARS


def test_samples_cover_all_labels_within_the_bound(spark, documents, monkeypatch):
    from scenetables.llm import sampling

    rows = [(k, f"text number {k}", f"lang{k % 1300}") for k in range(5200)]
    got = sampling.bounded_sample(documents(rows).select("doc_id", "text", "lang"), "lang", 3, 100)
    labels = {y for _, y in got}
    assert len(labels) == len({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}) and len(labels) > 1100
    monkeypatch.setattr(sampling, "SAMPLE_CHARS", 100 * 1300 * 2)
    few = sampling.bounded_sample(documents(rows).select("doc_id", "text", "lang"), "lang", 300, 100)
    assert max(sum(y == x for _, y in few) for x in ("lang0", "lang1", "lang7")) <= 2
    # many rows of one id: the same sample, however the rows lie
    many = [(0, f"t{k}", "en") for k in range(900)] + [(k, f"u{k}", "en") for k in range(40)]
    one, two = (sampling.bounded_sample(documents(m).repartition(n).select("doc_id", "text", "lang"), "lang", 20, 100) for m, n in ((many, 3), (many[::-1], 7)))
    assert one == two and 0 < len(one) <= 20
    assert sampling.bounded_sample(documents(rows[:1]).limit(0).select("doc_id", "text", "lang"), "lang", 3, 100) == []


def test_toxicity_keeps_columns_and_refuses_a_clash(spark, documents):
    import pytest

    net = tx.Net(0)
    d = documents([(1, "a b"), (1, "a b"), (2, None)])
    got = tx.toxicity(d, net).collect()
    assert len(got) == 3 and got[0].score == got[1].score and set(d.columns) < set(got[0].asDict())
    assert tx.toxicity(d.limit(0), net).count() == 0
    with pytest.raises(ValueError):
        tx.toxicity(d, net, out="lang")
