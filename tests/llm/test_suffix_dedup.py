import hashlib
import random
from collections import Counter

import pytest

from scenetables.llm import suffix_dedup as sd


def covered(texts, length):
    """Which bytes of each text lie in a window of `length` that occurs again, by counting every window."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def runs(gone):
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def brute(texts, length, report):
    """(n_bytes, n_removed, n_spans, kept digest, n_repeats, repeated_bytes) of each text."""
    out = []
    for t, gone, seen in zip(texts, covered(texts, length), covered(texts, report)):
        r = (t or "").encode()
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest(), runs(seen), sum(seen)))
    return out


def corpus(rng, n, alphabet, length):
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randint(length // 2, 3 * length))) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 6)):
            t += rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 2 * length)))
        if t and rng.random() < 0.5:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(alphabet) + t[k + 1 :]
        texts.append(t)
    return [*texts, "", None, *texts[:2], "ab" * length, "x" * (3 * length)]


def spans_of(texts, length, report, gram):
    """Bytes in repeats of `length` and of `report`, by the operator's parts, without Spark and with all anchors in sorted classes."""
    classes = {}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        for g, _, start, lead, _, size in zip(*(c.tolist() for c in sd.text_anchors(raw, report, length, gram))):
            classes.setdefault(g, []).append((k, raw[start : start + size], start, lead))
    gone, seen = ([[False] * len((t or "").encode()) for t in texts] for _ in range(2))
    for rows in classes.values():
        if len(rows) > 1:
            for k, s, e, name in sd.class_spans([r[1:] for r in rows], report):
                assert name == sd.name_of((texts[rows[k][0]] or "").encode()[s:e])
                for mark, n in ((gone, length), (seen, report)):
                    if e - s >= n:
                        mark[rows[k][0]][s:e] = [True] * (e - s)
    return [(sum(g), sum(h)) for g, h in zip(gone, seen)]


@pytest.mark.parametrize("seed", range(12))
def test_interval_tree_against_counting(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(sd, "CHUNK", 37)
    length, report, gram = ((24, 24, 6), (12, 12, 12), (24, 15, 5))[seed % 3]
    texts = corpus(rng, 25, "abé" if seed < 4 else "abcdefgh ", length)
    assert spans_of(texts, length, report, gram) == [(b[1], b[5]) for b in brute(texts, length, report)]


@pytest.mark.parametrize("limit,report", [(4096, 25), (3, 25), (3, 40)])
def test_rows_against_counting(spark, documents, monkeypatch, limit, report):
    monkeypatch.setattr(sd, "CLASS", limit)
    texts = corpus(random.Random(11), 30, "abcd", 40)
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (5, texts[6])]
    d = documents(rows).withColumnRenamed("lang", "spans").withColumnRenamed("source", "gram")
    got = sd.remove_repeats(d, length=40, report=report, gram=8).collect()
    want = brute([t for _, t in rows], 40, report)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest(), r.n_repeats, r.repeated_bytes) for r in got) == sorted(
        (i is None, i or 0, *w) for (i, _), w in zip(rows, want)
    )


def test_one_passage_before_many_endings(spark, documents, monkeypatch):
    """A passage shorter than `length` with another ending in each text: a class that no sort may hold."""
    monkeypatch.setattr(sd, "CLASS", 4)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(33))
    texts = [passage + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(30)] + [passage * 2]
    got = {r.doc_id: r for r in sd.remove_repeats(documents(list(enumerate(texts))), length=40, report=25, gram=8).collect()}
    assert [(got[k].n_removed, got[k].n_repeats, got[k].repeated_bytes) for k in range(len(texts))] == [(b[1], b[4], b[5]) for b in brute(texts, 40, 25)]


def test_empty_table(spark, documents):
    assert sd.remove_repeats(documents([(1, "a")]).limit(0)).count() == 0


def test_query(spark, documents, corpus_dir):
    long = "".join(random.Random(5).choice("abcdefghij ") for _ in range(1500))
    texts = [long, "p" + long[300:900], long[:399], None, "short", long[1000:] + long[:450], "q" + long[700:990] + "r"]
    got = {r.doc_id: tuple(r)[1:] for r in sd.op2_suffix_dedup(spark, corpus_dir(documents=documents(list(enumerate(texts))))).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 400, 256)


def test_passages_of_over_fifty_words_are_reported(spark, documents, corpus_dir):
    """Passages of 52 words and some 300 bytes, below the length that removes, in two to nine documents each; clean documents beside them."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(52) for _ in range(12)]
    assert all(256 <= len(p) < 400 for p in passages)
    rows, planted = [], set()
    for k in range(200):
        body = text(rng.randint(60, 400))
        if k % 4 == 0:
            at = body.index(" ", rng.randrange(len(body) // 2))
            body = body[:at] + " " + passages[k // 4 % 12] + body[at:]
            planted.add(k)
        rows.append((k, body))
    got = {r.doc_id: r for r in sd.op2_suffix_dedup(spark, corpus_dir(documents=documents(rows))).collect()}
    assert {k for k, r in got.items() if r.n_repeats} == planted and not any(r.n_removed for r in got.values())
    assert all(len(passages[k // 4 % 12]) <= got[k].repeated_bytes <= len(passages[k // 4 % 12]) + 6 for k in planted)
