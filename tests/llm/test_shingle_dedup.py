import random

import numpy as np
import pytest

import corpus_pipeline
from scenetables.llm import shingle_dedup
from scenetables.llm.shingle_dedup import shingle_set, similar, sketch, sketch_distance


def jaccard(a, b):
    x, y = (set(shingle_set(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, w, low, high):
    """A copy of the words at a 5-word similarity in [low, high), some words replaced."""
    while True:
        v = list(w)
        for i in rng.sample(range(len(v)), rng.randint(1, max(1, len(v) // 30))):
            v[i] = f"new{rng.randrange(10**6)}"
        if low <= jaccard(" ".join(w), " ".join(v)) < high:
            return " ".join(v)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**63, n // 3 + 1).astype(np.uint64)]))
        assert sketch_distance(sketch(a), sketch(b)) <= len(np.setxor1d(a, b))
        assert similar(a, a)


@pytest.mark.parametrize("shared_line", ["", "this line stands in every one of the many texts of this table here"])
def test_stage_keeps_what_all_pairs_keep(spark, documents, shared_line):
    """Near copies planted at similarities of 0.80 to 0.95, and others just below 0.8, against all pairs."""
    rng = random.Random(8)
    texts, planted = [], []
    for n in (100, 300, 600):
        for low in (0.72, 0.8, 0.85, 0.9, 0.95):
            for _ in range(3):
                w = [f"w{rng.randrange(20000)}" for _ in range(n)]
                texts.append(" ".join(w) + " " + shared_line)
                texts.append(edited(rng, w, low, min(1.0, low + 0.05)) + " " + shared_line)
                if low >= 0.8 and not shared_line:
                    planted.append(len(texts) - 1)
    star = [f"w{rng.randrange(20000)}" for _ in range(200)]
    texts += [edited(rng, star, 0.8, 0.95) for _ in range(12)] + [" ".join(star), "", " \n", "one two", "ONE  two", "three four"]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if jaccard(texts[a], texts[b]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents(list(enumerate(texts))), "").collect()}
    assert kept == {r for i, r in enumerate(root) if r == i}
    assert not kept & set(planted)


def test_one_template_in_most_texts(spark, documents):
    """A template's shingles in nearly all texts: no window over them, and what all pairs keep is kept."""
    from scenetables.llm import shingle_dedup as sh

    rng = random.Random(9)
    template = " ".join(f"t{k}" for k in range(60))
    texts = [template + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 90))) for _ in range(150)]
    texts += [edited(rng, texts[k].split(), 0.85, 1.0) for k in range(0, 60, 3)] + [template] * 9
    d = documents(list(enumerate(texts)))
    roots = {r.doc_id: r.root for r in sh.near_duplicates(d).collect()}
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(texts[a], texts[b]) >= 0.8]
    assert pairs and all(roots[a] == roots[b] for a, b in pairs)
    group = list(range(len(texts)))
    for a, b in pairs:
        group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert len(set(roots.values())) == len(set(group))
    assert "Window" not in sh.near_duplicates.__code__.co_names and not hasattr(sh, "Window")


def test_empty_table_and_repeated_rows(spark, documents):
    from scenetables.llm import shingle_dedup as sh

    assert sh.near_duplicates(documents([(1, "a")]).limit(0)).collect() == []
    d = documents([(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "")]).selectExpr("*", "1 AS node", "2 AS root")
    got = sh.near_duplicates(d).collect()
    assert len(got) == 4 and len({r.root for r in got}) == 2


def test_candidates_come_from_simhash(spark, documents):
    """Each pair of fingerprints within three bits, and of nodes of one fingerprint, is a candidate; the rest is settled exactly."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(50000)}" for _ in range(400)) for _ in range(6)]
    near = [t.replace(t.split()[200], "other", 1) for t in texts]
    d = documents(list(enumerate(texts + near))).selectExpr("doc_id", "xxhash64(text) AS text_key", "text")
    marks = shingle_dedup.prints(d, 5).cache()
    fp = {r.node: r.fp for r in marks.collect()}
    met = {(r.a, r.b) for r in shingle_dedup.simhash_pairs(marks).collect()}
    differ = lambda a, b: ((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count()
    assert met == {(a, b) for a in fp for b in fp if a < b and differ(a, b) <= 3} and len(met) >= 3
    # without the exact way, what SimHash finds is linked
    linked = shingle_dedup.verified(d, marks, shingle_dedup.simhash_pairs(marks), 5)
    assert {(r.a, r.b) for r in linked.collect()} == met


def test_what_has_no_candidates_costs_no_more_tables(spark, documents, monkeypatch):
    """Once no two components share a shingle, neither pivots nor pairs are made: driver memory follows the number of jobs."""
    wrote = []
    monkeypatch.setattr(shingle_dedup, "materialize", lambda df, name, f=shingle_dedup.materialize: wrote.append(name) or f(df, name))
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(50000)}" for _ in range(30)) for _ in range(5)]
    got = {r.doc_id: r.root for r in shingle_dedup.near_duplicates(documents(list(enumerate(texts + texts[:2])))).collect()}
    assert got[0] == got[5] and got[1] == got[6] and len(set(got.values())) == 5
    assert not {"pivots", "stars", "ids", "sets", "last", "pairs"} & set(wrote)
