"""Groups of maximal repeats against all pairs of places."""

import random

import pytest

from scenetables.llm import repeat_groups as rg
from scenetables.llm import suffix_dedup as sd


def maximal(texts, report):
    """{repeat: places} by all pairs: two places that go apart on both sides meet in a maximal repeat, and each has such two."""
    raws = sorted({(k, (t or "").encode()) for k, t in texts}, key=repr)
    places = [(k, r, i) for k, r in raws for i in range(len(r) - report + 1)]
    found = set()
    for a, (k, r, i) in enumerate(places):
        for m, q, j in places[a + 1 :]:
            if r[i : i + report] == q[j : j + report] and (i == 0 or j == 0 or r[i - 1] != q[j - 1]):
                found.add(r[i : i + sd.common(r[i:], q[j:])])
    return {w: sorted(((k, i) for k, r in raws for i in range(len(r) - len(w) + 1) if r.startswith(w, i)), key=repr) for w in found}


def groups(df, texts):
    """The same from rows: names, lengths and counts agree with the bytes at the places."""
    out, raws = {}, {}
    for k, t in texts:
        raws.setdefault(k, []).append((t or "").encode())
    for r in df.collect():
        w = next(x[r.start : r.start + r.n_bytes] for x in raws[r.doc_id] if sd.name_of(x[r.start : r.start + r.n_bytes]) == r.name)
        out.setdefault((w, r.occurrences), []).append((r.doc_id, r.start))
    assert all(len(v) == n for (_, n), v in out.items())
    return {w: sorted(v, key=repr) for (w, _), v in out.items()}


def corpus(rng, alphabet, n=14):
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randint(15, 60))) for _ in range(5)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pieces)
            t += p[: rng.randint(len(p) // 2, len(p))] if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20)))
        texts.append(t)
    return [*texts, "", None, texts[0], texts[1] + texts[2], "ab" * 30, "x" * 50]


@pytest.mark.parametrize("seed,limit", [(1, 4096), (2, 3), (4, 2)])
def test_all_maximal_repeats(spark, documents, monkeypatch, seed, limit):
    """Random overlaps, runs of one letter, repeated rows and null ids, with small classes too."""
    monkeypatch.setattr(sd, "CLASS", limit)
    rng = random.Random(seed)
    texts = list(enumerate(corpus(rng, "abé" if seed == 1 else "abcdefgh", 8 if limit < 9 else 14)))
    texts += [(3, texts[3][1]), (4, texts[5][1]), (None, texts[6][1])]
    d = documents(texts).selectExpr("*", "1 AS w", "2 AS data", "3 AS ord", "4 AS start", "5 AS name")
    got = groups(rg.repeat_groups(d, report=18, gram=6), texts)
    want = maximal(texts, 18)
    assert want and got.keys() == want.keys() and got == want


def test_one_interval_many_occurrences(spark, documents):
    """A string in six rows, of which five go on alike: one group of six, one of five."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    x, y = word(300), word(300)
    texts = [(k, f"{word(30)}{k}" + x + (y if k < 5 else "z" + word(299)) + f"{k}{word(20)}") for k in range(6)]
    got = groups(rg.repeat_groups(documents(texts)), texts)
    assert {len(w): len(v) for w, v in got.items()} == {300: 6, 600: 5} and got == maximal(texts, sd.REPORT)


def test_repeats_longer_than_a_context(spark, documents):
    """Two documents share 2,000 bytes, a third the first 1,000 of them."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    x = word(2000)
    texts = [(0, "0" + word(50) + x + "0"), (1, "1" + x + "1" + word(70)), (2, "2" + word(9) + x[:1000] + "2")]
    assert {len(w): v for w, v in groups(rg.repeat_groups(documents(texts)), texts).items()} == {2000: [(0, 51), (1, 1)], 1000: [(0, 51), (1, 1), (2, 10)]}


def test_copies_of_one_text(spark, documents, monkeypatch):
    """More copies than a class may have members: one group, and the passage that other texts share."""
    monkeypatch.setattr(sd, "CLASS", 8)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    x = word(400)
    texts = [(k, x) for k in range(60)] + [(100 + k, f"{word(40)}{k % 10}" + x[50:350] + f"{k % 7}" + word(40)) for k in range(25)]
    got = groups(rg.repeat_groups(documents(texts), report=60, gram=12), texts)
    assert {(len(w), len(v)) for w, v in got.items()} >= {(400, 60), (300, 85)} and got == maximal(texts, 60)


def test_empty_table(spark, documents):
    assert rg.repeat_groups(documents([(1, "a")]).limit(0)).count() == 0
