"""Token counts against the tokenizer library."""

import random

import pytest
from tokenizers import Tokenizer

from scenetables.llm import token_counts as tc

POOL = ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "'s", "'LL", " ", "\n", "\x00", "\x1c", "\x85", "\xa0", "　", "9", "²", "é", "é", "́", "Σ", "ß", "İ", "日本", "가", "가", "ǅ", "ﬁ", "🙂", "a", "B", "the", "ing", "!", "--")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tc.VOCABULARY)


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_rows(spark, documents, library):
    """One row per row; nulls, empty and very long texts, special strings, repeated rows."""
    r = random.Random(3)
    texts = [None, "", " \n\t", "<|endoftext|>", "Hello <|endoftext|>World's 42", "aéΣ" * 30_000, "x" * 200_000, "".join(r.choice(POOL) for _ in range(50_000))]
    texts += ["".join(r.choice(POOL) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4])] * 3 + [(None, "a b")]
    df = documents(rows).selectExpr("*", "'x' AS n_tokens", "1 AS n_bytes")
    got = sorted(tc.token_counts(df).collect(), key=repr)
    assert got == sorted(((i, len((t or "").encode()), expected(library, t)) for i, t in rows), key=repr)
    assert tc.token_counts(df.limit(0)).collect() == []


def test_code_points(library):
    """Every character below U+0300, where texts are split here, and a share of the others."""
    c = tc.counter(tc.VOCABULARY)
    points = [*range(0x800), *range(0x800, 0xD800, 37), *range(0xE000, 0x110000, 997)]
    assert not [hex(i) for i in points if c.count(f"x{chr(i)}Y") != expected(library, f"x{chr(i)}Y")]


def test_merges_by_rank():
    """Merges against the plain way: search the lowest pair anew, leftmost first, each time."""
    c = tc.TokenCounter(tc.VOCABULARY)
    r = random.Random(5)
    for _ in range(300):
        word = "".join(r.choice("aeinrst") for _ in range(r.randint(1, 40)))
        s = [c._symbols[x] for x in word]
        left = list(s)
        while True:
            ranked = [(k, i) for i in range(len(left) - 1) if (k := c._ranks.get(left[i] << tc._SYMBOLS | left[i + 1])) is not None]
            if not ranked:
                break
            k, i = min(ranked)
            left[i : i + 2] = [c._made[k]]
        assert c.merged(s) == len(left)


def test_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tc, "CACHED", 10)
    c = tc.TokenCounter(tc.VOCABULARY)
    text = " ".join(f"w{i}x" for i in range(500))
    assert c.count(text) == expected(library, text) and len(c._cache) <= 10


def test_query(spark, corpus_dir, documents, library):
    rows = [(1, "many words " * 2000), (2, None), (3, "Few.")]
    got = {r["doc_id"]: r for r in tc.op13_token_counts(spark, corpus_dir(documents=documents(rows))).collect()}
    assert got[1]["over_limit"] and not got[2]["over_limit"] and got[2]["n_tokens"] == 0 and got[3]["n_tokens"] == expected(library, "Few.")


def test_other_kinds_are_refused(tmp_path):
    import json

    with open(tc.VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["unk_token"] = "?"
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tc.TokenCounter(str(tmp_path / "v.json"))
