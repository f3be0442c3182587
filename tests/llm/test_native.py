import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scenetables.llm import decontamination as de
from scenetables.llm import url_filter as uf


def compared(folder, sql, got):
    con = duckdb.connect()
    import os

    for t in os.listdir(folder):
        con.execute(f"create view {t[:-8]} as select * from '{folder}/{t}/*.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = sorted(repr(tuple(r)) for r in cur.fetchall())
    return sorted(repr(tuple(r[n] for n in names)) for r in got), want


def test_items_against_all_windows(spark, documents, corpus_dir):
    rng = random.Random(12)
    words = ["v%d" % k for k in range(30)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [make(n) for n in (1, 2, 4, 5, 6, 12, 12, 30, 41, 60, 12)]
    items[-1] = items[-2][:12]
    items.append(["rep"] * 20)
    texts = []
    for _ in range(60):
        t = make(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            i = list(rng.choice(items))
            for _ in range(rng.randint(0, 2)):
                i[rng.randrange(len(i))] = rng.choice(words)
            if rng.random() < 0.3:
                i = i[rng.randint(0, 3) :]
            t += [w.upper() for w in i] + make(rng.randint(0, 20))
        texts.append(" ".join(t))
    texts += [" ".join(items[8][:38]), " ".join(["rep"] * 18), None, ""]
    d = documents([*enumerate(texts), (0, texts[0]), (None, texts[1])])
    bench = spark.createDataFrame([*((k, "  ".join(i)) for k, i in enumerate(items)), (90, None), (91, " "), (0, " ".join(items[0]))], "item_id long, text string")
    folder = corpus_dir(documents=d, benchmark=bench)
    got, want = compared(folder, de.OP8_SQL, de.op8_decontamination(spark, folder).collect())
    assert got == want and len(got) > 30


def test_blocks_select_and_lose_nothing(spark):
    """Items against windows of their length with some shingles replaced: all pairs of 0.8 or more meet, and few unrelated ones do."""
    rng = random.Random(4)
    rows = []
    for k in range(60):
        m = rng.choice([9, 12, 20, 36, 60, 200])
        item = [rng.getrandbits(63) for _ in range(m)]
        for lost in range(m // 9 + 1):
            rows.append((k, m, item, [*item[lost:], *(rng.getrandbits(63) for _ in range(lost))]))
    fp = spark.createDataFrame(rows, "item int, m int, a array<long>, b array<long>").select("item", "m", de.fingerprint(F.col("a")).alias("a"), de.fingerprint(F.col("b")).alias("b")).collect()
    near = lambda x, y: [sum(v) for v in [[(p ^ q).bit_count() for p, q in zip(x, y)]]][0]
    meets = lambda x, y: any((p ^ q).bit_count() <= de.FLIPS for p, q in zip(x, y))
    assert all(meets(r.a, r.b) for r in fp)
    apart = [(x, y) for i, x in enumerate(fp) for y in fp[i + 1 :] if x.item != y.item]
    assert sum(meets(x.a, y.b) for x, y in apart) < 0.05 * len(apart)
    assert all(meets(x.a, y.b) for x, y in apart if near(x.a, y.b) <= de.RADIUS)
    probes = de.probes(spark.createDataFrame([(1, fp[0].a)], "item_id int, fp array<int>"), "item_id").collect()
    assert len(probes) == de.BLOCKS * len(de.PROBES) == len({r.key for r in probes})
    # bits by hand
    h = spark.createDataFrame([([5, 7, 7],)], "h array<long>").select(de.fingerprint(F.col("h")).alias("fp"), *(F.array(*(F.xxhash64(F.lit(q), F.get("h", i)) for i in range(3))).alias(f"x{q}") for q in range(de.HASHES))).first()
    bits = [sum(x >> j & 1 for x in h[f"x{q}"]) > 1.5 for q in range(de.HASHES) for j in range(64)]
    assert h.fp == [sum(bits[16 * k + i] << i for i in range(16)) for k in range(de.BLOCKS)]


def test_decontaminate_edges(spark, documents, monkeypatch):
    item = " ".join("z%d" % k for k in range(25))
    d = documents([(1, "before " + item + " after"), (1, "before " + item + " after"), (2, "clean words only"), (None, item), (3, None)]).withColumnRenamed("lang", "n").withColumnRenamed("source", "item_id")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (de.BROADCAST_SHINGLES, 0):  # broadcast, then shuffled
        monkeypatch.setattr(de, "BROADCAST_SHINGLES", limit)
        kept = de.decontaminate(d, bench)
        assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert de.decontaminate(d, bench.limit(0)).count() == 5 and de.decontaminate(d.limit(0), bench).count() == 0


URLS = [None, "", "no scheme/en/", "http://com/en/", "https://A.Example.COM/en/7x?q", "http://example.com/en/6", "http://xexample.com/en/7", "http://b.net/de/8", "http://b.example.net/de/8/1#f", "http://example.net/de/9", "http://a.org?/es/", "http://a.org/es/", "http://a.org/ES/", "x://y://com/en/", "http://é.com/en/\nz", "http://com./en/", "http:///en/", "http://user@b.org:80/es/"]


def test_urls_against_sql(spark, corpus_dir):
    pages = spark.createDataFrame([*((k, u, "<p>") for k, u in enumerate(URLS)), (None, URLS[4], None), (3, URLS[3], None), (3, URLS[3], None)], "page_id long, url string, html string")
    folder = corpus_dir(pages=pages)
    got, want = compared(folder, uf.OP9_SQL, uf.op9_url_filter(spark, folder).distinct().collect())
    assert got == sorted(set(want))
    assert uf.op9_url_filter(spark, folder).count() == len(URLS) + 3


def test_rules_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c/d", "k")], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("b", "/c/", "block"), ("a.b", "", "allow"), ("b", "/c/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert uf.judge(pages, rules).first().__getitem__("__rule") in ("b/c/",)
    assert uf.judge(pages, rules.limit(0)).first().__getitem__("__verdict") == "allow"
    assert uf.judge(pages.limit(0), rules).count() == 0


def test_judge_keeps_all_columns(spark):
    names = ["h", "c", "rule", "verdict", "host", "path", "suffix", "prefix"]
    pages = spark.createDataFrame([(1, "http://x.com/en/1", *names)] * 2, ["page_id", "url", *names])
    got = uf.judge(pages, uf.rule_table(spark, uf.RULES)).collect()
    assert len(got) == 2 and all(r[n] == n for r in got for n in names) and all(r["__verdict"] == "block" for r in got)


@pytest.mark.parametrize("query", [de.op8_decontamination, uf.op9_url_filter])
def test_no_python_in_the_plan(spark, documents, corpus_dir, query):
    folder = corpus_dir(
        documents=documents([(1, "a b c d e f g")]), benchmark=spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"), pages=spark.createDataFrame([(1, "http://a/b", "")], "page_id long, url string, html string")
    )
    plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
