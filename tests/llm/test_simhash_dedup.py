import random
from itertools import combinations

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scenetables.llm import simhash_dedup as sh
from scenetables.llm.components import connected_components


def brute_print(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def brute_components(prints):
    """prints: list of (id, fingerprint) -> smallest id reachable, by all pairs."""
    low = [k for k in range(len(prints))]

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
            low[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return [best.get(find(k)) for k in range(len(prints))]


def test_fingerprints():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("aBcÄé \t\n\x0b\x0c\u00a0\u2003") for _ in range(rng.randint(0, 60)))
        assert sh.fingerprint(t) & (1 << 64) - 1 == brute_print(t), t
    assert sh.fingerprint(None) == sh.fingerprint(" \n") == 0


def test_links_lose_none(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in sh.similar_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert got == {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_need_no_rounds(spark, monkeypatch):
    """Links that a task contracts to stars are written once, whatever the length of the chain; stars of several tasks that meet take rounds."""
    from scenetables.llm import components

    wrote = []
    monkeypatch.setattr(components, "materialize", lambda df, name, f=components.materialize: wrote.append(name) or f(df, name))
    chain = [(k, k + 1) for k in range(60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long").coalesce(1)).collect()}
    assert got == dict.fromkeys(range(61), 0) and wrote == ["contracted"]
    # each task has one link, so no task sees the chain
    monkeypatch.setattr(components, "_contracted", lambda edges, f=components._contracted: f(edges.repartition(60)))
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(61), 0) and len(wrote) > 2


def test_links_of_many_tasks_are_gathered(spark, monkeypatch):
    """Links that one task can hold need no star rounds, however many tasks they come from."""
    from scenetables.llm import components

    rounds = []
    monkeypatch.setattr(components, "_star_round", lambda edges, f=components._star_round: rounds.append(1) or f(edges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
        assert {r.node: r.root for r in connected_components(chain).collect()} == dict.fromkeys(range(61), 0) and not rounds
        monkeypatch.setattr(components, "CHUNK", 7)  # nine tasks
        assert {r.node: r.root for r in connected_components(chain).collect()} == dict.fromkeys(range(61), 0) and rounds
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_against_all_pairs(spark, documents, corpus_dir):
    rng = random.Random(6)
    words = ["w%d" % k for k in range(50)]
    texts = []
    for _ in range(25):
        t = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 2)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    rows = [*enumerate(texts), (None, texts[3]), (900, None), (901, "  "), (3, texts[3]), (None, "only one of its kind")]
    got = sh.op1_simhash_near_dedup(spark, corpus_dir(documents=documents(rows))).collect()
    low = brute_components([(i, brute_print(t)) for i, t in rows])
    want = sorted((repr(i), "%016x" % brute_print(t), repr(c)) for (i, t), c in zip(rows, low))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want


def test_one_document_stays(spark, documents):
    rows = [(5, "same text here now"), (2, "same text here now"), (2, "same text here now"), (None, "same text here now"), (9, "another thing altogether, it is"), (None, "no id at all for this one"), (None, None)]
    d = documents(rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "root")
    kept = sh.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, [rows[1], rows[4], rows[5], rows[6]]))
    assert sh.keep_one(d.limit(0)).count() == 0


def test_range_join_is_an_equi_join(spark):
    plan = sh.similar_fingerprints(spark.range(100).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
