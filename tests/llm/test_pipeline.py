import random

import duckdb

import corpus_pipeline
from scenetables.llm.decontamination import OP8_SQL
from scenetables.llm.mixing import OP4_SQL
from scenetables.llm.secret_scan import mask
from test_shingle_dedup import jaccard


def test_stages_keep_clean_documents(spark, documents, corpus_dir):
    rng = random.Random(20)
    word = lambda: "".join(rng.choice(["lo", "rem", "ip", "sum", "dol"]) for _ in range(3))
    rows, toxic = [], []
    for k in range(300):
        w = [word() for _ in range(80)]
        toxic.append(int(k % 5 == 0))
        if toxic[-1]:
            w[rng.randrange(80)] = "vilest"
        rows.append((k, " ".join(w), "en", f"s{k % 4}"))
    item = " ".join(word() for _ in range(40))
    rows += [(500, rows[1][1], "en", "s1"), (501, "start " + item + " end", "en", "s2"), (502, rows[2][1] + " password: hunter22", "en", "s3"), (None, None, None, None), (503, "", "en", "s0")]
    folder = corpus_dir(
        documents=documents(rows), labels=spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string")
    )
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, folder)
        seen[name] = {r.doc_id: r for r in before.collect()}
        if name != "mixing":
            assert before.columns == names
    clean = {k for k in range(300) if not toxic[k]}
    assert clean <= set(seen["toxicity"]) and len(set(seen["toxicity"]) & {k for k in range(300) if toxic[k]}) <= 3
    assert clean - {2} <= set(seen["near_dedup"]) and 500 not in seen["near_dedup"] and len({2, 502} & set(seen["near_dedup"])) >= 1
    assert 501 not in seen["decontamination"] and set(seen["near_dedup"]) - {501} == set(seen["decontamination"])
    assert all("hunter22" not in (r.text or "") for r in seen["secret_scan"].values())
    assert len(seen["mixing"]) > 100 and all(r.taken > 0 for r in seen["mixing"].values())
    assert {k: r.taken for k, r in seen["mixing"].items()} == {r.doc_id: r.taken for r in corpus_pipeline.run(spark, folder).collect()}


def test_stages_against_brute_force(spark, documents, corpus_dir):
    """Each stage after the network on its own input: all pairs of texts, SQL over all windows and over all quotients, and one text at a time."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["ka", "mo", "ti", "se", "ru", "na"]) for _ in range(3))
    texts = [[word() for _ in range(rng.randint(5, 90))] for _ in range(120)]
    for k in range(40):  # near copies and benchmark passages
        w = list(texts[k])
        w[rng.randrange(len(w))] = word()
        texts.append(w)
    items = [[word() for _ in range(n)] for n in (12, 25, 40)]
    texts += [texts[100 + k] + items[k % 3] for k in range(9)] + [["token", "=", "abcdef123456"], [], items[0][:11]]
    rows = [(k, " ".join(w).replace("token = ", "token="), "en", f"s{k % 5}") for k, w in enumerate(texts)] + [(None, None, None, None)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    folder = corpus_dir(documents=documents(rows), benchmark=benchmark)
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    one = stages["near_dedup"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    # the text of the null id and the empty text are one class, of which the id stays
    assert {r.doc_id for r in one.collect()} == {rows[i][0] for i, r in enumerate(root) if r == i}

    def sql(query, docs):
        at = corpus_dir(documents=docs, benchmark=benchmark)
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
        cur = con.execute(query)
        return at, [dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()]

    at, found = sql(OP8_SQL, one)
    two = stages["decontamination"](spark, spark.read.parquet(f"{at}/documents.parquet"), at)
    bad = {r["doc_id"] for r in found}
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in one.collect()} - bad and len(bad) > 4
    three = stages["secret_scan"](spark, two, at)
    assert {r.doc_id: r.text for r in three.collect()} == {r.doc_id: mask(r.text) for r in two.collect()}
    at, want = sql(OP4_SQL, three)
    four = stages["mixing"](spark, spark.read.parquet(f"{at}/documents.parquet"), at)
    assert {r.doc_id: (r.size, r.target, r.taken) for r in four.collect()} == {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in want if r["taken"]}


def test_stages_of_empty_tables(spark, documents, corpus_dir):
    """No documents, and documents without labels or benchmark; repeated rows and a null row go through."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    none = corpus_dir(documents=documents([(1, "a")]).limit(0), labels=labels, benchmark=benchmark)
    assert corpus_pipeline.run(spark, none).collect() == []
    rows = [(1, "some words that stay"), (1, "some words that stay"), (None, None), (2, "other words here " * 3000)]
    some = corpus_dir(documents=documents(rows), labels=labels, benchmark=benchmark)
    docs = spark.read.parquet(f"{some}/documents.parquet")
    kept = {name: stage(spark, docs, some).count() for name, stage in corpus_pipeline.STAGES[:-1]}
    assert kept == {"toxicity": 4, "near_dedup": 3, "decontamination": 4, "secret_scan": 4}
    assert {r.doc_id for r in corpus_pipeline.run(spark, some).collect()} == {1, 2}
