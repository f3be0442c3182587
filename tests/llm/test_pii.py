import random
import re

from scenetables.llm.pii import BASE, find_spans, luhn, op3_pii, pii_spans


def brute(t):
    t = t or ""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    card = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        s = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            card.append(m.span())
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def test_base_spans_equal_the_patterns_on_random_text():
    rng = random.Random(1)
    pieces = ["@", ".", "+", " ", "-", "a", "b9", "x.y", "1", "12", "255", "256", "4111", "1111", "4111111111111111", "(", ")", "é", "://", "iban", "account", "\n", "%", "_", "+1 (555) 010-9999", "me@x.org", "10.0.0.1"]
    for _ in range(6000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        found = find_spans(t)
        assert {k: found[k] for k in BASE} == brute(t), t


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_added_kinds():
    t = "see ftp://joe:pw@host.org/x, IBAN DE89 3704 0044 0532 0130 00; account no. 1234-5678 90"
    f = find_spans(t)
    assert [t[s:e] for s, e in f["url"]] == ["ftp://joe:pw@host.org"]
    assert [t[s:e] for s, e in f["account"]] == ["DE89 3704 0044 0532 0130 00", "1234-5678 90"]
    assert find_spans("IBAN DE88 3704 0044 0532 0130 00")["account"] == []


def test_long_texts_stay_linear():
    for t in ("1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a" * 200_000 + "@", "1 " * 100_000, "@" * 200_000):
        find_spans(t)


def test_rows_nulls_and_clashing_columns(spark, documents, corpus_dir):
    d = documents([(1, None), (1, "a@b.co"), (1, "a@b.co"), (None, "")])
    out = op3_pii(spark, corpus_dir(documents=d)).collect()
    assert sorted(r.n_email for r in out) == [0, 0, 1, 1] and {r.spans for r in out} == {"", "email:0:6"}
    clash = d.withColumnRenamed("lang", "spans").withColumnRenamed("source", "kind")
    assert pii_spans(clash).count() == 4
    assert pii_spans(d.limit(0)).count() == 0
