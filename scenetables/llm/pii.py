"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, schemes, plus signs, digits and
identifier cues. A local parser at each anchor expands to the span's borders and validates it. The spans of the
base kinds equal those of their patterns, read leftmost and without overlap; url and account are added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import small_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"://[^\s/?#@:]+(?::[^\s/?#@]*)?@[^\s/?#@]+")
_IBAN = re.compile(r"[ :=#-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?: ?(?:number|no\.?|nr\.?))?[ :=#-]{0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_CUES = {"iban": "iban", "account": "number", "acct": "number", "konto": "number", "passport": "number"}
_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    """Built once in each Python worker."""
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for word, kind in {"@": "at", "+": "plus", "://": "scheme"}.items() | {(d, "digit") for d in "0123456789"}:
            a.add_word(word, (kind, len(word)))
        for word, kind in _CUES.items():
            for form in (word, word.capitalize(), word.upper()):
                a.add_word(form, (kind, len(form)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(t: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) in code points by kind, in order of start. Null counts as empty."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not t:
        return found
    email_at = chain_at = card_at = phone_at = url_at = account_at = 0
    for last, (kind, n) in _automaton().iter(t):
        at = last - n + 1
        if kind == "digit":
            if at >= chain_at:
                m = _CHAIN.match(t, at)
                chain_at = m.end()
                parts = m.group().split(".")
                start = at
                for i in range(0, len(parts) - 3, 4):
                    end = start + sum(map(len, parts[i : i + 4])) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                        found["ip"].append((start, end))
                    start = end + 1
            if at >= card_at:
                m = _CARD.match(t, at)
                card_at = m.end() if m else at + 1
                if m and m.end() - at >= 16:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, m.end()))
        elif kind == "at":
            start = at
            while start > email_at and t[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(t, at + 1)):
                found["email"].append((start, m.end()))
                email_at = m.end()
        elif kind == "plus":
            if at >= phone_at and (m := _PHONE.match(t, at)):
                phone_at = m.end()
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found["phone"].append((at, m.end()))
        elif kind == "scheme":
            if at >= url_at and (m := _USERINFO.match(t, at)):
                start = at
                while start > url_at and t[start - 1].isascii() and (t[start - 1].isalnum() or t[start - 1] in "+.-"):
                    start -= 1
                if start < at:
                    found["url"].append((start, m.end()))
                    url_at = m.end()
        elif at >= account_at:
            m = (_IBAN if kind == "iban" else _NUMBER).match(t, last + 1)
            if m and (kind == "number" or _iban(m.group(1))):
                found["account"].append((m.start(1), m.end(1)))
                account_at = m.end()
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end), empty for a null or empty text. One row per row of docs;
    only the id and the text are read, so other columns may have any names. Repeated rows each get a row, and an empty table gives an empty result.
    A text is worked on whole, in a time in proportion to its length."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text"):
                f = find_spans(t.as_py())
                rows.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in f[k]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return small_batches(d).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of documents."""
    s = pii_spans(table(spark, sf_dir, "documents"))
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return s.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"),
    )
