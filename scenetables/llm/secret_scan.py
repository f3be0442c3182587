"""Secret scans: fixed patterns, and a token-efficiency test.

A byte-pair vocabulary spends few tokens on strings it has seen in text and many on random ones. Candidate runs with
a low number of characters per token are reported as `token`, after known digests (hex of a digest's length),
UUIDs and identifiers (words joined by separators) are put aside. Pieces between separators are tested too.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import small_batches, table

BASE = ("assign", "access", "hex")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern that splits a text before the merges of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MIN_CHARS = 20
MAX_CHARS_PER_TOKEN = 2.2
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
MASK = "[SECRET]"

# ASCII letters in either case; IGNORECASE would also take the long s and the Kelvin sign
_KEYS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"(?:{_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is maximal, so this drops just the short runs
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_IDENTIFIER = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))*[-_/=+]*")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_ENCODINGS: dict = {}


def shipped(docs: DataFrame, path: str) -> DataFrame:
    """docs as it is; the rank file, where the driver has it, goes with the job to executors that lack it."""
    if os.path.exists(path):
        docs.sparkSession.sparkContext.addFile(path)
    return docs


def encoding(path: str):
    """The tokenizer of a rank file, read once in each Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def _odd(s: str, path: str) -> bool:
    """Whether a piece has few characters per token. One token is a known word; digits alone are a number unless very long."""
    n = len(encoding(path).encode_ordinary(s))
    return n > 1 and len(s) / n <= MAX_CHARS_PER_TOKEN and (not s.isdigit() or len(s) >= MIN_CHARS)


def _known(s: str) -> bool:
    return len(s) in DIGEST_CHARS and bool(_DIGEST.fullmatch(s))


def inefficient(s: str, path: str) -> bool:
    """Whether s looks random: no known digest, and few characters per token, either in pieces between separators
    that stand together, so that words beside a key don't hide it, or in the whole, unless that is an identifier
    (letters and numbers joined by separators, the letters efficient)."""
    if _known(s) or _UUID.fullmatch(s):
        return False
    together = odd = 0
    for p in _PIECE.findall(s):
        if not _known(p) and _odd(p, path):
            together, odd = together + len(p), odd + len(p)
            if together >= MIN_CHARS:
                return True
        elif len(p) > 3:  # a short piece says nothing
            together = 0
    if not any(c.isalpha() for c in s) or _IDENTIFIER.fullmatch(s) and odd < MIN_CHARS // 2:
        return False
    return len(s) / len(encoding(path).encode_ordinary(s)) <= MAX_CHARS_PER_TOKEN


def find_secrets(t: str | None, path: str = VOCABULARY) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed; token last. Null counts as empty."""
    if not t:
        return []
    out = []
    if ":" in t or "=" in t:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(t) if m.end() - m.start(1) >= 6]
    if "AKIA" in t:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(t)]
    out += [("token", m.start(), m.end()) for m in _RUN.finditer(t) if inefficient(m.group(), path)]
    order = (*BASE, "token")
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def mask(t: str | None, path: str = VOCABULARY) -> str | None:
    """The text with every secret (overlapping spans as one) replaced by MASK."""
    spans = find_secrets(t, path)
    if not spans:
        return t
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [t[at:s], MASK]
        at = max(at, e)
    return "".join([*out, t[at:]])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end), empty for a null or empty text; one row per row of docs, repeated
    rows too; an empty table gives an empty result. A very long text is scanned whole, run by run. Only the id and the text are read, so other columns may have any names.
    vocabulary is a path that the driver can open, or every executor."""
    d = shipped(docs, vocabulary).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t.as_py(), vocabulary)] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return small_batches(d).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def mask_secrets(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the secrets of the text column masked; all rows, repeated ones too, and other columns stay, whatever their names. A null
    text stays null, an empty one empty; an empty table gives an empty result; a very long text is masked whole."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: mask(t, vocabulary))

    return small_batches(shipped(docs, vocabulary)).withColumn(text_col, masked(F.col(text_col)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of documents."""
    s = secret_spans(table(spark, sf_dir, "documents"))
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return s.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"),
    )
