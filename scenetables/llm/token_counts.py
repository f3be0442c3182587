"""Token counts of byte-pair vocabularies by heap-and-linked-list merging.

The symbols of a piece form a linked list; a heap holds the adjacent pairs that the vocabulary merges, by rank and then
position. The lowest pair is popped again and again, and joined if both its symbols still stand there. A piece then has as many
tokens as it had symbols, less the merges; no token gets an identifier.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import small_batches, table
from scenetables.llm.secret_scan import shipped

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
LIMIT = 2048
#: Pieces a worker remembers, and the longest one that it does.
CACHED, CACHED_CHARS = 1 << 18, 48
#: Where a pair's position ends and its rank begins, in an entry of the heap.
_POSITION = 40
_SYMBOLS = 20  # bits of a symbol's number
#: The text steps of the vocabulary file that _latin() restates for characters below U+0300.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_LATIN = 0x300
_COUNTERS: dict[str, TokenCounter] = {}


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(_LATIN) if unicodedata.category(chr(i))[0] == kind)


def _latin() -> re.Pattern[str]:
    """Pieces of a lower-cased text without combining marks: composing leaves such texts as they are."""
    letters, numbers, spaces = _class("L"), _class("N"), r"\t-\r\x20\x85\xa0"
    return re.compile(_WORDS.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]"))


class TokenCounter:
    """Counts the tokens of texts under a byte-level vocabulary file with merges. Texts of characters below U+0300 are split here; others
    by the library's own text steps, as Unicode tables differ between versions. Special strings inside a text count as one token each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or "ByteLevel" not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError("a byte-level vocabulary with merges alone is needed")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings must stand for themselves")
        steps = Tokenizer.from_file(path)
        self._normal, self._split = steps.normalizer, steps.pre_tokenizer
        self._symbols, self._end = model["vocab"], model.get("end_of_word_suffix") or ""
        self._ranks: dict[int, int] = {}
        self._made: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._ranks.setdefault(self._symbols[a] << _SYMBOLS | self._symbols[b], len(self._made))
            self._made.append(self._symbols[a + b])
        special = [re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))]
        self._special = re.compile("|".join(special)) if special else None
        known = all(spec[k] == v for k, v in _STEPS.items())
        self._latin: Callable | None = _latin().findall if known else None
        self._bytes = _byte_symbols()
        self._cache: dict[str, int] = {}

    def merged(self, symbols: list[int]) -> int:
        """Tokens left of a piece's symbols: their number less the merges. The list is changed."""
        ranks, made, n = self._ranks, self._made, len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        at = (1 << _POSITION) - 1
        heap = [r << _POSITION | i for i in range(n - 1) if (r := ranks.get(symbols[i] << _SYMBOLS | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            x = heapq.heappop(heap)
            i, r = x & at, x >> _POSITION
            j = right[i]
            if j >= n or symbols[i] < 0 or ranks.get(symbols[i] << _SYMBOLS | symbols[j]) != r:
                continue  # one of the two has gone into another merge
            merges += 1
            symbols[i], symbols[j], right[i] = made[r], -1, (k := right[j])
            if k < n:
                left[k] = i
                if (s := ranks.get(symbols[i] << _SYMBOLS | symbols[k])) is not None:
                    heapq.heappush(heap, s << _POSITION | i)
            h = left[i]
            if h >= 0 and (s := ranks.get(symbols[h] << _SYMBOLS | symbols[i])) is not None:
                heapq.heappush(heap, s << _POSITION | h)
        return n - merges

    def _piece(self, piece: str) -> int:
        """Tokens of a piece, given as characters that stand for its bytes."""
        found = self._cache.get(piece)
        if found is None:
            found = self.merged([self._symbols[c] for c in piece[:-1]] + [self._symbols[piece[-1] + self._end]])
            if len(piece) <= CACHED_CHARS:
                if len(self._cache) >= CACHED:
                    self._cache.clear()
                self._cache[piece] = found
        return found

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if self._latin and (text.isascii() or max(text) < chr(_LATIN)):
            pieces = Counter(self._latin(text.lower()))
            return sum(n * self._piece(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self._bytes)) for p, n in pieces.items())
        text = self._normal.normalize_str(text) if self._normal else text
        return sum(n * self._piece(p) for p, n in Counter(p for p, _ in self._split.pre_tokenize_str(text)).items())

    def count(self, text: str | None) -> int:
        """Tokens of a text; none for null and for an empty text."""
        if not text:
            return 0
        parts = self._special.split(text) if self._special else [text]
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


def _byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one of those from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def counter(path: str) -> TokenCounter:
    """The counter of a vocabulary file, made once in each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row per row of docs, repeated rows and null ids too. A null or empty text has no bytes and no tokens; an
    empty table gives an empty result. Only the id and the text are read, so other columns may have any names. Texts are counted whole; beside the text
    itself, a worker holds some 200 bytes for each byte of a piece (a run of letters or of signs), so only a very long unbroken run takes memory. vocabulary is
    a path that the driver can open, or every executor."""
    d = shipped(docs, vocabulary).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for b in batches:
            n = pa.array((tokens.count(t.as_py()) for t in b.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    return small_batches(d).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of documents."""
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
