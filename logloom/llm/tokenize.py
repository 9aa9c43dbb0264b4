"""Exact byte-level BPE over a corpus (problem 8).

The encoder finds every vocabulary token inside a piece with one Aho-Corasick pass over its bytes, written as Latin-1
text, then walks left to right from longest matches. A token may follow another only if the two are *compatible*, that is
if the merges of the joined bytes end in exactly these two tokens; compatibility is computed once a pair and memoised. A
dead end marks its position and steps back, so no position is entered twice and the walk is linear. A sequence whose
neighbours are all compatible is the one the merges produce.

Pieces repeat, so ids are kept by piece in bounded dictionaries at three levels: a line with the white space before it, a
word with the white space before it, and a piece of the tokenizer's own pattern. All three cut only where a visible
character meets white space, where the pattern always cuts.

Defined cases: empty text and null text both give an empty list; a repeated row gives its own row again; extra columns are
dropped; text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pattern that cuts text before merging, as published with the vocabulary; and its equal over ASCII alone.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""

#: Entries kept in each dictionary before it is emptied, which bounds a worker's memory.
MEMO_ENTRIES = 250_000

_STOPS = frozenset(",.:;")
_DIGITS = frozenset("0123456789")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The file of a public vocabulary: in `folder`, else where LOGLOOM_TOKENIZERS or the installed package says."""
    folder = folder or os.environ.get("LOGLOOM_TOKENIZERS")
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 bytes and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class Encoder:
    """Encodes text to int32 ids, held as bytes so that whole documents are joined without touching single ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import array

        import ahocorasick
        import regex

        self._array = array.array
        self.ranks = ranks
        self.size = {r: len(b) for b, r in ranks.items()}
        self.token = {r: b for b, r in ranks.items()}
        self._compatible: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}
        self._lines: dict[str, bytes] = {}
        self._automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self._automaton.add_word(b.decode("latin-1"), r)
        self._automaton.make_automaton()
        self._reachable: dict[int, bool] = {}
        self._pattern = regex.compile(PATTERN).findall
        self._ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self._line = re.compile(r"\s*\S+(?:[^\S\n]+\S+)*|\s+").findall
        self._word = re.compile(r"\s*\S+|\s+").findall
        #: Characters that Python's \s takes for white space and the tokenizer's pattern doesn't.
        self._odd = re.compile("[\x1c-\x1f]").search

    def merges(self, raw: bytes) -> list[int]:
        """The merges by definition: join the neighbours of lowest rank until none is in the vocabulary."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) >= 4 * MEMO_ENTRIES:
                self._compatible.clear()
            known = self._compatible[a, b] = self.merges(self.token[a] + self.token[b]) == [a, b]
        return known

    def _whole(self, r: int) -> bool:
        """Whether the merges of a token's own bytes reach the token."""
        known = self._reachable.get(r)
        if known is None:
            known = self._reachable[r] = self.merges(self.token[r]) == [r]
        return known

    def backtrack(self, raw: bytes) -> list[int]:
        """Ids of one piece: longest matches first, stepping back where no compatible token is left."""
        if (r := self.ranks.get(raw)) is not None and self._whole(r):
            return [r]
        n, at = len(raw), [[] for _ in raw]
        for end, r in self._automaton.iter(raw.decode("latin-1")):
            at[end + 1 - self.size[r]].append(r)  # matches arrive by their end, so the longest of a start comes last
        dead = bytearray(n + 1)
        ids: list[int] = []
        left: list[int] = []  # of each chosen token, how many shorter matches of its start are still to try
        pos, k = 0, len(at[0])
        while pos < n:
            last = ids[-1] if ids else None
            while k:
                k -= 1
                r = at[pos][k]
                end = pos + self.size[r]
                if not dead[end] and self._whole(r) and (last is None or self._fits(last, r)):
                    ids.append(r)
                    left.append(k)
                    pos = end
                    k = len(at[pos]) if pos < n else 0
                    break
            else:
                if last is None:
                    return self.merges(raw)
                dead[pos] = 1
                ids.pop()
                k = left.pop()
                pos -= self.size[last]
        return ids

    def _piece(self, s: str) -> bytes:
        out = self._pieces.get(s)
        if out is None:
            if len(self._pieces) >= MEMO_ENTRIES:
                self._pieces.clear()
            out = self._pieces[s] = self._array("i", self.backtrack(s.encode("utf-8", "surrogatepass"))).tobytes()
        return out

    def _cut(self, s: str) -> bytes:
        get, miss = self._pieces.get, self._piece
        return b"".join([get(x) or miss(x) for x in (self._ascii if s.isascii() else self._pattern)(s)])

    def _word_ids(self, s: str) -> bytes:
        if s[-4:-3] in _STOPS and s[-5:-4] in _DIGITS and len(s) > 5:
            # A digit before a stop always ends a piece, so both halves stand alone and come again: clock times, amounts.
            return (self._words.get(s[:-4]) or self._keep_word(s[:-4])) + (self._words.get(s[-4:]) or self._keep_word(s[-4:]))
        return self._words.get(s) or self._keep_word(s)

    def _keep_word(self, s: str) -> bytes:
        if len(self._words) >= MEMO_ENTRIES:
            self._words.clear()
        out = self._words[s] = self._cut(s)
        return out

    def _keep_spaced(self, s: str) -> bytes:
        if len(self._spaced) >= MEMO_ENTRIES:
            self._spaced.clear()
        out = self._spaced[s] = self._cut(" " + s)
        return out

    def _line_ids(self, s: str) -> bytes:
        a, arrow, b = s.partition(" --> ")
        if arrow and not a[-1:].isspace() and " " not in a and " " not in b and b.isascii():
            return self._word_ids(a) + self._word_ids(" -->") + self._word_ids(" " + b)
        words = s.split(" ")
        if len(words) == len(s.split()):  # single blanks only, apart from what precedes the line
            get, miss = self._spaced.get, self._keep_spaced
            out = self._word_ids(words[0]) + b"".join([get(w) or miss(w) for w in words[1:]])
        else:
            get, miss = self._words.get, self._keep_word
            out = b"".join([get(w) or miss(w) for w in self._word(s)])
        if len(s) < 200:
            if len(self._lines) >= MEMO_ENTRIES:
                self._lines.clear()
            self._lines[s] = out
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as packed int32; of null and empty text none."""
        if not text:
            return b""
        if self._odd(text):
            return b"".join(map(self._piece, self._pattern(text)))
        get, miss = self._lines.get, self._line_ids
        return b"".join([get(s) or miss(s) for s in self._line(text)])

    def encode(self, text: str | None) -> list[int]:
        return self._array("i", self.encode_bytes(text)).tolist()


def encoder_of(raw: bytes) -> Encoder:
    """The encoder of a vocabulary, one a worker process: building it takes half a second."""
    import sys
    import zlib

    kept = sys.modules.setdefault("_logloom_encoders", type(sys)("_logloom_encoders")).__dict__
    key = f"e{len(raw)}_{zlib.crc32(raw)}"
    if key not in kept:
        kept[key] = Encoder(load_ranks(raw))
    return kept[key]


def _vocabulary(df: DataFrame, path: str | None):
    """A broadcast of the vocabulary file, whose size is fixed (under 1 MB)."""
    with open(path or vocabulary_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows of id and `ids`, the token ids of the whole text; one output row for every input row."""
    raw = _vocabulary(docs, path)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc = encoder_of(raw.value)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 500):  # bounds the ids held at once
                part = [enc.encode_bytes(t) for t in texts.slice(lo, 500).to_pylist()]
                ends = np.cumsum([0, *map(len, part)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(part), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500), ids], names=[id_col, "ids"])

    out = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, out)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows of id and `n_tokens`; only the counts leave Python."""
    raw = _vocabulary(docs, path)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        enc = encoder_of(raw.value)
        for batch in batches:
            n = pa.array([len(enc.encode_bytes(t)) // 4 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[id_col, "n_tokens"])

    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, out)
