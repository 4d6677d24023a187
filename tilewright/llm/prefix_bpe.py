"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

Prefix dynamic programming: for each prefix of a word's bytes the table holds the last token of that prefix's encoding.
Exactly one vocabulary token that ends there is valid: the one that BPE would leave standing beside the last token of
what precedes it. Whether two tokens may stand side by side is decided by undoing their merges from the seam outwards.
The table makes appends exact (go on where it ends) and edits local (only prefixes near the edit are computed again).

Defined results: null and empty texts give an empty list, never null; the vocabulary's special strings in a text are
ordinary text; whole texts are encoded, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tilewright.session import Shared, widen

CACHE = 400_000  # words kept per Python worker
FLUSH = 1_000_000  # ids per output batch


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """Token -> the two tokens that BPE merges into it; single bytes have none."""
    out = {}
    for token, rank in ranks.items():
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class Vocabulary:
    """Ranks, merges and the automaton of all tokens; built once per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.merges = merge_table(ranks) if merges is None else merges
        self.pairs = {lr: t for t, lr in self.merges.items()}
        self.split = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.auto = ahocorasick.Automaton()
        whole = {t: True for t in self.merges}
        for token, rank in ranks.items():
            if len(token) == 1 or rank in whole:
                self.auto.add_word(token.decode("latin-1"), (rank, len(token)))
        self.auto.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` standing beside each other."""
        key = (left, right)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            got = self.known[key] = self._side_by_side(left, right)
        return got

    def _side_by_side(self, a: int, b: int) -> bool:
        # Undo the later of the two merges again and again. A merge across the seam that comes before the merge just
        # undone would have been made first, and the two tokens would never have come to be.
        pairs, merges, before = self.pairs, self.merges, 1 << 60
        while True:
            across = pairs.get((a, b))
            if across is not None and across < before:
                return False
            if a in merges and (a > b or b not in merges):
                before, a = a, merges[a][1]
            elif b in merges:
                before, b = b + 1, merges[b][0]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        got = self.words.get(word)
        if got is None:
            got = PrefixTable(self, word.encode("utf-8")).tokens()
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(word) < 200:
                self.words[word] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            words, add = self.words, out.extend
            for w in self.split.findall(text):
                ids = words.get(w)
                add(self.encode_word(w) if ids is None else ids)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        back = {r: t for t, r in self.ranks.items()}
        return b"".join(back[i] for i in ids)


class PrefixTable:
    """last[i]: (last token, its length) of the encoding of data[:i]."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data = vocabulary, b""
        self.last: list[tuple[int, int]] = [(-1, 0)]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the encoding of the old data is the start of the work, not thrown away."""
        n = len(self.data)
        self.data += more
        self._fill(n, len(self.data))

    def _fill(self, lo: int, hi: int, stop=None) -> int:
        """Compute last[lo+1 .. hi]; ``stop(i)`` may end it early. Returns how far it came."""
        base = max(0, lo - self.v.longest)
        found: dict[int, list[tuple[int, int]]] = {}
        last, beside, at = self.last, self.v.side_by_side, lo
        for end, token in self.v.auto.iter(self.data[base:hi].decode("latin-1")):
            i = base + end + 1
            if i <= lo or i <= at:
                continue
            p = i - token[1]
            if p < 0 or (p < base and base > 0):
                continue
            if p == 0 or beside(last[p][0], token[0]):
                last.append(token)
                at = i
                if stop is not None and stop(i):
                    return i
        assert at == hi, "the vocabulary lacks a byte"
        return hi

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many prefixes were computed again.

        Behind the edit the work ends as soon as the last tokens agree with the old table over the length of the
        longest token: from there on nothing can differ.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        same = 0

        def stop(i: int) -> bool:
            nonlocal same
            j = i - shift
            same = same + 1 if i > start + len(new) and j > end and self.last[i] == old[j] else 0
            return same > self.v.longest

        came = self._fill(start, len(self.data), stop)
        self.last.extend(old[came - shift + 1 :])
        return came - start

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            t, n = self.last[i]
            out.append(t)
            i -= n
        return out[::-1]


def _share(df: DataFrame, vocabulary: str | None):
    """The vocabulary file is read by the driver (its path is a parameter) and sent out: 50 thousand entries."""
    ranks = read_ranks(vocabulary or default_vocabulary())
    return Shared(df.sparkSession, (ranks, default_pattern(), merge_table(ranks)))


def encode(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    shared = _share(documents, vocabulary)

    def run(batches):
        v = shared.state(lambda parts: Vocabulary(*parts))
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            flat, offsets, lo = [], [0], 0
            for k, text in enumerate(texts):
                flat += v.encode(text.as_py())
                offsets.append(len(flat))
                if len(flat) >= FLUSH or k + 1 == len(texts):
                    lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, k + 1 - lo), lists], names=["doc_id", "ids"])
                    flat, offsets, lo = [], [0], k + 1

    return widen(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def sizes(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every document."""
    shared = _share(documents, vocabulary)

    def run(batches):
        v = shared.state(lambda parts: Vocabulary(*parts))
        for b in batches:
            n = pa.array([len(v.encode(t.as_py())) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=["doc_id", "tokens"])

    return widen(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, tokens long")
