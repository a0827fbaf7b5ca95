"""Token counts by byte-pair merging with a heap over a linked list.

A text is split as the vocabulary's pre-tokeniser splits it. Each piece starts as its bytes, one symbol
each, in a doubly linked list; a heap holds the adjacent pairs that have a merge, by rank and then position.
The lowest pair is popped and joined, which puts its new neighbours on the heap. The count is the number of
first symbols minus the number of merges: no token id is ever made. Counts of pieces are remembered, in a
table of bounded size.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, worker_cache

#: Pieces remembered by one worker; longer ones than REMEMBER characters never are.
CACHE = 400_000
REMEMBER = 48
#: Characters of a text whose pieces are listed together.
AT_ONCE = 1 << 20
#: Fixed value: the pattern by which this family of vocabularies splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself if visible, else 256 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Counter:
    """Counts of one vocabulary file of the byte-level kind."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a byte-level vocabulary that splits by the known pattern")
        vocab = spec["model"]["vocab"]
        symbol = byte_symbols()
        self.first = [vocab[symbol[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Symbols left of one piece after all merges."""
        ids = [self.first[b] for b in text.encode("utf-8")]
        n = len(ids)
        if n < 2:
            return n
        merges = self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapify(heap)
        merged = 0
        while heap:
            _, new, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # a pair that an earlier merge took apart
            ids[i], ids[j] = new, -1
            merged += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heappush(heap, (*m, i, new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heappush(heap, (*m, h, ids[h], new))
        return n - merged

    def _plain(self, text: str) -> int:
        if len(text) <= AT_ONCE:
            return self._pieces(self.split.findall(text))
        total, found = 0, self.split.finditer(text)  # of a long text never all pieces at once
        while pieces := [m[0] for m in islice(found, AT_ONCE // 8)]:
            total += self._pieces(pieces)
        return total

    def _pieces(self, pieces: list[str]) -> int:
        known = self.known
        total = 0
        for count in map(known.get, pieces, repeat(0)):
            total += count
        missing = [p for p in pieces if p not in known] if 0 in map(known.get, pieces, repeat(0)) else ()
        for p in missing:
            if (n := known.get(p)) is None:
                n = self.piece(p)
                if len(p) <= REMEMBER:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; the strings of special tokens inside it count as one each."""
        if not text:
            return 0
        if self.special is None or not (parts := self.special.split(text))[1:]:
            return self._plain(text)
        return len(parts) - 1 + sum(map(self._plain, filter(None, parts)))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row a document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens; texts of any length count whole; repeated rows and null
    ids each give a row of their own, an empty table none. Other columns are not read. ``vocabulary`` is a
    file that every executor has.
    """

    def run(batches):
        counters = worker_cache("token counts")
        if vocabulary not in counters:
            counters[vocabulary] = Counter(vocabulary)
        count = counters[vocabulary].count
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [id_col, "n_bytes", "n_tokens", "over_limit"])

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
