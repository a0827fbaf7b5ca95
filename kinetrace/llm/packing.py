"""Best-fit packing into sequences of a fixed number of tokens, by the sum-of-squares rule.

``N(g)`` counts the open bins whose gap is ``g``. An item of size ``s`` goes into the bin, an open or a new
one, that leaves the sum of ``N(g)**2`` over the gaps from 1 to below the capacity smallest; ties go to the
smallest gap left. That keeps every residual gap about equally common, so that a partner for what comes is
at hand and bins end up full.

Level one packs the pieces where they are read, in windows of bounded size, without a shuffle. Bins that a
window has filled to the brim are final. The pieces of all other bins go to level two, which packs them by
the same rule in few, larger windows; only those pieces' narrow rows move.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, bounded_batches, stored, worker_cache

CAPACITY = 4096
#: Pieces packed together, at most: bounds a task's memory. A window leaves some bins open: at level one they are
#: packed again; at level two some hundred of each window's sequences, below 0.2 % of them, end not quite full.
WINDOW = 200_000
#: Chunks of text remembered by a worker, and the longest of them in characters.
CACHE, REMEMBER = 1_200_000, 64


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of each bin) for items of 1..capacity, placed one by one in the given order."""
    n = len(sizes)
    at, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    fill: list[int] = []
    count = np.zeros(capacity + 1, np.int64)  # count[0] stays 0: full bins are not counted
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.int64(1) << 60
    for i, s in enumerate(sizes.tolist()):
        # growth of the sum if the item takes a bin of gap g: (N(g-s)+1)^2 - N(g-s)^2 + (N(g)-1)^2 - N(g)^2
        here = count[s:capacity]
        best, cost = -1, 2 * int(count[capacity - s]) + 1 if s < capacity else 0  # a new bin
        if len(here):
            growth = np.where(here > 0, 2 * (count[: capacity - s] - here + 1), never)
            if here[0]:
                growth[0] = 1 - 2 * here[0]
            j = int(growth.argmin())
            if growth[j] <= cost and here[j]:
                best = j + s
        if best < 0:
            b = len(fill)
            fill.append(0)
            gap = capacity
        else:
            b, gap = bins[best].pop(), best
            count[best] -= 1
        at[i], offset[i] = b, fill[b]
        fill[b] += s
        gap -= s
        if gap:
            bins[gap].append(b)
            count[gap] += 1
    return at, offset, np.array(fill, np.int64)


def _pack_windows(size_col: str, capacity: int, level: int, names: list[str]):
    def run(batches):
        from pyspark import TaskContext

        base = (level << 61) | (TaskContext.get().partitionId() << 37)
        held, rows = [], 0

        def packed():
            nonlocal base
            table = pa.Table.from_batches(held)
            at, offset, fill = sum_of_squares(table.column(size_col).to_numpy(), capacity)
            for name, values in (("sequence_id", base + at), ("offset", offset), (P + "open", fill[at] < capacity)):
                table = table.append_column(name, pa.array(values))
            base += len(fill)
            return table.to_batches()

        for b in batches:
            for k in range(0, b.num_rows, WINDOW):
                part = b.slice(k, WINDOW).select(names)
                if rows + part.num_rows > WINDOW:
                    yield from packed()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from packed()

    return run


def pack(pieces: DataFrame, size_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: a gapless place for each in sequences of ``capacity``.

    Every row is an item of its own, whatever repeats; ``size_col`` is a bigint from 1 to ``capacity``. All
    other columns pass through, so keep them narrow. An empty table stays empty.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return _packed(pieces, lambda batches: batches, fields, pieces.columns, size_col, capacity)


def _packed(rows: DataFrame, made, fields: str, names: list[str], size_col: str, capacity: int) -> DataFrame:
    """``made`` turns batches of ``rows`` into pieces in the worker that then packs them."""
    schema = f"{fields}, sequence_id bigint, offset bigint, {P}open boolean"
    level_one = _pack_windows(size_col, capacity, 0, names)
    first = stored(rows.mapInArrow(lambda batches: level_one(made(batches)), schema), "packed")
    final = first.where(~F.col(P + "open")).drop(P + "open")
    rest = first.where(F.col(P + "open"))
    windows = max(1, -(-rest.count() // WINDOW))
    again = rest.repartition(windows, F.xxhash64("sequence_id", "offset")).select(names).mapInArrow(_pack_windows(size_col, capacity, 1, names), schema)
    return final.unionByName(again.drop(P + "open"))


class _Tokens:
    """Little-endian unsigned 32-bit ids of whole texts, through a memory of the library's answers for chunks.

    The vocabulary's splitting never crosses a space, so a text's ids are those of its chunks in order. Of
    chunks not seen before, those of letters go to the library as one text with spaces between; a token that
    ends a word tells where the next begins. A comma or full stop after letters is a token of its own, and
    ASCII letters are lowered by the vocabulary, so such chunks follow from their lowered letters.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.words = bool(suffix) and "Lowercase" in json.dumps(spec["normalizer"])
        if self.words:
            vocab = self.library.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            self.stops = {c: self.each([c])[0] for c in ",."}
            # for lowered letters, which normalising leaves as they are and which are one word each
            from tokenizers import models, pre_tokenizers

            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
            self.bare = Tokenizer(models.BPE(vocab=spec["model"]["vocab"], merges=merges, end_of_word_suffix=suffix))
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    @staticmethod
    def settled(chunk: str) -> bool:
        """Whether the library's normalising can do no more to it than lower the letters, one by one."""
        import unicodedata

        return unicodedata.is_normalized("NFC", chunk) and len(chunk.lower()) == len(chunk) and "\u03a3" not in chunk and unicodedata.is_normalized("NFC", chunk.lower()) and chunk.lower().rstrip(",.").isalpha()

    def of_letters(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(chunks), 1024):
            some = chunks[k : k + 1024]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stop = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist() if len(ids) and ids.max() < len(self.ends) else []
            if len(stop) == len(some):
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *stop], stop)]
            else:
                out += self.each(some)
        return out

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Put chunks that are not known yet among the known; those too long to remember are returned."""
        known = self.known
        if not self.words:
            rest, stems = list(new), {}
        else:
            fine = [c for c in new if c.isalpha() and len(c) <= REMEMBER]
            other = new.difference(fine)
            stopped = [c for c in other if c[-1] in ",." and len(c) <= REMEMBER and c[:-1].isalpha()]
            stems = {c: c.lower() for c in fine} | {c: c[:-1].lower() for c in stopped}
            # letters beyond ASCII may be changed by more than lowering
            odd = [c for c in stems if not c.isascii() and not self.settled(c)]
            rest = [*other.difference(stopped), *odd]
            for c in odd:
                del stems[c]
        letters = list(set(stems.values()).difference(known))
        known.update(zip(letters, self.of_letters(letters)))
        for c, stem in stems.items():
            if c is not stem:
                known[c] = known[stem] + self.stops[c[-1]] if c[-1] in ",." else known[stem]
        long: dict[str, bytes] = {}
        for k in range(0, len(rest), 4096):
            for c, x in zip(rest[k : k + 4096], self.each(rest[k : k + 4096])):
                (known if len(c) <= REMEMBER else long)[c] = x
        return long

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are not long all together."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
            known[""] = b""
        rows, holes = [], []
        for t in texts:
            chunks = t.replace("\n", " ").split(" ")
            found = list(map(known.get, chunks))
            i = -1
            try:
                while True:
                    i = found.index(None, i + 1)
                    holes.append((found, i, chunks[i]))
            except ValueError:
                rows.append(found)
        long = self.learn({c for _, _, c in holes})
        for found, i, c in holes:
            found[i] = long[c] if c in long else known[c]
        return [b"".join(r) for r in rows]


def _portions(texts: list[str | None], most: int = 1 << 20):
    """(first, count, parts): runs of whole texts of some ``most`` characters, or parts of one longer text, cut at spaces."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield first, len(held), held
            held, size = [], 0
        if len(t) > most:
            parts, at = [], 0
            while len(t) - at > most and (cut := t.find(" ", at + most)) >= 0:
                parts.append(t[at:cut])
                at = cut
            yield k, 1, [*parts, t[at:]]
            first = k + 1
            continue
        if not held:
            first = k
        held.append(t)
        size += len(t)
    if held:
        yield first, len(held), held


_PIECES = ["piece", "start", "length", "ids_crc32"]


def _token_pieces(vocabulary: str, id_col: str, capacity: int, end_id: int, with_ids: bool):
    names = [id_col, *_PIECES, *["ids"] * with_ids]

    def run(batches):
        known = worker_cache("packing")
        if vocabulary not in known:
            known[vocabulary] = _Tokens(vocabulary)
        ids_of = known[vocabulary].ids
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            ids = b.column(0)
            for first, count, parts in _portions(b.column(1).to_pylist()):
                tokens = ids_of(parts) if len(parts) == count else [b"".join(x for p in parts for x in ids_of([p]))]
                rows, at = [], []
                for i, x in enumerate(tokens, first):
                    x += end
                    for piece in range(-(-len(x) // step)):
                        part = x[piece * step : (piece + 1) * step]
                        at.append(i)
                        rows.append((piece, piece * capacity, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                piece, start, length, crc, part = zip(*rows)
                columns = [ids.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype("i4") for p in part], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _piece_schema(docs: DataFrame, id_col: str, with_ids: bool) -> str:
    return f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``.

    A document is the ids of its whole text, null counting as empty, and then ``end_id``; only one longer
    than ``capacity`` is cut. Repeated rows and null ids give pieces like any other; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    run = _token_pieces(vocabulary, id_col, capacity, end_id, with_ids)
    return docs.select(id_col, text_col).mapInArrow(run, _piece_schema(docs, id_col, with_ids))


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence with its ``ids``, from ``pack(token_pieces(..., with_ids=True))``: at most a capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack: a row a piece with id, piece, start, length, ids_crc32, sequence_id and offset."""
    bounded_batches(docs.sparkSession)
    made = _token_pieces(vocabulary, id_col, capacity, 1, False)
    return _packed(docs.select(id_col, text_col), made, _piece_schema(docs, id_col, False), [id_col, *_PIECES], "length", capacity)
