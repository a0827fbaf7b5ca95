"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles. Sets get ``COORDINATES`` minwise tokens; two sets of similarity J
share each token with probability J. A tree starts with all sets at its root. A node sends its sets on
to children by chosen tokens: the sets with one value of one token make one child. Nodes of at most ``LEAF``
sets are compared exhaustively; larger ones branch again, by ``BRANCH`` tokens that a hash of the node picks.
``TREES`` independent trees are grown: a pair of similarity 0.75 that no node hides is missed by all roots
with probability 0.25 ** TREES, below one in a million, and with two tokens a level a pair lives on through
every further level of one tree with probability 0.88 at least.

Equal sets are one class from the start. What is large after one level is mostly a group of near copies, of
which a small part of the links is enough. So the first pass cuts large nodes into random blocks and
compares within those; its confirmed links give first components, and only nodes whose sets lie in two or more
of them branch on. Large nodes with at most ``FEW`` sets outside their largest component are compared exhaustively,
block by block, each set outside against all, once tokens do not take them apart or ``SETTLED`` levels are
grown; so a set has a bounded number of comparisons there. Others branch on until they are small, and only
what is left at ``DEPTH`` levels is compared whatever its size.

Signatures only choose pairs: every pair whose tokens agree in at least ``LOWEST`` (or ``FINE_LOWEST``) of the
coordinates is confirmed on the full sets of its whole texts. Within a node, pairs that nearly surely link are
confirmed along a spanning forest; if one of those fails, the second pass finds its sets in different components
and confirms all pairs between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches, join_groups, stored, tables, text_of
from .components import components

SHINGLE = 5
THRESHOLD = 75
COORDINATES = 64
TREES = 10
BRANCH = 2
DEPTH = 24
LEAF = 64
BLOCK = 256
#: Sets outside the largest component of a large node that are compared with all of it, at most, before ``DEPTH``.
FEW, SETTLED = 1 << 16, 3
#: Shingles of a pair above which it is confirmed alone, and not with the other pairs of the place where it was found.
LONG = 50_000
#: Ids broadcast to the scan of the texts, at most (some 40 bytes each); more meet them in a shuffle.
MAX_SENT = 500_000
#: Shares of agreeing coordinates: below LOWEST a pair of similarity 0.75 falls with probability 5e-6.
LOWEST, SURE = 0.5, 0.86
#: The same for the longer signatures of what is compared after the first tree: 7e-5.
FINE, FINE_LOWEST, FINE_SURE = 512, 0.675, 0.81

_U = np.uint64
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1 << 62, 1 << 63, COORDINATES + FINE, np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES + FINE, np.uint64)


def _shingled(column: pa.Array, size: int):
    """For parts of a text column: (from, to, shingles of each, all shingles one after another)."""
    for at, end, data, offsets in words.slices(column):
        h, doc, _, _ = words.words(data, offsets)
        owner, value = words.shingles(h, doc, end - at, size)
        yield at, end, np.bincount(owner, minlength=end - at), value


def _starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    has = np.flatnonzero(n)
    return has, np.concatenate(([0], np.cumsum(n[has])[:-1])) if len(has) else has


def _set_keys(n: np.ndarray, value: np.ndarray) -> np.ndarray:
    """128 bits for each set, zeros for the empty one."""
    key = np.zeros((len(n), 2), _U)
    has, first = _starts(n)
    if len(has):
        key[has, 0] = np.add.reduceat(words.mix(value), first)
        key[has, 1] = np.add.reduceat(words.mix(value ^ _U(0x5851F42D4C957F2D)), first)
    return key


def _signatures(n: np.ndarray, value: np.ndarray, first_k: int, count: int) -> np.ndarray:
    sig = np.zeros((len(n), count), np.uint32)
    has, first = _starts(n)
    if len(has):
        for k in range(count):
            sig[has, k] = np.minimum.reduceat((value * _MULTIPLY[first_k + k] + _ADD[first_k + k]) >> _U(32), first)
    return sig


def _finer(size: int):
    """(v, c, sig) of rows (v, c, text): more minwise tokens, 16 bits of each."""

    def run(batches):
        for b in batches:
            for at, end, n, value in _shingled(b.column(2), size):
                sig = words.mix(_signatures(n, value, COORDINATES, FINE).astype(_U)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), b.column(1).slice(at, end - at), _binary(sig)], ["v", "c", "sig"])

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _sign(size: int):
    def run(batches):
        for b in batches:
            for at, end, n, value in _shingled(b.column(1), size):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(n, pa.int64()), _binary(_set_keys(n, value)), _binary(_signatures(n, value, 0, COORDINATES))], ["id", "n", "c", "sig"])

    return run


def _node(parent: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return words.mix(words.mix(parent.astype(_U) + _U(0x9E3779B97F4A7C15) * (coordinate.astype(_U) + _U(1))) ^ token.astype(_U)).view(np.int64)


def _roots(batches):
    for b in batches:
        sig = _rows(b.column(2), np.uint32, COORDINATES)
        n = len(sig)
        node = np.concatenate([_node(np.zeros(n, _U), np.full(n, t), sig[:, t]) for t in range(TREES)]) if n else np.zeros(0, np.int64)
        at = pa.array(np.tile(np.arange(n), TREES))
        tree = pa.array(np.repeat(np.arange(TREES), n), pa.int32())
        yield pa.RecordBatch.from_arrays([tree, pa.array(node), b.column(0).take(at), b.column(1).take(at)], ["tree", "node", "v", "c"])


def _branch(batches):
    """(child, v, c, label, shared, parent) of rows (node, v, c, label, shared, size, sig): size becomes parent."""
    for b in batches:
        sig = _rows(b.column(6), np.uint32, COORDINATES)
        parent = b.column(0).to_numpy().view(_U)
        out, at = [], np.arange(len(sig))
        for k in range(BRANCH):
            # the node picks tokens, all different: a first one and a step
            first, step = words.mix(parent ^ _U(0xD1B54A32D192ED03)), words.mix(parent ^ _U(0x8CB92BA72F3D8DD7))
            coordinate = ((first + _U(k) * (step | _U(1))) % _U(COORDINATES)).astype(np.int64)
            out.append(_node(parent, coordinate, sig[at, coordinate]))
        node, at = np.concatenate(out), pa.array(np.tile(at, BRANCH))
        yield pa.RecordBatch.from_arrays([pa.array(node), *(b.column(k).take(at) for k in (1, 2, 3, 4, 5))], ["node", "v", "c", "label", "shared", "parent"])


def _groups(batches, keys: int):
    """Tables that hold whole groups of rows with equal first ``keys`` columns, which come one after another."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], 0)) + 1
        new = not held or any(x[0] != held[-1].column(i)[held[-1].num_rows - 1].as_py() for i, x in enumerate(k))
        if new and held:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _agree(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for k in range(0, len(i), 1 << 15):
        out[k : k + (1 << 15)] = (sig[i[k : k + (1 << 15)]] == sig[j[k : k + (1 << 15)]]).mean(1)
    return out


def _possible(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets can be similar enough, having ``n`` shingles of which others have ``shared``: an exact bound."""
    n, shared = (table.column(c).to_numpy() for c in ("n", "shared"))
    most = np.minimum(shared[i], shared[j])
    return 100 * most >= THRESHOLD * (n[i] + n[j] - most)


def _spare(i: list[int], j: list[int], share: list[float], label: list[int], sure: float) -> list[int]:
    """Of one node's pairs the places to confirm: a forest of the sure ones, and others between its trees.

    ``label`` has the component of each row; rows of one are in one tree from the start.
    """
    above: dict[int, int] = {}

    def root(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    keep, n = [], 0
    order = sorted(range(len(i)), key=lambda k: -share[k])
    for n, k in enumerate(order):
        if share[k] < sure:
            break
        a, b = root(label[i[k]]), root(label[j[k]])
        if a != b:
            above[a] = b
            keep.append(k)
    else:
        return keep
    return keep + [k for k in order[n:] if root(label[i[k]]) != root(label[j[k]])]


_PAIRS = "node bigint, block bigint, part bigint, a bigint, ca binary, b bigint, cb binary"
_PLACE = ["node", "block", "part"]


def _pairs(table: pa.Table, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Rows i and j as pairs, the smaller id first, with the place where they were found; long ones have a place of their own."""
    n = table.column("n").to_numpy()
    alone = n[i] + n[j] > LONG
    place = [np.where(alone, own, table.column(c).to_numpy()[i]) for c, own in zip(_PLACE, (v[i], v[j], np.full(len(i), -1)))]
    place = list(map(pa.array, place))
    low = v[i] <= v[j]
    i, j = np.where(low, i, j), np.where(low, j, i)
    c = table.column("c").combine_chunks()
    return pa.RecordBatch.from_arrays([*place, pa.array(v[i]), c.take(pa.array(i)), pa.array(v[j]), c.take(pa.array(j))], [*_PLACE, "a", "ca", "b", "cb"])


def _tokens(table: pa.Table) -> tuple[np.ndarray, float, float]:
    """(signatures, lowest, sure) of a table, whichever its signatures are."""
    column = table.column("sig").combine_chunks()
    if len(column) and len(column[0].as_py()) == 2 * FINE:
        return _rows(column, np.uint16, FINE), FINE_LOWEST, FINE_SURE
    return _rows(column, np.uint32, COORDINATES), LOWEST, SURE


def _compare(spare: bool):
    """Pairs to confirm, with different labels, of rows (node, block, part, v, c, label, sig) in the order of their nodes."""

    def run(batches):
        for table in _groups(batches, 2):
            node, block, v, label = (table.column(c).to_numpy() for c in ("node", "block", "v", "label"))
            sig, lowest, sure = _tokens(table)
            group = np.cumsum(np.concatenate(([True], (node[1:] != node[:-1]) | (block[1:] != block[:-1])))) - 1
            found = []
            for d in range(1, int(np.bincount(group).max())):
                i = np.flatnonzero((group[:-d] == group[d:]) & (label[:-d] != label[d:]))
                i = i[_possible(table, i, i + d)]
                share = _agree(sig, i, i + d)
                ok = share >= lowest
                found.append((i[ok], i[ok] + d, share[ok]))
            if not found:
                continue
            i, j, share = (np.concatenate(x) for x in zip(*found))
            if spare and len(i):
                order = np.argsort(group[i], kind="stable")
                i, j, share = i[order], j[order], share[order]
                g = group[i]
                cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
                labels, keep = label.tolist(), []
                for s, e in zip(cuts[:-1], cuts[1:]):
                    keep += [s] if e - s == 1 else [s + k for k in _spare(i[s:e].tolist(), j[s:e].tolist(), share[s:e].tolist(), labels, sure)]
                i, j = i[keep], j[keep]
            for k in range(0, len(i), 20_000):
                yield _pairs(table, v, i[k : k + 20_000], j[k : k + 20_000])

    return run


def _against(batches):
    """Pairs of rows (node, block, part, v, c, label, few, sig, nodes): those that are few against the block's others.

    ``nodes`` lists all nodes that a row is compared in; a pair that is in several is left to the smallest.
    """
    for table in _groups(batches, 3):
        cut = [table.column(k).to_numpy() for k in range(3)]
        starts = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in cut], 0), [True])))
        v, label, few = (table.column(c).to_numpy(zero_copy_only=False) for c in ("v", "label", "few"))
        nodes = table.column("nodes").to_pylist()
        sig, lowest, _ = _tokens(table)
        for s, e in zip(starts[:-1], starts[1:]):
            left, right = s + np.flatnonzero(few[s:e]), s + np.flatnonzero(~few[s:e])
            own, elsewhere = cut[0][s], {}
            for k, r in enumerate(right):
                for n in nodes[r]:
                    if n < own:
                        elsewhere.setdefault(n, np.zeros(len(right), bool))[k] = True
            for x in left:
                ok = label[right] != label[x]
                for n in nodes[x]:
                    if n < own and n in elsewhere:
                        ok &= ~elsewhere[n]
                i = right[ok]
                i = i[_possible(table, np.full(len(i), x), i)]
                i = i[_agree(sig, np.full(len(i), x), i) >= lowest]
                if len(i):
                    yield _pairs(table, v, np.full(len(i), x), i)


def _confirm(threshold: int, size: int):
    """``linked`` for the pairs among rows (node, block, part, a, ca, b, cb, text), by the full sets of a place's texts.

    A row with a text gives the text of class ``ca``; the others are pairs.
    """

    def run(batches):
        for table in _groups(batches, 3):
            cut = [table.column(k).to_numpy() for k in range(3)]
            group = np.cumsum(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in cut], 0)))).tolist()
            ca, cb = table.column("ca").to_pylist(), table.column("cb").to_pylist()
            text = table.column("text").combine_chunks()
            with_text = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
            sets = [x for _, _, n, value in _shingled(text.take(pa.array(with_text)), size) for x in np.split(value, np.cumsum(n)[:-1])]
            of = {(group[r], ca[r]): x for r, x in zip(with_text.tolist(), sets)}
            pairs = np.flatnonzero(text.is_null().to_numpy(zero_copy_only=False))
            ok = []
            for r in pairs.tolist():
                x, y = of[group[r], ca[r]], of[group[r], cb[r]]
                if len(x) < len(y):
                    x, y = y, x
                if 100 * len(y) < threshold * len(x):
                    ok.append(False)
                    continue
                inner = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                ok.append(100 * inner >= threshold * (len(x) + len(y) - inner))
            rows = pa.array(pairs)
            yield from table.select(["a", "ca", "b", "cb"]).take(rows).append_column("linked", pa.array(ok, pa.bool_())).to_batches()

    return run


def _keyed(size: int):
    """Of rows (v, c, text) those whose text has the key c."""

    def run(batches):
        for b in batches:
            keys = [k.tobytes() for _, _, n, value in _shingled(b.column(2), size) for k in _set_keys(n, value)]
            yield b.filter(pa.array([k == c for k, c in zip(keys, b.column(1).to_pylist())], pa.bool_()))

    return run


def _partnered(batches):
    """Rows (node, block, v, c, sig, ...) that agree enough with another of their block to be looked at again."""
    for table in _groups(batches, 2):
        node, block = (table.column(c).to_numpy() for c in ("node", "block"))
        sig = _rows(table.column("sig").combine_chunks(), np.uint32, COORDINATES)
        group = np.cumsum(np.concatenate(([True], (node[1:] != node[:-1]) | (block[1:] != block[:-1])))) - 1
        keep = np.zeros(len(group), bool)
        for d in range(1, int(np.bincount(group).max())):
            i = np.flatnonzero((group[:-d] == group[d:]) & ~(keep[:-d] & keep[d:]))
            i = i[_agree(sig, i, i + d) >= LOWEST]
            keep[i] = keep[i + d] = True
        yield from table.filter(pa.array(keep)).to_batches()


def _halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    key = _rows(column, np.int64, 2)
    return key[:, 0].copy(), key[:, 1].copy()


def _split(batches):
    """(c, c0, c1): of each key its halves, as numbers."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, _halves(b.column(0)))], ["c", "c0", "c1"])


def _spread(size: int):
    """(h, c0, c1): the shingles of rows (v, c, text), each with the halves of its class's key."""

    def run(batches):
        for b in batches:
            c0, c1 = _halves(b.column(1))
            for at, end, n, value in _shingled(b.column(2), size):
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.repeat(c0[at:end], n)), pa.array(np.repeat(c1[at:end], n))], ["h", "c0", "c1"])

    return run


class _Join:
    """One run of the join over the classes (v: smallest id, c: key, sig) of ``texts`` (id, text)."""

    def __init__(self, texts: DataFrame, classes: DataFrame, threshold: int, size: int):
        self.texts, self.classes, self.threshold, self.size = texts, classes, threshold, size

    def whole_texts(self, wanted: DataFrame) -> DataFrame:
        """A stored table (v, c, text) of the classes ``wanted`` (v, c)."""
        wanted = stored(wanted.distinct(), "wanted")
        sent = F.broadcast(wanted) if wanted.count() <= MAX_SENT else wanted
        found = self.texts.join(sent, self.texts["id"] == wanted["v"]).select("v", "c", "text")
        return stored(found.mapInArrow(_keyed(self.size), "v bigint, c binary, text string").dropDuplicates(["c"]), "texts")

    def ends(self, pairs: DataFrame) -> DataFrame:
        one, two = (pairs.select(*_PLACE, F.col(v).alias("v"), F.col(c).alias("c")) for v, c in (("a", "ca"), ("b", "cb")))
        return one.unionByName(two)

    def confirmed(self, pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """(a, ca, b, cb, linked) for distinct pairs: both full sets are made of the whole texts again.

        A pair is confirmed at one of the places where it was found, so a text is sent once for all pairs of
        its place and not for each.
        """
        one = pairs.groupBy("ca", "cb").agg(F.min(F.struct(*_PLACE, "a", "b")).alias("m")).select(*(F.col(f"m.{c}").alias(c) for c in (*_PLACE, "a", "b")), "ca", "cb")
        one = stored(one, "pairs")
        texts = self.whole_texts(self.ends(one).select("v", "c")) if texts is None else texts
        ends = self.ends(one).distinct().join(texts.select("c", "text"), "c")
        ends = ends.select(*_PLACE, F.col("v").alias("a"), F.col("c").alias("ca"), F.col("v").alias("b"), F.col("c").alias("cb"), "text")
        both = ends.unionByName(one.select(*_PLACE, "a", "ca", "b", "cb", F.lit(None).cast("string").alias("text")))
        both = both.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(_confirm(self.threshold, self.size), "a bigint, ca binary, b bigint, cb binary, linked boolean")
        return stored(both, "tested")

    def sharing(self, texts: DataFrame) -> DataFrame:
        """(c, n, shared): of each of ``texts`` the number of shingles, and of those that other classes have too.

        With ``m`` the smaller number of two sets, their similarity is at most ``m / (n1 + n2 - m)``: sets with
        edits of their own drop out against each other without a comparison.
        """
        found = texts.mapInArrow(_spread(self.size), "h bigint, c0 bigint, c1 bigint")
        own = found.groupBy("h").agg(F.count("*").alias("k"), F.min("c0").alias("c0"), F.min("c1").alias("c1")).where(F.col("k") == 1).groupBy("c0", "c1").agg(F.count("*").alias("own"))
        sizes = texts.select("c").mapInArrow(_split, "c binary, c0 bigint, c1 bigint").join(self.classes.select("c", "n"), "c")
        return stored(sizes.join(own, ["c0", "c1"], "left").select("c", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")), "sharing")

    def several(self, rows: DataFrame) -> DataFrame:
        """Rows (node, block, label, ...) of blocks that hold several labels, with the block's ``size``.

        Most rows are in no such block, so one join drops them. Few blocks are broadcast; with many, Spark splits a
        partition that a large block fills, for which both sides must come straight from a shuffle: so blocks are stored.
        """
        rows = stored(rows, "rows")  # read twice from here
        groups = rows.groupBy("node", "block").agg(F.count("*").alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"))
        groups = stored(groups.where(F.col("l0") != F.col("l1")).select("node", "block", "size"), "blocks")
        return rows.join(groups, ["node", "block"])

    def signed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.classes.select("c", "sig", "n"), "c")

    def finely_signed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.fine, "c")

    def in_blocks(self, rows: DataFrame) -> DataFrame:
        rows = rows.select("node", "block", F.lit(0).cast("bigint").alias("part"), "v", "c", "label", "sig", "n", "shared")
        return rows.repartition("node", "block").sortWithinPartitions("node", "block", "v")

    def branched(self, rows: DataFrame) -> DataFrame:
        """Children of nodes, rows (node, block, v, c, label, shared, parent, size), where they hold several labels."""
        rows = self.signed(rows).select("node", "v", "c", "label", "shared", "size", "sig")
        rows = rows.mapInArrow(_branch, "node bigint, v bigint, c binary, label bigint, shared bigint, parent bigint")
        return stored(self.several(rows.withColumn("block", F.lit(0).cast("bigint"))), "branched")

    def links(self) -> DataFrame:
        """(a, b): links that give the components of all links."""
        zero = F.lit(0).cast("bigint")
        blocks = F.when(F.col("size") <= LEAF, zero).otherwise(F.pmod(F.xxhash64("c", "node"), F.ceil(F.col("size") / (LEAF * 3 // 4))))
        roots = self.classes.select("v", "c", "sig").mapInArrow(_roots, "tree int, node bigint, v bigint, c binary").withColumns({"label": F.col("v"), "block": zero})
        roots = stored(self.several(roots), "nodes")
        leaves = self.signed(roots.withColumn("block", blocks)).select("node", "block", "v", "c", "sig", "n", "tree", "size")
        kinds = "node bigint, block bigint, v bigint, c binary, sig binary, n bigint, tree int, size bigint"
        leaves = stored(leaves.repartition("node", "block").sortWithinPartitions("node", "block").mapInArrow(_partnered, kinds), "leaves")

        def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
            return rows.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))

        # one tree joins most of what is similar
        tested = self.confirmed(self.in_blocks(leaves.where("tree = 0").withColumns({"label": F.col("v"), "shared": F.col("n")})).mapInArrow(_compare(True), _PAIRS))
        first = stored(components(tested.where("linked").select("a", "b")), "first")
        # the others and further levels look only at what is still apart, without the sets that have no partner at all
        leaves = self.several(labelled(leaves.withColumn("whole", F.col("size") <= LEAF).drop("size", "sig", "n"), first))
        leaves = stored(leaves, "leaves")
        big = self.several(labelled(roots.where(F.col("size") > LEAF).select("node", "block", "v", "c").withColumn("shared", zero), first))
        big = self.branched(big).drop("shared")
        texts = self.whole_texts(leaves.select("v", "c").unionByName(big.select("v", "c")))
        alive = stored(self.sharing(texts).where(100 * F.col("shared") >= self.threshold * F.col("n")), "alive")
        few = alive.count() <= MAX_SENT
        sent = F.broadcast(alive) if few else alive
        fine = texts.join(sent.select("c"), "c").select("v", "c", "text").mapInArrow(_finer(self.size), "v bigint, c binary, sig binary")
        self.fine = stored(fine.join(sent.select("c", "n"), "c").select("c", "sig", "n"), "fine")
        sent = sent.select("c", "shared")
        leaves, big = leaves.join(sent, "c"), big.join(sent, "c")
        new = self.in_blocks(self.finely_signed(leaves)).mapInArrow(_compare(True), _PAIRS).join(tested.select("ca", "cb"), ["ca", "cb"], "left_anti")
        tested = tested.unionByName(self.confirmed(new, texts))
        second = stored(components(tested.where("linked").select("a", "b")), "second")
        # all pairs that are left, wherever a node holds several components
        small = self.several(labelled(leaves.where("whole").drop("label", "size"), second))
        pairs = self.in_blocks(self.finely_signed(small)).mapInArrow(_compare(False), _PAIRS)
        big = stored(self.several(labelled(big.drop("label", "size"), second)), "big")
        for level in range(1, DEPTH):
            if not big.take(1):
                break
            pairs = pairs.unionByName(self.in_blocks(self.finely_signed(big.where(F.col("size") <= LEAF))).mapInArrow(_compare(False), _PAIRS))
            large = big.where(F.col("size") > LEAF)
            each = large.groupBy("node", "label").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("parent").alias("parent"))
            nodes = each.groupBy("node").agg(F.max(F.struct("n", "label")).alias("m"), F.first("size").alias("size"), F.first("parent").alias("parent"))
            nodes = nodes.select("node", "size", F.col("m.label").alias("main"), (F.col("size") - F.col("m.n")).alias("outside"), "parent")
            # a child with most of its parent's sets is a dense group, which more levels take apart slowly
            dense = 2 * F.col("size") > F.col("parent") if level < SETTLED else F.lit(True)
            dense = dense & (F.col("outside") <= FEW) if level < DEPTH - 1 else F.lit(True)
            nodes = stored(nodes.select("node", "size", "main", "outside", dense.alias("dense")), "large")
            rows = join_groups(large.drop("size", "parent"), nodes, ["node"], "size", large.count())
            pairs = pairs.unionByName(self.remaining(rows.where("dense")))
            if level < DEPTH - 1:
                big = self.branched(rows.where(~F.col("dense")).drop("dense", "main", "outside"))
        pairs = pairs.dropDuplicates(["ca", "cb"])  # before the join: a pair may be in many nodes
        more = self.confirmed(pairs.join(tested.select("ca", "cb"), ["ca", "cb"], "left_anti"), texts)
        return tested.where("linked").unionByName(more.where("linked")).select("a", "b")

    def remaining(self, rows: DataFrame) -> DataFrame:
        """Pairs of nodes that stay large: every set outside the ``main`` component against all others, in blocks."""
        parts, blocks = (F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("bigint") for c in ("outside", "size"))
        rows = stored(self.finely_signed(rows.drop("block", "dense")), "remaining")
        rows = rows.join(rows.groupBy("c").agg(F.collect_set("node").alias("nodes")), "c")  # at most one a tree and branch
        few = rows.where(F.col("label") != F.col("main"))
        few = few.withColumn("part", F.pmod(F.xxhash64("c"), parts))  # the few are dealt into parts, each meets every block
        left = few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).withColumn("few", F.lit(True))
        parts = few.select("node", "part").distinct()
        right = rows.withColumn("block", F.pmod(F.xxhash64("c", F.lit(1)), blocks)).join(parts, "node").withColumn("few", F.lit(False))
        names = ["node", "block", "part", "v", "c", "label", "few", "sig", "n", "shared", "nodes"]
        both = left.select(names).unionByName(right.select(names))
        return both.repartition("node", "block", "part").sortWithinPartitions("node", "block", "part", "v").mapInArrow(_against, _PAIRS)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row a document: its id, ``n_shingles``, ``component_id`` and ``kept`` (the component's smallest id).

    Words are runs without space or 0x09-0x0D, A-Z lowered; a document of fewer than ``size`` words is one
    shingle, one without words (or with a null text) is empty and linked with nothing. Documents link if
    ``100 * intersection >= threshold * union``, for a threshold of 75 or more. A document with a null id takes no part: its component is null
    and it is kept. Rows of one id are one document that has all their links. Other columns are not read; an
    empty table gives no rows.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the signatures' cuts are made for a similarity of {THRESHOLD} or more in a hundred")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    bounded_batches(docs.sparkSession)
    with tables(docs.sparkSession) as keep:
        signed = stored(texts.mapInArrow(_sign(size), "id bigint, n bigint, c binary, sig binary"), "signed")
        full = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
        grouped = full.groupBy("c").agg(F.min(F.struct("id", "sig", "n")).alias("m"), F.count("*").alias("size"))
        classes = stored(grouped.select("c", F.col("m.id").alias("v"), F.col("m.sig").alias("sig"), F.col("m.n").alias("n"), "size"), "classes")
        labels = components(_Join(texts, classes, threshold, size).links())
        named = classes.select("c", "v", "size").join(labels, "v", "left").select("c", F.coalesce("label", "v").alias("component_id"), "size")
        named = stored(named, "named")
        keep(signed, named)
    rows = join_groups(full.select("id", "n", "c"), named, ["c"], "size", signed.count()).select("id", "n", "component_id")
    alone = signed.where((F.col("n") == 0) | F.col("id").isNull()).select("id", "n", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return rows.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
