"""Plain versions of the operators over rows (doc_id, text, lang, source, n_chars) in memory."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def last(i):
    return (i is None, i)


def kept_lines(rows):
    """(lines, text left) of each row."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owner[key(x)] = min(owner.get(key(x), i), i, key=last)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), i) == i]
        out.append((len(lines), len(kept), "\n".join(kept)))
    return out


def components(rows):
    """(shingle sets of each id, smallest id that each id reaches)."""
    sets, links = {}, defaultdict(set)
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                links[a].add(b)
    label = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            if (x := todo.pop()) not in label:
                label[x] = i
                todo += links[x]
    return sets, label


def size(t):
    return len(WORD.findall(t or ""))


def targets(rows):
    """(size, target) of each source."""
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not above:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= above
    return sizes, target


def copies(rows):
    """How often each row is taken: whole turns, and one more in the order of the hash up to the sum nearest the rest."""
    sizes, target = targets(rows)
    key = lambda i, t: int(hashlib.md5(f"{'' if i is None else i} {t or ''}".encode()).hexdigest()[:15], 16)
    by = defaultdict(Counter)
    for i, t, _, s, *_ in rows:
        by[s][key(i, t)] += size(t)
    turns, cut = {}, {}
    for s, own in by.items():
        turns[s] = min(int(target[s] // max(sizes[s], 1)), 3)
        rest, below, cut[s] = target[s] - turns[s] * sizes[s], 0, -1
        for h in sorted(own) if rest > 0 else ():
            if below >= rest or (below + own[h] >= rest and not below + own[h] - rest < rest - below):
                break
            below, cut[s] = below + own[h], h
    return [turns[s] + (key(i, t) <= cut[s]) for i, t, _, s, *_ in rows]


def pieces(rows, library, capacity=4096):
    """((id, piece, start, length, checksum) and how often, total of tokens)."""
    out, total, known = Counter(), 0, {}
    for i, t, *_ in rows:
        if t not in known:
            known[t] = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        ids = known[t]
        total += len(ids)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out[i, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    return out, total


def check_bins(placed, total, capacity=4096):
    """Sequences without gaps, none too long, and hardly more than the tokens need."""
    bins = defaultdict(list)
    for r in placed:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-total // capacity) + 2
