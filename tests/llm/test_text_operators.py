"""Operators over documents against plain versions, with nulls, ties, repeated rows and empty tables."""

from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, token_count
from kinetrace.llm.queries import tokenizer_path


def test_exact_dedup(docs, rows, empty):
    got = Counter(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    want = exact_dedup.brute_force([(r[0], r[1]) for r in rows]).astype(object)
    assert got == Counter(tuple(None if x != x else x for x in r) for r in want.itertuples(index=False))
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_bloom_filter_misses_no_repeat(spark):
    r = np.random.default_rng(1)
    h = r.integers(-(1 << 62), 1 << 62, 20000)
    h = np.concatenate((h, h[:500], h[:3]))
    df = spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(5)
    out = exact_dedup.possibly_repeated(df, "h", exact_dedup.filter_size(len(h))).collect()
    times = Counter(h.tolist())
    assert len(out) == len(h)
    assert all(x["__kt_maybe"] for x in out if times[x.h] > 1)
    assert sum(x["__kt_maybe"] for x in out if times[x.h] == 1) < 0.02 * len(h)


def test_exact_dedup_in_slices_of_the_filter(spark, docs, rows, monkeypatch):
    """A filter of many small segments, tested slice by slice from a table kept apart by slice."""
    monkeypatch.setattr(exact_dedup, "A_SLICE", 3)
    monkeypatch.setattr(exact_dedup, "filter_size", lambda n: 10)
    got = Counter(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    want = exact_dedup.brute_force([(r[0], r[1]) for r in rows]).astype(object)
    assert got == Counter(tuple(None if x != x else x for x in r) for r in want.itertuples(index=False))


@pytest.mark.parametrize("sent", [line_dedup.MAX_SENT, 0])
def test_line_dedup(docs, rows, empty, monkeypatch, sent):
    from kinetrace.llm import common

    monkeypatch.setattr(line_dedup, "MAX_SENT", sent)
    want = Counter((r[0], n, n - k, t) for r, (n, k, t) in zip(rows, plain.kept_lines(rows)))
    before = len(common._made)
    out = line_dedup.dedup_lines(docs)
    assert len(common._made) <= before + 4  # of each batch its dropped lines, and no run
    got = Counter((r.doc_id, r["__kt_n_lines"], r["__kt_n_dropped"], r["__kt_kept"]) for r in out.collect())
    assert got == want
    assert set(docs.columns) < set(out.columns)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_leaves_nothing_behind_by_an_error(spark, docs, monkeypatch):
    from kinetrace.llm import common

    def fails(*_):
        raise RuntimeError("no more")

    monkeypatch.setattr(line_dedup, "join_groups", fails)
    before, names = list(common._made), {t.name for t in spark.catalog.listTables()}
    with pytest.raises(RuntimeError, match="no more"):
        line_dedup.dedup_lines(docs)
    assert common._made == before and {t.name for t in spark.catalog.listTables()} == names


def test_near_dedup(docs, rows, empty):
    sets, label = plain.components(rows)
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == label.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_of_large_groups(spark):
    """Groups larger than a leaf, with a chain of edits and a text that only one member links."""
    r = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]
    base = r.choice(words, 150).tolist()
    texts = []
    for _ in range(300):
        t = list(base)
        for _ in range(r.integers(0, 5)):
            t[r.integers(0, len(t))] = "e" + str(r.integers(0, 100000))
        texts.append(" ".join(t))
    texts += [" ".join([*base[k:], *r.choice(words, k).tolist()]) for k in range(0, 60, 4)]
    texts += [f"shared words that open many different texts here {' '.join(r.choice(words, 12))}" for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    _, label = plain.components(rows)
    got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == label


def links_by_band(rows):
    """{band: pairs} of all pairs of similarity 0.75 or more, found through shared shingles."""
    sets = {}
    for i, t, *_ in rows:
        w = plain.WORD.findall((t or "").translate(plain.LOWER))
        sets[i] = {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))} if w else set()
    by, common = defaultdict(list), Counter()
    for i, x in sets.items():
        for h in x:
            by[h].append(i)
    for ids in by.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    out = defaultdict(list)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (union := len(sets[a]) + len(sets[b]) - n):
            out[min(n * 20 // union, 19) / 20].append((a, b))
    return out


def test_near_dedup_finds_links_of_every_band(spark):
    """Of pairs that only their own link joins, and of all links among documents, by similarity."""
    r = np.random.default_rng(14)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    rows = []
    for k in range(400):  # one edited passage in the middle: similarities from 0.75 on
        x = new(120)
        m = int(r.integers(1, 14))
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join([*x[:60], *new(m), *x[60 + m :]]))]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for own in (rows, [tuple(x) for x in docs.collect()]):
        got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(spark.createDataFrame(own, "doc_id bigint, text string").repartition(4)).collect()}
        bands = links_by_band(own)
        share = {b: sum(got[x] == got[y] for x, y in p) / len(p) for b, p in bands.items()}
        assert len(bands) >= 3 and min(share.values()) >= 0.99, share


@pytest.mark.parametrize("few", [40])
def test_near_dedup_of_dense_nodes(spark, monkeypatch, few):
    """Texts that share most of their words without linking, with pairs among them that do."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    r = np.random.default_rng(15)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    base, texts = new(100), []
    pool = [new(40) for _ in range(14)]
    for k in range(260):  # a common part, and others in an order of their own that many share in part
        a, b = r.choice(len(pool), 2, False)
        x = [*base, *pool[a], *pool[b][:20]]
        texts.append(" ".join(x))
        if k % 4 == 0:
            x[50] = f"e{k}"
            texts.append(" ".join(x))
    rows = list(enumerate(texts))
    _, label = plain.components(rows)
    got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == label and len(set(label.values())) > 1


def joins_of(plan):
    """(name, rows made) of each join that ran."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joins_of(plan.executedPlan())
    if name.endswith("QueryStage"):
        return joins_of(plan.plan())
    below = plan.children()
    out = [x for k in range(below.size()) for x in joins_of(below.apply(k))]
    return [*out, (name, plan.metrics().apply("numOutputRows").value())] if "Join" in name else out


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_dedup_joins_make_only_rows_of_mixed_nodes(spark, broadcast):
    """Small and large nodes of one label and of several: no join may pass rows that no node needs."""
    sizes = {1: 2, 2: 2, 3: 300, 4: 6000, 5: 6000} | {100 + k: 1 for k in range(4000)}
    rows = [(n, 0, k if n in (2, 4) else 0, i) for i, (n, k) in enumerate((n, k) for n, m in sizes.items() for k in range(m))]
    df = spark.createDataFrame(rows, "node bigint, block bigint, label bigint, v bigint").repartition(8)
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k"}
    settings |= {} if broadcast else {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = near_dedup._Join(df, df.limit(1), 75, 5).several(df)
        got = out.collect()
        joins = joins_of(out._jdf.queryExecution().executedPlan())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((x.node, x.block, x.label, x.v, x["size"]) for x in got) == sorted((*x, sizes[x[0]]) for x in rows if x[0] in (2, 4))
    assert joins and max(n for _, n in joins) <= len(got), joins
    assert broadcast or "SortMergeJoin(skew=true)" in [name for name, _ in joins]  # a large node is split among tasks


def test_near_dedup_of_ids_with_two_texts(spark):
    """A pair that links, beside a less similar one of the same two ids with more shingles of its own."""
    r = np.random.default_rng(12)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    rows = []
    for k in range(150):
        x, y = new(84), new(84)
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join([*x[:40], *new(5), *x[45:]]))]
        rows += [(2 * k, " ".join(y)), (2 * k + 1, " ".join([*y[:40], *new(16), *y[56:]]))]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert [x for x in got if x.component_id != x.doc_id // 2 * 2] == []


def test_mix(docs, rows, empty):
    sizes, target = plain.targets(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], plain.size(r[1]), sizes[r[3]], round(target[r[3]], 6), n * plain.size(r[1]), n) for r, n in zip(rows, plain.copies(rows)))
    assert Counter((g.doc_id, g["size"], g.source_size, round(g.target, 6), g.taken, g.copies) for g in got) == want
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    copies = Counter()
    for g in got:
        copies[g.doc_id] += g.copies
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    assert Counter(r.doc_id for r in again.collect()) == +copies


def test_mix_of_rows_without_ids_or_with_one(spark):
    """Rows of a source that share an id, or have none, are taken one by one and not all together."""
    r = np.random.default_rng(8)
    rows = [(None if k % 2 else 7, " ".join(f"w{x}" for x in r.integers(0, 1000, 10)), None, "ab"[k % 3 > 0], None) for k in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 2 and all(abs(g.taken - g.target) <= 5 for g in got)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    want, total = plain.pieces(rows, Tokenizer.from_file(path))
    out = packing.pack_documents(docs, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    plain.check_bins(out, total)
    assert packing.pack_documents(empty, path).count() == 0


def test_packed_sequences_hold_the_ids(docs, rows):
    path = tokenizer_path("word_bpe_49k.json")
    placed = packing.pack(packing.token_pieces(docs, path, with_ids=True)).persist()
    ids = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    placed.unpersist()


def test_sum_of_squares_takes_the_least_growth():
    sizes = np.random.default_rng(2).integers(1, 21, 300)
    at, offset, fill = packing.sum_of_squares(sizes, 20)
    gaps, fills = Counter(), {}
    for s, b, o in zip(sizes, at, offset):
        cost = lambda g: ((gaps[g - s] + 1) ** 2 - gaps[g - s] ** 2 if g > s else 0) + ((gaps[g] - 1) ** 2 - gaps[g] ** 2 if g < 20 else 0)
        best = min(cost(g) for g in range(s, 21) if g == 20 or gaps[g])
        g = 20 - fills.get(b, 0)
        assert o == fills.get(b, 0) and cost(g) == best
        if g < 20:
            gaps[g] -= 1
        if g - s:
            gaps[g - s] += 1
        fills[b] = fills.get(b, 0) + s
    assert fill.max() <= 20


@pytest.mark.parametrize("text", ["", "a", "don't we'll", "  two  spaces ", "\n\n\tx\n", "日本語 テキスト 😀", "a<|endoftext|>b<|endoftext|>", "aaaaaaaaaaaaaaaa" * 40, "1234567 89,000.50", "  x", "İstanbul Σίσυφος"])
def test_token_count_of(text):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert token_count.Counter(path).count(text) == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows}
    got = Counter(map(tuple, token_count.count_tokens(docs, path).collect()))
    assert got == Counter((i, len((t or "").encode()), n[t], n[t] > 1024) for i, t, *_ in rows)
    assert token_count.count_tokens(empty, path).count() == 0


def test_merging_by_heap_equals_merging_by_scan():
    c = token_count.Counter(tokenizer_path("byte_bpe_50k.json"))
    r = np.random.default_rng(4)
    for _ in range(200):
        text = "".join(r.choice(list("abcdefghinorstu"), r.integers(1, 14)))
        ids = [c.first[b] for b in text.encode()]
        while True:
            ranks = [c.merges.get(p, (1 << 40, 0)) for p in zip(ids, ids[1:])]
            if not ranks or min(ranks)[0] == 1 << 40:
                break
            k = ranks.index(min(ranks))
            ids[k : k + 2] = [ranks[k][1]]
        assert c.piece(text) == len(ids)
