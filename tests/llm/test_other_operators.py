"""Archives, vector search, classifiers and the pipeline."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import quality, toxicity, vector_search, warc, words
from kinetrace.llm.common import new_path, stored


def test_words_of_a_batch_are_words_of_each_text():
    import pyarrow as pa

    texts = ["a bb  ccc", "", None, " lead", "trail ", "Ünï x\ty\nz", "same SAME", "a bb"]
    for at, end, data, offsets in words.slices(pa.array(texts), 16):
        h, doc, start, stop = words.words(data, offsets)
        for d in range(at, end):
            mine = [bytes(data[s:e]).decode() for s, e, k in zip(start, stop, doc) if k == d - at]
            assert mine == (texts[d] or "").split()
    _, _, data, offsets = next(words.slices(pa.array(texts)))
    h, doc, *_ = words.words(data, offsets)
    by = {d: h[doc == d].tolist() for d in range(len(texts))}
    assert by[6][0] == by[6][1] and by[7] == by[0][:2] and len(set(by[0])) == 3


PAGES = [(3, "u3", "<p>same</p>"), (1, "u1", "<p>same</p>"), (2, None, None), (4, "u4", ""), (5, "u\r\nX: 5", "é日本 WARC/1.1\r\n\r\n\x1f\x8b"), (None, "n", "<p>same</p>"), (7, "u7", "x" * 100_000), (1, "u1", "<p>same</p>")]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("sha", F.lit("mine")).repartition(3)
    got = Counter(map(tuple, warc.round_trip(df).collect()))
    first = {}
    for i, _, h in PAGES:
        k = (h or "").encode()
        first[k] = min(first.get(k, i), i, key=lambda x: (x is None, x))
    want = Counter()
    for i, _, h in PAGES:
        k = (h or "").encode()
        sum_ = base64.b32encode(hashlib.sha1(k).digest()).decode()
        want[i, len(k), sum_, "response" if first[k] == i else "revisit", None if first[k] == i else first[k]] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_hold_urls_and_payloads(spark):
    df = spark.createDataFrame([(k, f"http://x/{k}", f"<b>{k}</b>") for k in range(50)], "page_id bigint, url string, html string")
    path = new_path(spark, "warc-test")
    assert warc.archive(df, path).agg(F.sum("records")).first()[0] == 50
    got = {r.page_id: (r.target_uri, bytes(r.payload)) for r in warc.read_warc(spark, path).collect()}
    assert got == {k: (f"http://x/{k}", f"<b>{k}</b>".encode()) for k in range(50)}


def test_round_trip_of_a_very_long_url(spark):
    df = spark.createDataFrame([(1, "http://x/" + "é" * (1 << 20), "<p>a</p>"), (2, "u2", "<p>b</p>")], "page_id bigint, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(df).collect()) == [1, 2]


def test_round_trip_fails_by_a_gap(spark, monkeypatch):
    monkeypatch.setattr(warc, "write_warc", _with_junk(warc.write_warc))
    df = spark.createDataFrame([(1, "u1", "<p>a</p>")], "page_id bigint, url string, html string")
    with pytest.raises(Exception, match="gap in an archive just written"):
        warc.round_trip(df).collect()


def _with_junk(write):
    def run(records, path):
        out = write(records, path)
        for f in out.collect():
            with open(f.file.removeprefix("file:"), "ab") as end:
                end.write(b"junk")
        return out

    return run


def test_files_of_lost_attempts_are_not_read(spark):
    """What a task left behind before it died, beside the files that count or in their staging folder."""
    df = spark.createDataFrame([(k, f"u{k}", f"<b>{k}</b>") for k in range(20)], "page_id bigint, url string, html string")
    path = new_path(spark, "warc-test")
    files = warc.archive(df, path)
    local = path.removeprefix("file:")
    for name in ("_attempts/7-7-0", "part-000099-00000.warc.gz"):
        with open(f"{local}/{name}", "wb") as f:
            f.write(warc.member(warc.record(3, "u3", b"<b>3</b>", None, False))[:-4])
    assert sorted(r.page_id for r in warc.read_files(files).collect()) == list(range(20))
    os.remove(f"{local}/part-000099-00000.warc.gz")
    assert sorted(r.page_id for r in warc.read_warc(spark, path).collect()) == list(range(20))


def test_publishing_twice_is_no_error(spark, monkeypatch):
    """Several files a task; their moves run again when the table of files is made again."""
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    df = spark.createDataFrame([(k, f"u{k}", f"<b>{k}</b>") for k in range(20)], "page_id bigint, url string, html string").coalesce(2)
    plans = []
    monkeypatch.setattr(warc, "stored", lambda df, name: plans.append(df) or stored(df, name))
    files = warc.archive(df, new_path(spark, "warc-test"))
    assert plans[-1].count() == files.count() > 2
    assert sorted(r.page_id for r in warc.read_files(files).collect()) == list(range(20))


@pytest.mark.parametrize("block,held", [(64, 1 << 10), (1 << 12, 1 << 14)])
def test_salvage_reads_pieces_like_the_whole(tmp_path, monkeypatch, block, held):
    """Files read block by block and members inflated twice give what bytes in memory give, damaged or not."""
    import pyarrow as pa

    r = random.Random(10)
    records = [warc.record(k, f"u{k}", r.randbytes(r.randint(0, 6000)), None, False) for k in range(25)]
    several = warc.member(b"".join(records[:15]))
    whole = b"junk" + b"".join(map(warc.member, records[15:])) + several + records[3] + several[: len(several) // 2] + warc.member(records[4])
    bad = bytearray(whole)
    for _ in range(6):
        bad[r.randrange(len(bad))] ^= 0x5A
    for data in (whole, bytes(bad)):
        want = list(warc.salvage(data))
        (tmp_path / "x").write_bytes(data)
        with monkeypatch.context() as m, pa.OSFile(str(tmp_path / "x")) as f:
            m.setattr(warc, "BLOCK", block)
            m.setattr(warc, "HELD", held)
            assert list(warc.salvage(warc._File(f))) == want
    assert sum(h is not None for _, _, h, _, _ in warc.salvage(whole)) >= 27


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_loses_only_what_is_damaged(packed):
    r = random.Random(8)
    records = [warc.record(k, f"u{k}", f"payload {k} {r.random()}".encode() * 20, None, False) for k in range(30)]
    parts = [warc.member(x) if packed else x for x in records]
    starts = np.cumsum([0, *map(len, parts)])
    whole = b"".join(parts)
    assert [h["x-page-id"] for _, _, h, _, _ in warc.salvage(whole)] == [str(k) for k in range(30)]
    bad = bytearray(whole)
    for k in (0, 7, 8, 29):
        for x in range(len(parts[k]) - 30, len(parts[k]) - 15):
            bad[starts[k] + x] ^= 0x5A
    cut = bytes(bad[: starts[20] + 30]) + bytes(bad[starts[21] :])  # the record 20 loses its end
    out = list(warc.salvage(b"junk" + cut))
    assert [int(h["x-page-id"]) for _, _, h, _, _ in out if h] == [k for k in range(30) if k not in (0, 7, 8, 20, 29)]
    assert sum(n for _, n, *_ in out) == len(cut) + 4  # every byte is in a record or a gap
    assert all(why for *_, h, _, why in out if h is None) and sum(h is None for _, _, h, _, _ in out) == 4
    assert list(warc.salvage(b"")) == []


def test_salvage_within_a_member_of_several_records():
    r = random.Random(9)
    records = [warc.record(k, f"u{k}", f"payload {k} {r.random()} ".encode() + r.randbytes(3000), None, False) for k in range(60)]
    starts = np.cumsum([0, *map(len, records)])

    def ids(data):
        out = list(warc.salvage(data))
        assert all(why for *_, h, _, why in out if h is None)
        return [int(h["x-page-id"]) for _, _, h, _, _ in out if h], [why for *_, h, _, why in out if h is None], {why for *_, h, _, why in out if h}

    whole = b"".join(records)
    assert ids(warc.member(whole)) == (list(range(60)), [], {None})
    bad = bytearray(whole)
    for k in (0, 7, 8, 59):
        bad[starts[k + 1] - 100] ^= 0x5A
    got, gaps, _ = ids(warc.member(bytes(bad)))
    assert got == [k for k in range(60) if k not in (0, 7, 8, 59)] and len(gaps) == 3
    last = warc.member(warc.record(99, "u99", b"last", None, False))
    for level in (0, 3):  # stored and packed
        m = warc.member(whole, level)
        got, gaps, why = ids(m[: len(m) * 2 // 3])  # a cut-off end
        assert got == list(range(len(got))) and 37 <= len(got) <= 40 and gaps and why == {"member cut off"}
        got, gaps, _ = ids(m[: len(m) * 2 // 3] + last)  # a cut-off end before another member
        assert got[-1] == 99 and got[:-1] == list(range(len(got) - 1)) and 37 <= len(got) <= 41 and gaps
        got, gaps, why = ids(m[:-6] + b"\0\0" + m[-4:] + last)  # a wrong checksum
        assert got == [*range(60), 99] and len(gaps) == 1 and why == {"member does not decompress", None}
    m = bytearray(warc.member(whole))
    m[len(m) // 2 : len(m) // 2 + 40] = bytes(40)
    got, gaps, _ = ids(bytes(m) + last)
    assert got[-1] == 99 and got[:29] == list(range(29)) and len(set(got)) == len(got) and gaps


def exact_top(rows, k):
    v = [(i, tuple(np.floor(1024 * np.array(x, float)).astype(int).tolist())) for i, x in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    queries = {}
    for i, x in v:
        if i is not None and i % 100 == 0:
            queries[i] = min(queries.get(i, x), x)
    out = Counter()
    for i, q in queries.items():
        scores = [(-sum(a * b for a, b in zip(q, x)), j is None, j) for j, x in v if j != i and len(x) == len(q)]
        for n, (s, _, j) in enumerate(sorted(scores, key=lambda t: (t[0], t[1], t[2] or 0))[:k]):
            out[i, n + 1, j, -s] += 1
    return out


def vectors():
    r = np.random.default_rng(6)
    rows = [(k, r.normal(0, 0.2, 8).astype(np.float32).tolist()) for k in range(900)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)]  # one vector very often
    rows += [(2000, None), (2001, []), (2002, [0.1, None] + [0.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2100, [0.5, 0.25]), (2101, [1.0, -1.0]), (None, rows[1][1]), rows[5], rows[100]]
    best = sorted(range(900), key=lambda k: -np.dot(np.floor(1024 * np.array(rows[300][1])), np.floor(1024 * np.array(rows[k][1]))))
    rows += [rows[best[9]]] * 3 + [rows[best[1]]] * 2  # repeated rows around the last rank
    return [*rows, (400, rows[7][1])]  # a second vector of a query's id


@pytest.mark.parametrize("sample,rounds", [(1 << 16, 4), (100, 4), (100, 2)])
def test_vector_search(spark, monkeypatch, sample, rounds):
    monkeypatch.setattr(vector_search, "SAMPLE", sample)
    monkeypatch.setattr(vector_search, "ROUNDS", rounds)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("mine")).repartition(5)
    got = Counter(map(tuple, vector_search.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == exact_top(rows, 10)
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_vector_search_beyond_exact_doubles(spark):
    """Scores near 2**61 that differ by less than a double can tell: bounds are as wide as rounding may move them."""
    r = np.random.default_rng(3)
    base = 2.0**20
    rows = [(k, [float(base + x) for x in r.integers(0, 40, 2)]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = vector_search.top_k(df, F.col("vec_id") % 100 == 0, k=10)
    want = Counter()
    for i in range(0, 400, 100):
        q = [int(1024 * x) for x in rows[i][1]]
        scores = sorted((-sum(a * int(1024 * b) for a, b in zip(q, x)), j) for j, x in rows if j != i)
        want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:10]))
    assert Counter(map(tuple, got.collect())) == want


def test_cell_bounds_hold():
    r = np.random.default_rng(7)
    m = r.integers(-3000, 3000, (500, 16))
    grid = vector_search.Grid(m.min(0), m.max(0))
    low, high = grid.bounds(grid.codes(m))
    assert (low <= m).all() and (m <= high).all()


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_on_documents_it_has_not_seen(spark, tables):
    docs, labels = tables
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.985
    assert got[got.quality == 1].predicted.mean() > 0.99
    assert got.score.between(0, 1).all()


def test_scores_depend_on_texts_alone(spark, tables):
    docs, labels = tables
    some = docs.where("doc_id % 40 = 1")
    model = quality.fit(docs, labels)
    a = {r.text: r.score for r in quality.scored(some, model).collect()}
    changed = some.withColumns({"doc_id": F.lit(7), "lang": F.lit(None).cast("string"), "source": F.lit("x"), "n_chars": F.lit(0)})
    b = {r.text: r.score for r in quality.scored(changed, model).collect()}
    assert a == b


def test_sum_of_squares_identity():
    r = np.random.default_rng(9)
    k, n = 11, 5
    m = quality.Machine(0.3, r.normal(size=64 + k), r.normal(size=(64 + k, 4)), np.zeros(k), np.ones(k))
    doc, bucket, times = np.repeat(np.arange(n), 6), np.concatenate([r.choice(64, 6, False) for _ in range(n)]), r.integers(1, 5, 6 * n)
    z = r.normal(size=(n, k))
    x = quality.weights_of(doc, times, n)
    got, _ = quality._totals(m, n, doc, bucket, x, z)
    for d in range(n):
        at = np.concatenate((bucket[doc == d], np.arange(64, 64 + k)))
        value = np.concatenate((x[doc == d], z[d]))
        pairs = sum(m.v[at[i]] @ m.v[at[j]] * value[i] * value[j] for i in range(len(at)) for j in range(i))
        assert abs(got[d] - (0.3 + m.w[at] @ value + pairs)) < 1e-4


def test_toxicity_on_documents_it_has_not_seen(spark, tables):
    docs, labels = tables
    chain = toxicity.fit(docs, labels)
    assert chain.names == ("quality", "toxic") and [len(x.dense) for x in chain.links] == [12, 13]
    got = toxicity.classify(docs, labels, chain=chain).withColumnRenamed("toxic", "found").join(labels, "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 1].found.mean() > 0.93
    assert got[got.toxic == 0].found.mean() < 0.005


def test_a_chain_is_a_loop_over_its_links():
    """Probabilities of a chain of three categories against one document and one weight at a time."""
    r = np.random.default_rng(2)
    n, k = 300, 4
    counts = r.integers(0, 9, n)
    cut = np.concatenate(([0], np.cumsum(counts)))
    bucket = np.concatenate([r.choice(40, c, False) for c in counts])
    doc = np.repeat(np.arange(n), counts)
    stats = r.normal(size=(n, k))
    first = (np.bincount(doc[bucket < 8], minlength=n) > 1).astype(float)
    second = ((stats[:, 0] > 0) * first + (r.random(n) < 0.05) > 0).astype(float)
    y = np.column_stack((first, second, first * (1 - second)))
    chain = toxicity.train_chain(("a", "b", "c"), y, stats, cut, bucket)
    got = toxicity.chained(chain, stats, doc, bucket)
    for d in range(n):
        seen, earlier = bucket[doc == d], []
        z = [min(6, max(-6, (x - m) / s)) for x, m, s in zip(stats[d], chain.mean, chain.scale)]
        for link in chain.links:
            logit = link.bias + sum(w for b, w in zip(link.buckets, link.weights) if b in seen)
            logit += sum(w * x for w, x in zip(link.dense, [*z, *earlier]))
            earlier.append(1 / (1 + np.exp(-logit)))
        assert np.allclose(got[d], earlier)
    assert ((got[:, 2] >= 0.5) == y[:, 2]).mean() > 0.9 and [len(x.dense) for x in chain.links] == [4, 5, 6]


def test_earlier_probabilities_are_out_of_fold(monkeypatch):
    """Each link but the last is trained once for each fold, on the documents outside it."""
    seen, train = [], toxicity.train_link
    monkeypatch.setattr(toxicity, "train_link", lambda y, *a, **b: seen.append(len(y)) or train(y, *a, **b))
    r = np.random.default_rng(4)
    y = r.integers(0, 2, (40, 2)).astype(float)
    toxicity.train_chain(("a", "b"), y, r.normal(size=(40, 3)), np.arange(41), r.integers(0, 9, 40), folds=4)
    assert seen == [40, 30, 30, 30, 30, 40]


def test_classifiers_on_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
    for operator in (quality.classify, toxicity.classify):
        out = operator(docs, labels)
        got = out.collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
        assert operator(empty, labels).count() == 0
        assert operator(docs, labels.limit(0)).count() == len(rows)
