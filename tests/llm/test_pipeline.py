"""Every stage of the pipeline against a plain version, on odd rows, and on an empty table."""

from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest

import corpus_pipeline as p
from kinetrace.llm import common, features, packing, quality


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def five(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def plain_score(m, text):
    """All pairs of a document's features, one after another."""
    (_, _, stats, _, bucket, times), = features.extracted(pa.array([text]), quality.BITS)
    x = np.log1p(times)
    x = x / max(np.sqrt((x * x).sum()), 1e-9)
    z = np.clip((stats[0] - m.mean) / m.scale, -6, 6)
    at, value = np.concatenate((bucket, np.arange(1 << quality.BITS, len(m.w)))), np.concatenate((x, z))
    v = m.v[at].astype(float) * value[:, None]
    gram = v @ v.T
    return 1 / (1 + np.exp(-(m.w0 + m.w[at] @ value + np.triu(gram, 1).sum())))


def test_stages_one_by_one(spark, docs, folder, monkeypatch):
    models = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **b: models.append(fit(*a, **b)) or models[-1])
    columns = docs.columns
    rows = five(docs)

    def run(k, df):
        out = common.stored(p.STAGES[k][1](spark, df, folder), "stage")
        if k < 4:
            assert out.columns == columns
        return out

    out = run(0, docs)
    score = {t: plain_score(models[0], t) for t in {r[1] for r in rows}}
    got = Counter(five(out))
    assert 0 < sum(got.values()) < len(rows) or min(score.values()) > 0.3
    for r, n in Counter(rows).items():
        if abs(score[r[1]] - quality.CUT) > 1e-3:
            assert got[r] == (n if score[r[1]] >= quality.CUT else 0)

    out, rows = run(1, docs), rows  # the further stages on all documents, which have every odd case
    want = [(r[0], t, r[2], r[3], len(t)) for r, (_, _, t) in zip(rows, plain.kept_lines(rows))]
    assert Counter(five(out)) == Counter(want)

    docs, rows = out, want
    out = run(2, docs)
    _, label = plain.components(rows)
    want = [r for r in rows if r[0] is None or label[r[0]] == r[0]]
    assert Counter(five(out)) == Counter(want) and len(want) < len(rows)

    docs, rows = out, want
    out = run(3, docs)
    want = [r for r, n in zip(rows, plain.copies(rows)) for _ in range(n)]
    assert Counter(five(out)) == Counter(want)

    from tokenizers import Tokenizer

    placed = run(4, out).collect()
    pieces, total = plain.pieces(want, Tokenizer.from_file(p.tokenizer_path("word_bpe_49k.json")))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == pieces
    plain.check_bins(placed, total, packing.CAPACITY)


def test_run_is_its_stages_and_leaves_one_table(spark, folder, monkeypatch):
    """Every stage gets what the one before returned; all tables but the result's go."""
    seen = []

    def stage(name):
        def run(spark, docs, sf_dir):
            seen.append((name, docs.count()))
            common.stored(docs, "on-the-way")
            return docs.where("doc_id is null or doc_id > 0") if name == "a" else docs.limit(3)

        return run

    monkeypatch.setattr(p, "STAGES", [(n, stage(n)) for n in "ab"])
    before, n = len(common._made), spark.read.parquet(f"{folder}/documents.parquet").count()
    assert p.run(spark, folder).count() == 3 and len(common._made) == before + 1
    assert seen == [("a", n), ("b", n - 1)]


def test_empty_tables(spark, empty, folder):
    docs = empty
    for name, stage in p.STAGES:
        docs = common.stored(stage(spark, docs, folder), "stage")
        assert docs.count() == 0, name
        assert name == "packing" or docs.columns == empty.columns
