import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_texts():
    """Nulls, empties, ties, copies, near copies, shared lines and a long text."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(400)]
    line = "a passage that many documents share, word for word"
    texts = [None, "", " ", "\n", "\n\n", "one", "One", "one two three", "one two  three", "Ünï ß 日本 😀", "x" * 3000, "<|endoftext|> a <|startoftext|>", "tab\tand\x0bmore\r\nlines"]
    base = [" ".join(r.choices(words, k=60)) for _ in range(12)]
    for b in base:
        texts += [b, b, f"{line}\n{b}", " ".join(w if r.random() > 0.02 else "zz" for w in b.split())]
    texts.append(" ".join(r.choices(words, k=9000)))
    texts.append(" ".join(r.choices(words, k=240_000)) + "\n" + line)  # over 1 MiB
    texts.append("".join(r.choices("abc", k=1_100_000)))  # over 1 MiB without a space
    return texts


@pytest.fixture(scope="session")
def rows():
    t = odd_texts()
    out = [(i, x, "en", f"s{i % 5}" if i % 7 else None, len(x or "")) for i, x in enumerate(t)]
    return [*out, out[9], out[15], (None, t[13], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    # further columns whose names an operator may use itself
    extra = {c: F.lit("mine") for c in ("size", "h", "id", "sha", "kept", "score", "line", "piece", "copies", "v")}
    return spark.createDataFrame(rows, COLUMNS).withColumns(extra).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
