"""Every text query over an empty table and over one with nulls everywhere, repeated rows, long texts and clashing columns."""

import pytest

import corpus_pipeline
from matchlight.llm import registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, __key string, size string, spans int, class_id string"


def rows():
    long = " ".join(f"word{i % 977} of the text" for i in range(40_000))
    texts = [None, "", " ", "\n\n", "a", "é𝄞", long, long, "x" * 200_000, "same line here\n" * 300, "Under the MIT license. me@host.org 10.1.2.3", "Under the MIT license. me@host.org 10.1.2.3"]
    out = [(i, t, None, None if i % 3 else f"s{i}", None, "w", 1, "k", "z", 2, "c") for i, t in enumerate(texts)]
    out += [(None, texts[6], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    clean = [(100 + j, " ".join(f"{a}{j}{b}" for a in "abcdefg" for b in "hijklmnop"), "en", "good", 9, "w", 1, "k", "z", 2, "c") for j in range(6)]
    return out + [out[10], out[6]] + clean


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    df = spark.createDataFrame(rows(), SCHEMA)
    df.repartition(3).write.parquet(f"{full}/documents.parquet")
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    return str(full), str(empty)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, folders, name):
    full, empty = folders
    got = registry.queries()[name](spark, full).collect()
    assert len(got) == len(rows())
    one = {}
    for r in got:
        if r["doc_id"] is not None:
            assert one.setdefault(r["doc_id"], r) == r
    assert registry.queries()[name](spark, empty).count() == 0


def test_pipeline(spark, folders):
    full, empty = folders
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, full).collect()} <= set(range(100, 106))
    assert corpus_pipeline.run(spark, full).count() >= 6
    assert corpus_pipeline.run(spark, empty).count() == 0
