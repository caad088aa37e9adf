"""Every operator on empty tables, on rows with nulls in any column, ties and repeats, and with further columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from wavelake.llm import ann, bpe, embed_dedup, ngram_join, packing, pii, quality, queries, records, toxicity, warc

CLASHING = "n cls ids score start length spans base _t _w _l _b _c _any value size component_id doc held_out predicted piece offset key last digest id core x y cell grp home tab label kind".split()
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "long " * 40_000)]
LABELS = [(i, i % 2) for i in range(1, 8)] + [(None, 1), (4, None), (99, 0)]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(TEXTS, "doc_id long, text string"))


def document_operators(labels):
    word, byte = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
    return {
        "packing": lambda d: packing.best_fit(d, word, 1).where("piece = 0"),
        "bpe": lambda d: bpe.encode_decode(d, byte),
        "pii": pii.detect,
        "redact": pii.redact,
        "ngram": ngram_join.components,
        "records": lambda d: records.write_and_index(d, byte, 0, 50257)[1],
        "quality": lambda d: quality.classify(d, clashing(labels)),
        "toxicity": lambda d: toxicity.classify(d, clashing(labels)),
    }


@pytest.mark.parametrize("name", ["packing", "bpe", "pii", "redact", "ngram", "records", "quality", "toxicity"])
def test_documents(spark, docs, name):
    """One row for each document, whatever it holds, and the same for equal rows; none for an empty table."""
    run = document_operators(spark.createDataFrame(LABELS, "doc_id long, quality int").withColumn("toxic", F.col("quality")))[name]
    got = run(docs).collect()
    assert len(got) == len(TEXTS) and sorted(r.doc_id is None for r in got) == [False] * 8 + [True] * 2
    five = [tuple(v for k, v in r.asDict().items() if k not in ("sequence_id", "offset", "shard", "start", "ordinal")) for r in got if r.doc_id == 5]
    assert five[0] == five[1]
    assert run(docs.limit(0)).collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 2.0]), (7, [1.0]), (8, []), (100, [1.0, 2.1]), (200, [-5.0, 1.0])]
    v = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = embed_dedup.dedup(v).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[100] == (2, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 200)) and by[None] == (0, None, True)
    near = ann.search(v).collect()
    assert {r.query_id for r in near} == {100, 200} and [r.vec_id for r in sorted(near, key=lambda r: (r.query_id, r["rank"]))[:3]] == [1, 1, 2]
    assert all(len({r["rank"] for r in near if r.query_id == q}) == 4 for q in (100, 200))
    for run in (embed_dedup.dedup, ann.search):
        assert run(v.limit(0)).collect() == [] and run(v.where("vec_id = 3")).count() == (1 if run is embed_dedup.dedup else 0)


def test_pages(spark):
    rows = [(1, "http://a.org/x", "same"), (2, None, "same"), (2, None, "same"), (None, "http://a.org/x", "same"), (3, "", None), (4, "http://b.org\r\nX: y", ""), (5, "http://c.org", "é" * 100_000)]
    p = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    _, index = warc.archive_and_index(p)
    got = index.collect()
    assert len(got) == len(rows) and sorted(r.refers_to or 0 for r in got) == [0, 0, 0, 0, 2, 2, 4]
    assert {r.page_id: r.payload_bytes for r in got}[5] == 200_000
    _, index = warc.archive_and_index(p.limit(0))
    assert index.collect() == []
