"""Each operator against brute force, a library or a round trip, on small tables with awkward rows."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

from wavelake.llm import ann, bpe, ngram_join, packing, pii, quality, queries, records, toxicity, warc

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "a b c d e f g h i j"), (6, "a b c d e f g h i j"), (7, "A b c d e f g h i j"),
    (8, "a  b\n\n c \nd"), (9, "x<|endoftext|> y"), (10, "é ́x İ ΣΑΣ 日本語 🎉\x1c z\x01q"), (11, "word " * 9000), (12, "9" * 3000 + "@a.b"),
    (13, "mail a@b.c@d.e or 1.2.3.4.5.6.7.8 or +1 (255) 555-8013, 4111 1111 1111 1111"), (None, "a b c d e f g h i j"), (5, "a b c d e f g h i j"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Texts with nulls, ties, repeats and a clashing further column."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("ids", F.lit(None).cast("string"))


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_packing(spark, odd):
    got = packing.best_fit(odd, queries.tokenizer("word_bpe_49k.json"), 1, keep_ids=True).collect()
    lib = library("word_bpe_49k.json")
    want = sorted(([*lib.encode(t or "", add_special_tokens=False).ids, 1] for _, t in ODD), key=str)
    parts = {}
    for r in got:
        assert r.length <= 4096 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in parts.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    long = [r for r in got if r.doc_id == 11]
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(long, key=lambda r: r.piece)]).tolist()
    assert ids in want and sum(r.length for r in got) == sum(map(len, want))


def test_packing_is_tight():
    sizes = -np.sort(-np.random.default_rng(0).integers(1, 2000, 5000))
    bins, _ = packing.place(sizes, 4096)
    assert bins.max() + 1 <= -(-sizes.sum() // 4096) + 2


def test_bpe(spark, odd):
    lib = library("byte_bpe_50k.json")
    for r in bpe.encode_decode(odd, queries.tokenizer("byte_bpe_50k.json"), keep=True).collect():
        ids = lib.encode(next(t for d, t in ODD if d == r.doc_id) or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_pii(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id + 1000: r.text for r in docs.collect()} | {d: t for d, t in ODD}
    both = odd.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text"))
    for r in pii.detect(both).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest()
    marked = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert marked[13] == "mail [EMAIL]@d.e or [IP].[IP] or [PHONE], [CARD]"


def brute_components(sets, percent):
    keys = [k for k, s in sets if s]
    up = {k: k for k, _ in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    by = dict(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(by[a] & by[b])
            if 100 * n >= percent * (len(by[a]) + len(by[b]) - n):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: find(k) for k in up}


@pytest.mark.parametrize(("slot", "salt_rows"), [(256, 10**6), (7, 60)])
def test_ngram_join(spark, monkeypatch, slot, salt_rows):
    monkeypatch.setattr(ngram_join, "SLOT", slot)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", salt_rows)  # 60: ranges over five salts
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 400, 120).tolist() for _ in range(6)]
    docs = []
    for i in range(240):
        w = list(base[i % 6]) if i % 3 else rng.integers(0, 400, 100).tolist()
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(len(w)))] = int(rng.integers(400, 9000))
        docs.append((i, " ".join(f"w{x}" for x in w)))
    docs += [(300, None), (301, " "), (302, "only Three words"), (303, "only three words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for words, percent in ((4, 85), (5, 80)):
        want = brute_components([(d, set(ngram_join.shingles(t, words).tolist())) for d, t in docs], percent)
        got = {r.doc_id: r.component_id for r in ngram_join.components(df, words, percent).collect()}
        assert got == want and len(set(got.values())) < len(got)


def test_traverse_is_ordered():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    cells = list(ann.traverse(a, b, np.ones(35, int), np.inf))
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert len(set(cells)) == 35 and sums == sorted(sums)


def test_records(spark, odd):
    lib = library("byte_bpe_50k.json")
    path, idx = records.write_and_index(odd, queries.tokenizer("byte_bpe_50k.json"), 0, 50257)
    got = idx.collect()
    assert len(got) == len(ODD)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    some = idx.where("doc_id in (8, 10)")
    for r in records.read(spark, path, some).collect():
        assert r.ids == [*lib.encode(next(t for d, t in ODD if d == r.doc_id), add_special_tokens=False).ids, 0]


def test_warc(spark):
    pages = [(1, "http://b.com/x", "<p>é"), (2, "http://a.b.com/", "<p>é"), (3, None, None), (4, "http://a.b.com/", ""), (5, "http://z.org", "other"), (None, "http://z.org", "solo")]
    _, idx = warc.archive_and_index(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = idx.collect()
    got = {r.page_id: r for r in rows}
    assert [r.url_key for r in rows] == sorted(r.url_key for r in rows)
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 2, 5)
    assert got[2].record_type == "response" and got[3].refers_to == 4 and got[4].payload_bytes == 0
    for r in rows:
        body = next(h for p, _, h in pages if p == r.page_id) or ""
        assert (r.payload_digest, r.payload_bytes) == (base64.b32encode(hashlib.sha1(body.encode()).digest()).decode(), len(body.encode()))
    assert [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in rows] == sorted((r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in rows)
    _, none = warc.archive_and_index(spark.createDataFrame(pages, "page_id long, url string, html string").limit(0))
    assert none.count() == 0


def test_loser_tree():
    rng = np.random.default_rng(0)
    runs = [sorted(rng.integers(0, 99, rng.integers(0, 9)).tolist()) for _ in range(7)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


@pytest.mark.parametrize(("module", "label", "cut"), [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers(spark, odd, module, label, cut):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in module.classify(docs, labels, cut).collect()}
    held = [(got[r.doc_id].score, r[label]) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.8
    rows = module.classify(odd, labels.limit(0), cut).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)


def test_dictionaries_are_trained_on_all_documents(spark):
    """One long document of the smallest id leaves room for what ordinary documents share; the toxic dictionary holds the toxic words."""
    rng = np.random.default_rng(2)
    common = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), 10)) for _ in range(30)]
    docs = [(0, " ".join(f"unique{i:06}" for i in range(12_000)))] + [(i, " ".join([*common, f"own{i}x"])) for i in range(1, 200)]
    docs += [(i, f"some vileword{i % 3} nasty{i} text") for i in range(200, 260)]
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert sum(w.encode() in model["ordinary"] for w in common) >= 15 and len(model["ordinary"]) <= toxicity.ORDINARY_BYTES
    assert b"vileword" in model["toxic"] and b"vileword" not in model["ordinary"]
    assert model["toxic"].startswith(model["ordinary"])


@pytest.mark.parametrize(("module", "label", "share"), [(quality, "quality", 0.85), (toxicity, "toxic", 0.1)])
def test_the_limit_keeps_the_prior(spark, module, label, share):
    """Where both classes reach the limit, scores still average to the share over all labels: texts don't tell the classes apart fully."""
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(2000):
        y = int(rng.random() < share)
        odd = rng.random() < (0.6 if y == (label == "toxic") else 0.2)
        docs.append((i, " ".join([f"w{x}" for x in rng.integers(0, 50, 12)] + ["vilest!!"] * 2 * odd)))
        labels.append((i, y))
    true = np.mean([y for _, y in labels])
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {label} int")
    got = np.mean([r.score for r in module.classify(d, t, limit=100).collect()])
    assert abs(got - true) < 0.08
