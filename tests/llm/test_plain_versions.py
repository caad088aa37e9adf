"""Queries against plain versions: SQL, brute force, the tokenizer library, and a pipeline written without Spark."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from wavelake.llm import ann, embed_dedup, ngram_join, packing, pii, quality, queries, records, toxicity, tokens

SF = "/root/testdata/sf0.001"


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    at = {n: i for i, n in enumerate(want.columns)}
    assert set(at) == set(got.columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r[at[n]] for n in got.columns) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_odd_texts(name):
    rng = np.random.default_rng(1)
    parts = list("abcXYZ  \n\t.,;:!?'0123é×÷İıßΣσς日🎉<|>ŉſÅ") + ["'s", "'T", "İ.", "×,", "÷!", "á.", "̧", "̇", "<|endoftext|>", "\x1c", "\x85"]
    texts = ["5 ×, 6", "İ. x", "÷?", "", None] + ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(5000)]
    ids, starts = tokens.Encoder(queries.tokenizer(name)).encode(texts)
    want = [x.ids for x in library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == want


def test_packed_documents(spark):
    """Every piece of every document, its crc32 and its place, over the whole table."""
    lib = library("word_bpe_49k.json")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {}
    for d, t in docs.items():
        own = np.asarray([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(own), 4096)):
            want[d, k] = (at, len(own[at : at + 4096]), zlib.crc32(own[at : at + 4096].tobytes()))
    got = queries.op1_best_fit_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    used: dict[int, list] = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [at for at, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 4096
    assert len(used) <= -(-sum(v[1] for v in want.values()) // 4096) + 2


def test_record_index(spark):
    lib = library("byte_bpe_50k.json")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at, want = 0, {}
    for d in sorted(docs):
        own = np.asarray([*lib.encode(docs[d], add_special_tokens=False).ids, 0], "<u4")
        want[d] = (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_records(spark, SF).collect()} == want


def test_encoded_and_decoded(spark):
    lib = library("byte_bpe_50k.json")
    for r, t in zip(queries.op2_bpe(spark, SF).orderBy("doc_id").collect(), spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = lib.encode(t.text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (t.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_shards_beyond_a_hundred_thousand(spark):
    """Starts go by the shards' numbers, not their names."""
    names = [f"part-{i:05}-x.txt" for i in (9, 10_000, 10_001, 99_999, 100_000, 100_001, 1_000_000)]
    rows = [(10 * i + k, name, k, 100 + i) for i, name in enumerate(names) for k in range(2)]
    got = records.with_starts(spark.createDataFrame(rows, "doc_id long, shard string, ordinal long, n_tokens long")).orderBy("doc_id").collect()
    assert [r.start for r in got] == np.cumsum([0, *[r[3] for r in rows[:-1]]]).tolist()


def test_a_damaged_record():
    data = bytearray(records.frame(b"payload") + b"\n" + records.frame(b"more") + b"\n")
    assert [p for _, p in records.frames(bytes(data))] == [b"payload", b"more"]
    for at in (2, 14, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))


WANTED = [
    ("You can mail me: joe [at] site [dot] com if it breaks", "joe [at] site [dot] com"), ("ask for Ann, 312 555 0142, after six", "312 555 0142"), ("call (415) 555-2671 before noon", "(415) 555-2671"),
    ("her address is maria.lopez (at) uni-koeln.de", "maria.lopez (at) uni-koeln.de"), ("reach us: support at example dot org", "support at example dot org"), ("The server 10 . 0 . 0 . 17 was scanned", "10 . 0 . 0 . 17"),
    ("blocked host 192[.]168[.]4[.]20 again", "192[.]168[.]4[.]20"), ("paid with visa 4111.1111.1111.1111 in May", "4111.1111.1111.1111"), ("card on file: 5500_0000_0000_0004", "5500_0000_0000_0004"), ("my number 212-555-0187 is new", "212-555-0187"),
    ("text me 646.555.0199", "646.555.0199"), ("login from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 failed", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), ("write to bob_smith[at]mail[dot]net", "bob_smith[at]mail[dot]net"), ("ring 00 44 20 7946 0958 please", "00 44 20 7946 0958"),
    ("John Doe 303-555-0111 Denver", "303-555-0111"), ("contact: k.meier {at} post {dot} de", "k.meier {at} post {dot} de"), ("fax 0049 30 1234567 or write", "0049 30 1234567"), ("the IP 8[.]8[.]8[.]8 answered", "8[.]8[.]8[.]8"),
]
UNWANTED = [
    "meet (at) noon. Bring lunch", "we are at work dot dot dot", "version 1 . 2 . 300 . 4 of the tool", "it ran for 12:34:56 in total", "ratio 1:2:3 of sand", "order 012 345 6789 shipped", "serial 4111.1111.1111.1112 printed",
    "ISBN 978-0-306-40615-7", "MAC 00:1a:2b:3c:4d:5e on the port", "score 3:2:1 at half time", "section 4 . 7 . 999 . 1", "dates 2019-2020 and 1999/2000", "part 123 045 6789 fits", "pages 100-200-3000", "std::vector::size and a::b", "total 1000 2000 3000 items",
]


def test_spans_that_the_trees_add(spark):
    """Lines written by hand, not from the generator's forms: at least 0.9 of the wanted spans, at most one unwanted."""
    lines = [t for t, _ in WANTED] + UNWANTED
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    hit = sum(f":{t.index(w)}:{t.index(w) + len(w)}" in got[i].spans for i, (t, w) in enumerate(WANTED))
    wrong = [t for i, t in enumerate(lines) if i >= len(WANTED) and got[i].spans]
    assert hit >= 0.9 * len(WANTED) and len(wrong) <= 1, (hit, wrong)
    assert all(got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == 0 for i in range(len(WANTED)))


def shingles(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    own = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def test_shingle_counts(spark):
    texts = [None, "", " \t\r\n", "One", "one TWO three", "a b c d e", "a b a b a b a b", "É é É é", "x\x0by\x0cz w", "a\x1cb c d e"]
    got = {r.doc_id: r.n_shingles for r in ngram_join.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: len(shingles(t, 4)) for i, t in enumerate(texts)}


def test_class_names_that_meet(spark, monkeypatch):
    """Sets that share a name by chance get others."""
    real = ngram_join.class_of
    monkeypatch.setattr(ngram_join, "class_of", lambda h, salt=0: 7 if salt == 0 else real(h, salt))
    d, salt = ngram_join.named_classes(spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j"), (3, "a b c d e")], "doc_id long, text string"), 4, ("doc_id",))
    got = {r.doc_id: r.cls for r in d.collect()}
    assert salt == 1 and got[1] == got[3] != got[2]


def plain_links(x, threshold):
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(x)).min(1, initial=len(x)))
        if (new == root).all():
            return near.sum(1), root
        root = new


@pytest.mark.parametrize("size", [16, 384])
def test_every_vector(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(400, size))
    x[100:160] = x[0] + 0.05 * rng.normal(size=(60, size))
    x[160:200] = 3 * x[1:41] + 0.6 * rng.normal(size=(40, size))
    x[200] = x[5]
    x[201] = 1e200 * x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (600, None), (601, [0.0] * size), (602, [float("nan")] * size), (603, [None] * size), (604, []), (None, [1.0] * size)]
    got = embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as n_links", "1 as id")).collect()
    assert len(got) == len(rows)
    links, root = plain_links(x, 0.9)
    by = {r.vec_id: r for r in got}
    wrong = [i for i in range(400) if (by[i].n_links, by[i].component_id, by[i].kept) != (links[i], root[i], root[i] == i)]
    assert len(wrong) <= 2, wrong  # 0.995 of pairs at the very threshold
    assert all((by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True) for i in range(600, 605))
    assert embed_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(0)
    for n in (10_000, 10_000_000):
        for size in (64, 768):
            x, y = rng.normal(size=(2, 400, size))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            y -= (x * y).sum(1, keepdims=True) * x
            y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
            own = embed_dedup.plan(n, size, 0.9)
            k = embed_dedup.keys_of(np.vstack([x, y]), *own)
            a, b = k[:400], k[400:]
            assert ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1).mean() >= 0.975, (n, size, own)


@pytest.mark.parametrize(("size", "shift"), [(64, 0.0), (64, 1e7), (768, 0.0)])
def test_nearest(spark, size, shift):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, size)) + 4 * rng.normal(size=(30, size))[rng.integers(0, 30, 900)] + shift
    x[101] = x[102] = x[100]  # ties go to the smaller id
    got: dict[int, list] = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 100))
    hits = 0
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        own = sorted(own)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(s == d[i] for _, i, s in own) and [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(best))
    assert hits >= 0.9 * 90 and [i for _, i, _ in sorted(got[100])][:2] == [101, 102]


def auc(scores, y):
    good, bad = scores[y == 1], scores[y == 0]
    return np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])


@pytest.mark.parametrize(("module", "label", "cut", "least"), [(quality, "quality", 0.3, 0.95), (toxicity, "toxic", 0.5, 0.9)])
def test_held_out(spark, module, label, cut, least):
    """On labels that the fit hasn't seen, at sf0.1."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = module.classify(docs, labels, cut).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 500 and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and r.predicted == (r.score >= cut) for r in got)
    assert auc(np.array([r.score for r in got]), np.array([r[label] for r in got])) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_tables_without_a_match(spark, module):
    label = "quality" if module is quality else "toxic"
    docs = spark.createDataFrame([(1, "some text"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900, 960)] + [(None, 1), (901, None)], f"doc_id long, {label} int")
    for d, t, n in ((docs, labels, 3), (docs.limit(0), labels, 0), (docs, labels.limit(0), 3), (docs.limit(0), labels.limit(0), 0)):
        got = module.classify(d, t).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)


def test_near_duplicates_row_by_row(spark):
    import corpus_pipeline

    x = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, x), (1, x), (2, "unique text of seven words stays here now"), (2, x), (None, x), (None, "quite another text with no partner at all"), (None, "quite another text with no partner at all"), (3, None), (3, None), (4, ""), (0, x + " u")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(0, x + " u"), (2, rows[2][1]), (None, rows[5][1]), (3, None), (3, None), (4, "")], key=repr)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """Decisions by score, groups by brute force, texts by their spans, and token totals, stage by stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", None), (10_002, "", "en", "s", 0), (10_003, "x " * 30_000, "en", "s", 60_000)], docs.schema)
    sf = str(tmp_path)
    docs.unionByName(odd).unionByName(docs.limit(3)).coalesce(2).write.parquet(f"{sf}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{sf}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    text = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    good = {r.doc_id for r in quality.classify(docs, labels, 0.3).where("score >= 0.3").collect()}
    one = corpus_pipeline.quality_stage(spark, docs, sf)
    assert text(one) == sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good), key=repr)
    one.write.parquet(f"{sf}/one")
    one = spark.read.parquet(f"{sf}/one")
    nice = {r.doc_id for r in toxicity.classify(one, labels, 0.5).where("score < 0.5").collect()}
    two = corpus_pipeline.toxicity_stage(spark, one, sf)
    assert text(two) == sorted(((r.doc_id, r.text) for r in one.collect() if r.doc_id in nice), key=repr)
    two.write.parquet(f"{sf}/two")
    two = spark.read.parquet(f"{sf}/two")

    own = sorted(two.collect(), key=lambda r: (r.doc_id, r.text or ""))
    sets = [shingles(r.text, 5) for r in own]
    group = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    three = corpus_pipeline.near_duplicate_stage(spark, two, sf)
    assert text(three) == sorted(((r.doc_id, r.text) for i, r in enumerate(own) if group[i] == i), key=repr)
    three.write.parquet(f"{sf}/three")
    three = spark.read.parquet(f"{sf}/three")

    found = {(r.doc_id): (r.text, r.spans) for r in pii.spans(three).collect()}
    four = corpus_pipeline.pii_stage(spark, three, sf)
    for r in four.collect():
        t, spans = found[r.doc_id]
        out, at = "", 0
        for s in spans:
            if s.s >= at:
                out += t[at : s.s] + f"[{pii.KINDS[s.k].upper()}]"
            at = max(at, s.e)
        assert r.text == out + t[at:] and r.n_chars == len(r.text)
    four.write.parquet(f"{sf}/four")
    four = spark.read.parquet(f"{sf}/four")
    lib = library("word_bpe_49k.json")
    sizes = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in four.collect()}
    packed = corpus_pipeline.packing_stage(spark, four, sf).collect()
    totals: dict[int, int] = {}
    for r in packed:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert totals == sizes
    ran = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in ran) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    assert packing.LIMIT >= max(r.offset + r.length for r in packed)


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
