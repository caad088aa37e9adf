"""Toxicity by compression distance: two zstandard dictionaries, trained on ordinary and on toxic text.

A window is compressed with each dictionary, and its margin is the ordinary length less the toxic one. Both are trained
by zstandard's own trainer on passages of several words: the ordinary one on the passages of all sampled ordinary
documents, taken by hash so that neither an id, a long text nor a source goes first; the toxic one on the passages of
labelled toxic documents around words that far more of these than of ordinary ones use (by default 20 times the
odds; near copies count once), as most of a toxic document is ordinary text. The toxic dictionary ends with both: what
is ordinary in a window then costs the same on both sides, and the margin is what toxic passages have in common with it.
Scored windows are single words between two guard strings that both dictionaries hold: zstandard looks for no match
in the last bytes of its input and stores short inputs as they are, which would hide a short window's margin. Wider
windows were measured too (README): their margins drown in those of their other words.

A document's score is a logistic function of its largest margin and of how many windows reach each of several
margins, fitted on the same labelled documents.

The fit uses a bounded sample of labelled rows (`limit` for each class, lowest hashes first, and SAMPLE_BYTES of texts). Where the bound changes
the share of toxic rows, the intercept is shifted by the log odds over all training labels less those of the sample,
so a score is a probability at the share of toxic rows among the labels, whatever the table's size; a threshold on
it means the same at each size. Every document is scored over its whole text, on its executor, with a bounded memo of windows and without a shuffle.

Nulls: a null text is empty; a text without words scores by the base rate of margin 0. Null labels and labels of
unknown ids are no training rows. Without both classes the score is 0. Repeated rows and ties score alike, long
texts are whole, empty tables give no rows, further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wavelake.llm.common import held_out, small_batches, training_ids, trimmed
from wavelake.llm.trees import sigmoid

#: Labelled documents of each class that the fit sees at most.
LIMIT = 3_000
#: Bytes of their texts that the driver takes at most; texts that don't fit any more are left out of the fit.
SAMPLE_BYTES = 64 << 20
#: Bytes of the two dictionaries at most, and odds from which the passages around a word are toxic text.
ORDINARY_BYTES, TOXIC_BYTES, ODDS = 65_536, 2_048, 20
#: Passages of the bounded sample that the ordinary dictionary is trained on at most, lowest hashes first; words to a passage.
PASSAGES, SPAN = 300_000, 3
#: The trainer's segment and sample lengths.
SEGMENT, SAMPLE = 16, 6
HEAD, TAIL = b"\x02start-of-window\x03", b" \x04the-window-ends\x05"
MARGINS = (3, 4, 5, 6, 7)
MEMO = 200_000


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def family(own: set[str]) -> int:
    """Near copies mostly share their longer words' smallest hash; a word counts once for each family of texts, so that copies don't vote."""
    return min((zlib.crc32(w.encode("utf-8", "replace")) for w in own if len(w) > 5), default=0)


def margins(toxic: bytes, ordinary: bytes):
    """A function from windows to their margins."""
    import zstandard as z

    params = z.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=17, search_log=6, min_match=4, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)

    def compressor(data: bytes):
        d = z.ZstdCompressionDict(data + TAIL + HEAD)  # a trained dictionary goes on with its content, untrained text is content alone
        d.precompute_compress(compression_params=params)
        return z.ZstdCompressor(compression_params=params, dict_data=d).compress

    a, b = compressor(toxic), compressor(ordinary)

    def of(windows: list[str]) -> list[int]:
        framed = [HEAD + b" " + w.encode("utf-8", "replace") + TAIL for w in windows]
        return [len(b(x)) - len(a(x)) for x in framed]

    return of


def features(found: np.ndarray) -> list[float]:
    """Of one document's margins."""
    top = float(found.max()) if len(found) else 0.0
    return [top, *[math.log1p(int((found >= m).sum())) for m in MARGINS], *[float((found >= m).mean()) if len(found) else 0.0 for m in MARGINS[1:4]]]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * np.r_[w[:-1], 0])
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, most_bytes: int) -> tuple[list, float]:
    """(text, label) of at most `limit` training rows of each class and at most `most_bytes` of texts, and the shift of training_ids().

    Ids come to the driver first, as many as the limit, then the lengths of their texts, and last the whole texts of
    those that fit, by the hashes of their ids.
    """
    spark = docs.sparkSession
    ids, shift = training_ids(labels, label, limit)
    if not ids:
        return [], 0.0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = spark.createDataFrame(ids, "doc_id long, y int")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.sum(size).alias("n")).collect()
    fits, total = [], 0
    known, order = {r[0]: r[1] for r in sizes}, lambda x: (zlib.crc32(str(x[0]).encode()), x)
    for one in sorted(ids, key=order):
        if one[0] in known and total + known[one[0]] <= most_bytes:
            total += known[one[0]]
            fits.append(one)
    if not fits:
        return [], 0.0
    return texts.join(F.broadcast(spark.createDataFrame(fits, "doc_id long, y int")), "doc_id").orderBy("doc_id").select("text", "y").collect(), shift


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT, ordinary_bytes: int = ORDINARY_BYTES) -> dict | None:
    """toxic and ordinary dictionary contents and the weights; None without both classes."""
    rows, shift = sample(docs, labels, "toxic", limit, SAMPLE_BYTES)
    return learn(rows, ordinary_bytes, shift)


def trained(passages: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains on the passages; the passages themselves, up to its size, where they are too few for training."""
    import zstandard as z

    try:
        return z.train_dictionary(size, passages, k=SEGMENT, d=SAMPLE).as_bytes()
    except (z.ZstdError, ValueError):
        return b"".join(p + b" " for p in dict.fromkeys(passages) if len(p) < size)[-size:]


def passages(texts: Iterable[list[str]], around: set[str] | None = None) -> list[bytes]:
    """Runs of SPAN words of texts: those that make up a text, or, given words, those in whose middle one of them stands."""
    half, out = SPAN // 2, []
    for own in texts:
        places = range(half, len(own) + half, SPAN) if around is None else (i for i, w in enumerate(own) if w in around)
        out += [(" " + " ".join(own[max(0, i - half) : i + half + 1])).encode("utf-8", "replace") for i in places]
    return out


def learn(rows: list, ordinary_bytes: int = ORDINARY_BYTES, shift: float = 0.0, toxic_bytes: int = TOXIC_BYTES) -> dict | None:
    """fit() from (text, label) rows; `shift` is added to the log odds."""
    y = np.array([r[1] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    # words are cut anew in each pass, as those of all texts together would fill the driver; texts go in the order of
    # their families, so that the last family that used a word tells whether it counts again
    marked = sorted((family(set(words(t))), i) for i, (t, _) in enumerate(rows))
    counts: tuple[dict, dict] = ({}, {})
    n = [0, 0]
    wanted: set[str] = set()
    for k in (1, 0):
        last, before = {}, None
        for one, i in marked:
            if rows[i][1] != k:
                continue
            n[k] += one != before
            before = one
            for w in set(words(rows[i][0])):
                if last.get(w) != one and (k or w in wanted):
                    last[w] = one
                    counts[k][w] = counts[k].get(w, 0) + 1
        if k == 1:
            wanted = {w for w, c in counts[1].items() if c >= max(3, round(0.004 * n[1]))}
    n0, n1 = n
    telling = {w for w in wanted if (counts[1][w] + 0.5) / (n1 + 1) >= ODDS * (counts[0].get(w, 0) + 0.5) / (n0 + 1)}
    del counts, last
    plain = passages(words(t) for t, k in rows if not k)
    if len(plain) > PASSAGES:
        plain = sorted(plain, key=zlib.crc32)[:PASSAGES]
    ordinary = trained(plain, ordinary_bytes)
    toxic = trained(passages((words(t) for t, k in rows if k), telling or None), toxic_bytes)
    del plain
    model = {"toxic": ordinary + toxic, "ordinary": ordinary}
    of, memo = margins(model["toxic"], model["ordinary"]), {}
    x = []
    for t, _ in rows:
        own = list(dict.fromkeys(words(t)))
        new = [w for w in own if w not in memo]
        found = dict(zip(new, of(new), strict=True))
        x.append(features(np.array([found[w] if w in found else memo[w] for w in own])))
        if len(memo) + len(found) > MEMO:
            memo.clear()
        memo.update(found)
    x = np.array(x)
    model["scale"] = x.std(axis=0) + 1e-6
    model["weights"] = logistic(x / model["scale"], y)
    model["weights"][-1] += shift
    return model


def score(docs: DataFrame, model: dict | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text and `extra`) with `score`; without a shuffle."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    if model is None:
        return d.withColumn("score", F.lit(0.0))

    def run(batches):
        import pyarrow.compute as pc

        of, memo, scale, weights = margins(model["toxic"], model["ordinary"]), {}, model["scale"], model["weights"]
        for b in batches:
            # lower case as in the fit, then the distinct words of the whole batch, so that each is compressed once
            lists = [list(dict.fromkeys(words(t))) for t in b.column(1).to_pylist()]
            coded = pc.dictionary_encode(pa.array([w for x in lists for w in x], pa.large_string()))
            names = coded.dictionary.to_pylist()
            new = [w for w in names if w not in memo]
            fresh = dict(zip(new, of(new), strict=True))
            values = np.array([fresh[w] if w in fresh else memo[w] for w in names], np.int64)
            if len(memo) + len(fresh) > MEMO:
                memo.clear()
            memo.update(fresh)
            all_margins = values[coded.indices.to_numpy()] if len(values) else values
            ends = np.cumsum([0, *map(len, lists)])
            x = np.array([features(all_margins[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]).reshape(len(lists), -1)
            z = x / scale @ weights[:-1] + weights[-1] if len(lists) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(z), pa.float64())], names=[*b.schema.names, "score"])

    return d.mapInArrow(trimmed(run), StructType([*d.schema, StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = LIMIT, ordinary_bytes: int = ORDINARY_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    s = score(docs, fit(docs, labels, limit, ordinary_bytes)).select("doc_id", "score")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
