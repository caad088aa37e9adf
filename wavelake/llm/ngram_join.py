"""Similarity join of documents by the Jaccard similarity of their word shingles, by T-occurrence search.

A document's set is its distinct shingles of `words` words, lower-cased in A-Z, hashed to 64 bits. Two sets of n and m
shingles are linked if percent * union <= 100 * intersection, so they must share T(n, m) shingles. Sets that are
equal have one class; a class stands for all its copies from the first step on.

1. Every class's postings go, packed by hash range, to tasks that sort them and count the classes of each shingle. A
   shingle of one class only can't be shared; the others return to their classes. A class of n shingles with fewer
   than T(n) = ceil(percent * n / 100) shared ones has no partner and is done. This is one pass of packed arrays,
   in which no group is larger than its hash range; from some millions of rows on, ranges are also dealt over salts of
   the classes, whose counts of each shingle are summed and told to those salts that have it, so that a shingle which
   a third of all rows have is in no task as a whole.
2. The classes left order their shared shingles from rare to common. As in DivideSkip, the T - 1 most common lists are
   long: they are never merged, only probed. Any partner occurs in one of the other, short lists, whose postings are
   merged into lists by a shuffle on the shingle.
3. Each short list first pairs its members with one pivot. Those pairs are verified, and linked classes get a common
   label; lists that still hold different labels do so again with a pivot of another label. What then still differs is
   paired across labels. A list of one large group of
   near copies thus costs one pair for each member, while no pair that could join two groups goes untested. Long lists
   are dealt over slots, to each of which the pivot goes.
4. A query class and a block of its candidates are verified together: the short lists, cut down to these candidates, are
   heap-merged into counts, those below T less the number of long lists are dropped, and the long lists are
   probed by binary search. The cut-down lists come from the candidates' own sets, as a pivot meets them in some of its
   lists only.
5. Links become components by star contraction, on executors.

Nulls: a null or empty text, or one of white space, has no set, links with nothing and is its own component; a null
doc_id is a row of its own that names no component. Repeated rows are copies. Fewer words than a shingle has make one
shingle of all words. Long texts are whole, empty tables give no rows, further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wavelake.llm.common import connected_components, cross_pairs, scratch, small_batches, store, trimmed

WORDS, PERCENT = 4, 85
#: Characters of text to a range of shingle hashes, about.
RANGE_CHARS = 8_000_000
#: Rows from which on a range of hashes is dealt over salts of classes, one for each so many, as one shingle may be in a third of them.
SALT_ROWS = 16_000_000
#: Candidates of one query class that are verified together.
CANDIDATES = 512
#: Members of a list that stand together: longer lists are dealt over slots, so that no task gets one whole.
SLOT = 256
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes."""
    from xxhash import xxh3_64_intdigest

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(xxh3_64_intdigest, own)), np.uint64)
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h * MIX + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def class_of(h: np.ndarray, salt: int = 0) -> int:
    """A signed 64-bit name of a set; other salts give other names."""
    with np.errstate(over="ignore"):
        h = h ^ mix(np.array([salt], np.uint64)) if salt else h
        parts = np.array([mix(h).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(h + MIX)), np.uint64(len(h))], np.uint64)
        return int(mix(mix(parts[:1] * MIX + parts[1:2]) + parts[2:3] * MIX).view(np.int64)[0])


def least(n, percent: int):
    """Shingles that a set of n must share with any partner."""
    return (percent * n + 99) // 100


def needed(n, m, percent: int):
    """Shingles that sets of n and m must share to be linked: the least i with 100 i >= percent (n + m - i)."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text"))


def classes(docs: DataFrame, words: int = WORDS, keys: tuple[str, ...] = ("doc_id",), salt: int = 0) -> DataFrame:
    """(keys, n, cls, twin) of every document; no class where the set is empty. `twin` is a second name, to tell sets apart that share the first by chance."""
    d = docs.select(*keys, F.col("text").cast("string").alias("text"))
    schema = StructType([*d.schema.fields[:-1], *[StructField(c, LongType()) for c in ("n", "cls", "twin")]])
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = [shingles(t, words) for t in b.column(len(keys)).to_pylist()]
            named = [pa.array([class_of(h, x) if len(h) else None for h in sets], pa.int64()) for x in (salt, salt + (1 << 32))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array([len(h) for h in sets], pa.int64()), *named], names=schema.names)

    return d.mapInArrow(trimmed(run), schema)


def named_classes(docs: DataFrame, words: int, keys: tuple[str, ...]) -> tuple[DataFrame, int]:
    """classes(), stored, with a salt under which no two different sets share a name: names of 64 bits meet by chance among some billions of sets."""
    salt = 0
    while True:
        d = store(classes(docs, words, keys, salt), "classes")
        if d.where("cls is not null").groupBy("cls").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a <> b").isEmpty():
            return d.drop("twin"), salt
        salt += 1


def _packed(bits: int, keys: np.ndarray, parts: dict[str, np.ndarray], cls: np.ndarray, size: np.ndarray):
    """One row for each value of the key: entries of one class stand together, as class, its set's size and their number, and the parts hold what belongs to each entry."""
    order = np.argsort(keys.astype(np.uint32), kind="stable")
    keys, cls, size = keys[order], cls[order], size[order]
    parts = {k: v[order] for k, v in parts.items()}
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    out = {k: [] for k in ("key", "cls", "size", "count", *parts)}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        heads = np.flatnonzero(np.r_[True, cls[a + 1 : b] != cls[a : b - 1]]) + a
        out["key"].append(int(keys[a]))
        out["cls"].append(cls[heads].tobytes())
        out["size"].append(size[heads].astype(np.uint32).tobytes())
        out["count"].append(np.diff(np.r_[heads, b]).astype(np.uint32).tobytes())
        for k, v in parts.items():
            out[k].append(v[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), *[pa.array(v, pa.binary()) for k, v in out.items() if k != "key"]], names=list(out))


NOTHING = pa.py_buffer(b"")


def _groups(batches):
    """(key, columns) for rows that come sorted by their first column: a key's rows, from whatever batches."""
    key, held = None, []
    for b in batches:
        names = b.column(0).to_pylist()
        for i, k in enumerate(names):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append([c[i].as_buffer() or NOTHING for c in b.columns[1:]])
    if held:
        yield key, held


def _joined(held, at: int, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[at], kind) for r in held])


def shared(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, salt: int = 0, salts: int = 1) -> DataFrame:
    """(cls, n, k, hs): classes that may have a partner, their shared shingles from rare to common, and how many of these lists are short."""
    texts = _texts(docs)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(6, min(20, (int(chars) // RANGE_CHARS).bit_length()))

    def post(batches):
        for b in batches:
            own: dict[int, np.ndarray] = {}
            for t in b.column(0).to_pylist():
                h = shingles(t, words)
                if len(h):
                    own.setdefault(class_of(h, salt), h)
            sizes = np.array([len(h) for h in own.values()], np.int64)
            if len(own):
                h, cls = np.concatenate(list(own.values())), np.repeat(np.array(list(own), np.int64), sizes)
                keys = (h >> np.uint64(64 - bits)) * np.uint64(salts) + cls.view(np.uint64) % np.uint64(salts)
                yield _packed(bits, keys, {"h": h}, cls, np.repeat(sizes, sizes))

    def met(held):
        """(h, cls, size) of a group's postings, each class of a shingle once, by shingle and class."""
        times = _joined(held, 2, np.uint32)
        cls, size = np.repeat(_joined(held, 0, np.int64), times), np.repeat(_joined(held, 1, np.uint32), times)
        h = _joined(held, 3, np.uint64)
        order = np.lexsort((cls, h))
        h, cls, size = h[order], cls[order], size[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])] if len(h) else np.zeros(0, bool)
        return h[fresh], cls[fresh], size[fresh]

    def rarity(df: np.ndarray) -> np.ndarray:
        return np.minimum(255, (8 * np.log2(np.maximum(df, 1))).astype(np.int64)).astype(np.uint8)

    def partial(batches):
        """Each salted group's shingles with how many classes they have there."""
        for key, held in _groups(batches):
            h, _, _ = met(held)
            heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([key // salts], pa.int64()), *[pa.array([x], pa.binary()) for x in (int(key).to_bytes(8, "little"), h[heads].tobytes(), np.diff(np.r_[heads, len(h)]).astype(np.uint32).tobytes())]], names=["range", "key", "h", "count"])

    def summed(batches):
        """For each salted group of a range, its shingles that several classes of the range have, with their rarity."""
        for _, held in _groups(batches):
            keys = np.concatenate([np.full(len(r[1]) // 8, int.from_bytes(r[0].to_pybytes(), "little"), np.int64) for r in held])
            h, n = _joined(held, 1, np.uint64), _joined(held, 2, np.uint32).astype(np.int64)
            names, at = np.unique(h, return_inverse=True)
            total = np.bincount(at, n, len(names)).astype(np.int64)[at]
            keep = total > 1
            h, keys, rare = h[keep], keys[keep], rarity(total[keep])
            for key in np.unique(keys).tolist():
                own = keys == key
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (h[own], rare[own])]], names=["key", "h", "rare"])

    def told(batches):
        """Postings of salted groups whose shingles are shared, to their classes; what is shared comes first in each group."""
        for _, held in _groups(batches):
            common = [r for r in held if r[0].to_pybytes() == b"\0"]
            posts = [r[1:5] for r in held if r[0].to_pybytes() == b"\1"]
            names, rares = (_joined(common, 4, np.uint64), _joined(common, 5, np.uint8)) if common else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
            if not posts or not len(names):
                continue
            h, cls, size = met(posts)
            order = np.argsort(names, kind="stable")
            names, rares = names[order], rares[order]
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            keep = names[at] == h
            h, cls, size, rare = h[keep], cls[keep], size[keep], rares[at[keep]]
            order = np.argsort(cls, kind="stable")
            if len(h):
                h, cls, size, rare = h[order], cls[order], size[order], rare[order]
                yield _packed(bits, cls.view(np.uint64) >> np.uint64(64 - bits), {"h": h, "rare": rare}, cls, size)

    def count(batches):
        for _, held in _groups(batches):
            times = _joined(held, 2, np.uint32)
            cls, size = np.repeat(_joined(held, 0, np.int64), times), np.repeat(_joined(held, 1, np.uint32), times)
            h = _joined(held, 3, np.uint64)
            order = np.argsort(h, kind="stable")
            h, cls, size = h[order], cls[order], size[order]
            same = h[1:] == h[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            h, cls, size = h[keep], cls[keep], size[keep]
            order = np.lexsort((cls, h))
            h, cls, size = h[order], cls[order], size[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])] if len(h) else np.zeros(0, bool)
            h, cls, size = h[fresh], cls[fresh], size[fresh]
            heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.r_[heads, len(h)])
            df = np.repeat(times, times)
            rare = rarity(df)
            keep = df > 1
            h, cls, size, rare = h[keep], cls[keep], size[keep], rare[keep]
            order = np.argsort(cls, kind="stable")
            if len(h):
                h, cls, size, rare = h[order], cls[order], size[order], rare[order]
                yield _packed(bits, cls.view(np.uint64) >> np.uint64(64 - bits), {"h": h, "rare": rare}, cls, size)

    def gather(batches):
        for _, held in _groups(batches):
            times = _joined(held, 2, np.uint32)
            cls, size = np.repeat(_joined(held, 0, np.int64), times), np.repeat(_joined(held, 1, np.uint32), times)
            h, rare = _joined(held, 3, np.uint64), _joined(held, 4, np.uint8)
            order = np.lexsort((h, rare, cls))
            h, cls, size = h[order], cls[order], size[order].astype(np.int64)
            heads = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
            m = np.diff(np.r_[heads, len(cls)])
            n = size[heads]
            alive = m >= least(n, percent)
            rows = [(int(cls[a]), int(s), int(c - least(s, percent) + 1), h[a : a + c].view(np.int64)) for a, s, c in zip(heads[alive], n[alive], m[alive], strict=True)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cls", "n", "k", "hs"])

    packed = "key long, cls binary, size binary, count binary, h binary"
    posted = texts.mapInArrow(trimmed(post), packed).repartition("key").sortWithinPartitions("key")
    if salts == 1:
        counted = posted.mapInArrow(trimmed(count), packed + ", rare binary")
    else:
        posted = store(posted, "postings")
        dealt = lambda df, *by: df.repartition(by[0]).sortWithinPartitions(*by)
        counts = dealt(posted, "key").mapInArrow(trimmed(partial), "range long, key binary, h binary, count binary")
        common = dealt(counts, "range").mapInArrow(trimmed(summed), "key long, h binary, rare binary")
        none = F.lit(None).cast("binary")
        both = common.select("key", F.lit(b"\0").alias("kind"), none.alias("cls"), none.alias("size"), none.alias("count"), "h", "rare").unionByName(posted.select("key", F.lit(b"\1").alias("kind"), "cls", "size", "count", "h", none.alias("rare")))
        counted = dealt(both, "key", "kind").mapInArrow(trimmed(told), packed + ", rare binary")
    counted = counted.repartition("key").sortWithinPartitions("key")
    return counted.mapInArrow(trimmed(gather), "cls long, n long, k long, hs array<long>")


def divide_skip(short: np.ndarray, long: np.ndarray, sets: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Which candidate sets (sorted) hold `wanted` of the query's shingles, given as its short and its long lists.

    The short lists' hits, as candidate numbers, are merged by a heap; a candidate needs at least `wanted` less the
    number of long lists there, and only then are the long lists probed by binary search.
    """

    def held(own: np.ndarray, probes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(own, probes), len(own) - 1)
        return own[at] == probes

    lists: list[list[int]] = [[] for _ in short]
    for c, own in enumerate(sets):
        for i in np.flatnonzero(held(own, short)):
            lists[i].append(c)
    counts = np.zeros(len(sets), np.int64)
    for c in heapq.merge(*lists):
        counts[c] += 1
    for c in np.flatnonzero(counts >= wanted - len(long)):
        counts[c] += int(held(sets[c], long).sum()) if len(long) else 0
    return counts >= wanted


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The linked ones of pairs(x, y)."""

    def run(batches):
        for b in batches:
            x = b.column(0).to_pylist()
            out = []
            at = 0
            while at < len(x):
                end = at
                while end < len(x) and x[end] == x[at] and end - at < CANDIDATES:
                    end += 1
                n, k, hs = b.column(2)[at].as_py(), b.column(3)[at].as_py(), b.column(4)[at].values.to_numpy()
                sets_ = [np.sort(b.column(6)[i].values.to_numpy()) for i in range(at, end)]
                wanted = needed(n, b.column(5).slice(at, end - at).to_numpy(), percent)
                out += (at + np.flatnonzero(divide_skip(hs[:k], hs[k:], sets_, wanted))).tolist()
                at = end
            took = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took)], names=["a", "b"])

    left = sets.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("k").alias("kx"), F.col("hs").alias("hx"))
    right = sets.select(F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("hs").alias("hy"))
    met = pairs.join(right, "y").join(left, "x").where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    return met.select("x", "y", "nx", "kx", "hx", "ny", "hy").mapInArrow(trimmed(run), "a long, b long")


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, salt: int = 0, salts: int = 1) -> DataFrame:
    """(a, b): links between classes, enough to connect all that are linked.

    A posting has `rem`, the shared shingles from its place on. Orders are the same in all classes, so at the first
    shingle that two linked classes have in common, both have at least the needed number left: pairs that don't are
    not linked, or meet in an earlier list. A list's pivot is the class with the fewest shingles of its own, as the
    origin of a group of near copies has none, and the copies are closer to it than to each other.
    """
    sets = store(shared(docs, words, percent, salt, salts), "sets")
    each = sets.select(F.col("cls").alias("id"), "n", F.size("hs").alias("m"), F.posexplode(F.slice("hs", F.lit(1), F.col("k").cast("int"))).alias("pos", "h"))
    each = each.select("h", "id", "n", (F.col("m") - F.col("pos")).alias("rem"), (F.col("n") - F.col("m")).alias("own"))
    long = each.groupBy("h").count().where(F.col("count") > SLOT).select("h", F.ceil(F.col("count") / SLOT).cast("int").alias("slots"))
    dealt = each.join(long, "h", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    lists = store(dealt.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")), "lists")
    slots = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")
    enough = lambda a, b: f"({percent} * ({a}n + {b}n) + {99 + percent}) div {100 + percent} <= least({a}rem, {b}rem)"

    def star(rows: DataFrame, pivot_of: DataFrame) -> DataFrame:
        """Pairs of each list's pivot, the first of pivot_of's rows, with the rows of other groups."""
        first = pivot_of.groupBy("h").agg(F.min_by(F.struct("id", "n", "rem", "grp"), F.struct("own", "id")).alias("p"), F.max("slots").alias("slots"))
        pivots = first.select("h", slots, F.col("p.id").alias("x"), F.col("p.n").alias("pn"), F.col("p.rem").alias("prem"), F.col("p.grp").alias("pgrp"))
        met = rows.join(pivots, ["h", "slot"]).where("grp <> pgrp").where(enough("", "p"))
        return met.select("x", F.col("id").alias("y")).distinct()

    def labelled(found: DataFrame) -> DataFrame:
        labels = connected_components(found).withColumnRenamed("id", "l")
        rows = lists.join(labels, lists["id"] == labels["l"], "left").select("h", "id", "n", "rem", "own", "slot", "slots", F.coalesce("component", "id").alias("grp"))
        mixed = rows.groupBy("h").agg(F.min_by("grp", F.struct("own", "id")).alias("lead"), F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("slots").alias("slots")).where("lo <> hi").select("h", "lead", slots)
        return store(rows.join(mixed, ["h", "slot"]), "mixed")

    alone = lists.withColumn("grp", F.col("id"))
    found = store(verified(star(alone, alone), sets, percent), "links")
    mixed = labelled(found)
    found = store(found.unionByName(verified(star(mixed, mixed.where("grp <> lead")), sets, percent)), "links")
    rest = cross_pairs(labelled(found).drop("lead"), ["h"], enough("a.", "b."))
    return found.unionByName(store(verified(rest, sets, percent), "links"))


def linked(docs: DataFrame, d: DataFrame, words: int, percent: int, salt: int) -> DataFrame:
    """(id, component) of the classes that link, stored; what was stored on the way is removed."""
    with scratch(docs.sparkSession) as keep:
        return keep(store(connected_components(links(docs, words, percent, salt, min(4096, -(-d.count() // SALT_ROWS) or 1))), "components"))


def members(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, n, cls, component) of every row: rows of one component are linked directly or over others. Without a set both are null."""
    d, salt = named_classes(docs, words, keys)
    comps = linked(docs, d, words, percent, salt)
    found = comps.select(F.col("id").alias("_c"), F.col("component").alias("_m"))
    return d.join(found, d["cls"] == found["_c"], "left").select(*keys, "n", "cls", F.coalesce("_m", "cls").alias("component"))


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    d, salt = named_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words, ("doc_id",))
    firsts = d.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    comps = linked(docs, d, words, percent, salt)
    joined = firsts.join(comps, firsts["cls"] == comps["id"], "left").where("copies > 1 or component is not null")
    named = store(joined.select("cls", "first", F.coalesce("component", "cls").alias("component")), "named")
    roots = named.groupBy("component").agg(F.min("first").alias("root"))
    of = named.join(roots, "component").select(F.col("cls").alias("c"), "root")
    out = d.join(of, d["cls"] == of["c"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("root")), "doc_id").alias("component_id"))


def distinct_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, of which one of each group of near copies stays: that of the smallest doc_id, a null id last, then the first in its file.

    Rows are told apart by their place in their files, so repeated rows and ids, and null ids, are decided one by
    one; docs that aren't read from files are stored first. Rows without words all stay.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    try:
        placed = docs.select("*", *place)
        placed.schema  # noqa: B018 - analysed here
    except AnalysisException:
        docs = store(docs, "rows")
        placed = docs.select("*", *place)
    m = store(members(placed.select(F.col("doc_id").cast("long").alias("_id"), "_file", "_at", "text"), words, percent, ("_id", "_file", "_at")).where("component is not null"), "members")
    rank = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_file"), F.col("_at"))
    first = m.groupBy(F.col("component").alias("_g")).agg(F.min(rank).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    gone = m.join(first, m["component"] == first["_g"]).where(~rank.eqNullSafe(F.col("_first"))).select("_file", "_at")
    return placed.join(gone, ["_file", "_at"], "left_anti").select(*docs.columns)
