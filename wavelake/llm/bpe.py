"""Byte-pair encoding by speculation and verification, and decoding.

Texts are cut into pre-tokens as the tokenizer's own pattern cuts them; a bounded memo keeps pre-tokens seen
before. For new ones a greedy pass proposes the longest token at each place. A proposal is what merging gives if
and only if each adjacent pair is compatible: merging the two tokens' bytes alone gives these two tokens. All
adjacent pairs of a batch are tested at once by undoing merges step by step over arrays. Only pre-tokens with a pair
that fails undergo exact merging by rank.

Nulls: a null text is empty and has no ids. Long texts are handled whole. Special tokens in a text become their
ids, as the tokenizers library does by default. Repeated rows give repeated rows, empty tables none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import small_batches
from wavelake.llm.tokens import Encoder, encoder

NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Speculator(Encoder):
    """Encoder whose ids come from greedy proposals, verified in bulk; nothing here asks the library."""

    def __init__(self, path: str):
        super().__init__(path)
        if self.kind != "byte":
            raise ValueError("a byte-level BPE file with its own pattern is needed")
        letters, vocab = byte_letters(), self.file["model"]["vocab"]
        self.bytes_of = {k: bytes(letters[c] for c in token) for token, k in vocab.items()}
        self.id_of = {b: k for k, b in self.bytes_of.items()}
        for x in self.file["added_tokens"]:
            self.bytes_of[x["id"]] = x["content"].encode()
        self.special_ids = {x["content"]: x["id"] for x in self.file["added_tokens"]}
        self.longest = max(map(len, self.id_of))
        # tokens of one first pair of bytes, and how long they get: the greedy pass starts there
        self.reach: dict[bytes, int] = {}
        for b in self.id_of:
            if len(b) > 1:
                self.reach[b[:2]] = max(self.reach.get(b[:2], 0), len(b))
        n = max(self.bytes_of) + 1
        # rank and halves by id; a token that is no merge has rank -1 and is whole
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys = []
        for r, m in enumerate(self.file["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merges[i, j] = (r, k)
            keys.append((i * n + j, r))
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        keys.sort()
        self.n, self.pair_keys, self.pair_ranks = n, np.array([k for k, _ in keys]), np.array([r for _, r in keys])
        sizes = np.array([len(self.bytes_of.get(k, b"")) for k in range(n)])
        self.byte_sizes, self.byte_starts = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of.get(k, b"") for k in range(n)), np.uint8)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, id_of, reach = [], 0, len(word), self.id_of, self.reach
        whole = id_of.get(word)
        if whole is not None:
            return [whole]
        while at < n:
            for size in range(min(reach.get(word[at : at + 2], 1), n - at), 1, -1):
                k = id_of.get(word[at : at + size])
                if k is not None:
                    out.append(k)
                    at += size
                    break
            else:
                out.append(id_of[word[at : at + 1]])
                at += 1
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of ids: whether merging both tokens' bytes gives them again.

        Walking back through the merges that made them, the pair of tokens that meet at the boundary must never
        have a merge that comes before the merge undone last on either side (on a tie, the left place is merged first).
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit_a, limit_b = np.full(len(a), NONE), np.full(len(a), NONE)
        while len(live):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            met = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)
            # the boundary merge wins over a later merge inside the left token, and, being further left, over an equal or later one inside the right token
            bad = (met < limit_a) & (met <= limit_b) & (met != NONE)
            good[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            done = bad | ((ra < 0) & (rb < 0))
            keep = ~done
            live, a, b, limit_a, limit_b, ra, rb = (x[keep] for x in (live, a, b, limit_a, limit_b, ra, rb))
            undo_a = ra > rb  # undo the later merge; of equal ones, the right one happened last
            limit_a, limit_b = np.where(undo_a, ra, limit_a), np.where(undo_a, limit_b, rb)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, of equal ones the leftmost."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min((self.merges.get((x, y), (NONE, 0)) + (i,) for i, (x, y) in enumerate(zip(ids[:-1], ids[1:], strict=True))), key=lambda t: (t[0], t[2]))
            if best[0] == NONE:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked places, for runs without a cut."""
        import heapq

        n = len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(m[0], i, x, y, m[1]) for i, (x, y) in enumerate(zip(ids[:-1], ids[1:], strict=True)) if (m := self.merges.get((x, y)))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, k = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = k, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [x for x, on in zip(ids, alive, strict=True) if on]

    def exact(self, texts: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        words = [x.encode() for x in texts]
        guess = [self.propose(w) for w in words]
        sizes = np.array([len(g) for g in guess], np.int64)
        flat = np.array([k for g in guess for k in g], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[:-1] == owner[1:]
        bad = np.unique(owner[:-1][inner][~self.compatible(flat[:-1][inner], flat[1:][inner])]) if len(flat) > 1 else ()
        for i in bad:
            guess[i] = self.merge(words[i])
        return [np.asarray(g, dtype="<u4").tobytes() for g in guess]

    words = exact

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with special tokens or odd separators: cut at the tokens, then by the pattern."""
        import regex

        at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        out = []
        for text in texts:
            parts = at.split(text) if at else [text]
            out.append(b"".join(np.asarray([self.special_ids[p]], dtype="<u4").tobytes() if p in self.special_ids else b"".join(self.exact(self.cut.findall(p))) for p in parts if p))
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin."""
        sizes = self.byte_sizes[ids]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(starts[-1]) + np.repeat(self.byte_starts[ids] - starts[:-1], sizes)
        return self.all_bytes[place].tobytes(), starts


def encode_decode(docs: DataFrame, tokenizer: str, keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every whole text; no shuffle."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")

    def run(batches):
        enc = encoder(tokenizer, Speculator)
        for b in batches:
            ids, starts = enc.encode(b.column(1))
            data, places = enc.decode(ids)
            raw, ends = ids.astype("<u4").tobytes(), places[starts].tolist()
            starts = starts.tolist()
            texts = [data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            if keep or not data.isascii():  # bytes that aren't text decode to replacement characters
                texts = [x.decode("utf-8", "replace").encode() for x in texts]
            cols = [
                b.column(0),
                pa.array([y - x for x, y in zip(starts[:-1], starts[1:], strict=True)], pa.int64()),
                pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(starts[:-1], starts[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            ]
            if keep:
                cols += [pa.array([ids[x:y].astype(np.int32) for x, y in zip(starts[:-1], starts[1:], strict=True)], pa.list_(pa.int32())), pa.array([x.decode() for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
