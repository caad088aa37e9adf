"""Token ids of whole texts by a public tokenizer file, vectorised over pieces between spaces.

A tokenizer that splits at white space encodes a text as the concatenation of what it makes of the text's
pieces, if cuts are made only where its pre-tokenizer always cuts. A batch of texts is split and reduced to its
distinct pieces by Arrow, only pieces not met before go on to their pre-tokens, and only new pre-tokens reach the
encoder. Ids are then gathered by index. The memo is bounded. A tokenizer whose pre-tokenizer isn't known here
gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

#: Pieces and pre-tokens remembered by one worker before the memo starts afresh.
MEMO = 600_000
#: Words that the library gets at a time as one text; their ids are told apart again afterwards.
JOINED = 64
#: Texts cut with more care: white space before a space (byte level), the mark used below, separators, special tokens.
UNSAFE = {
    "byte": "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] |[\\x01\\x1c-\\x1f]|<\\|",
    "word": "[\\x01\\x1c-\\x1f]|<\\|",
}
#: Where pieces end, told by a mark: between a letter and a stop, at a lone line end between words, before a space.
#: Letters are those that stay single letters when composed and lower-cased: without U+00D7, U+00F7 and U+0130.
CUTS = (
    ("([A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{24f}])([.,;:!?])", "\\1\1\\2"),
    ("([A-Za-z.,;:!?])\\n([A-Za-z])", "\\1\1\n\1\\2"),
    (" ", "\1 "),
)
#: The cutting patterns of the two kinds of pre-tokenizer (fixed values of the tokenizer files).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOADED: dict[tuple, "Encoder"] = {}


def encoder(path: str, make: type | None = None) -> "Encoder":
    """The worker's encoder of a file; loaded once in each worker."""
    make = make or Encoder
    if (path, make) not in _LOADED:
        _LOADED[path, make] = make(path)
    return _LOADED[path, make]


def kind_of(tokenizer: dict) -> str:
    """byte: byte level, cutting by its own pattern; word: lower case, white space dropped; else other."""
    before, normal = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("normalizer")
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
        return "byte"
    steps = before.get("pretokenizers") or []
    if [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0]["pattern"].get("Regex") == WORD_PATTERN:
        return "word"
    return "other"


class Encoder:
    """encode(array of texts): the ids of all texts, one after another, and where each text's ids begin."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import regex
        from tokenizers import Tokenizer

        self.np, self.pa, self.pc = np, pa, pc
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        self.kind = kind_of(self.file)
        self.special = tuple(x["content"] for x in self.file.get("added_tokens") or [])
        self.cut = regex.compile(BYTE_PATTERN if self.kind == "byte" else WORD_PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.limit = MEMO
        vocab = self.library.get_vocab()
        self.sizes, self.closes = np.zeros(max(vocab.values()) + 1, np.int64), np.zeros(max(vocab.values()) + 1, bool)
        for token, k in vocab.items():  # byte level: one character stands for one byte
            self.sizes[k], self.closes[k] = len(token), token.endswith("</w>")

    _runs = re.compile(r"\s*\S+|\s+")
    _odd = re.compile("[\x1c-\x1f]")

    def exact(self, texts: list[str]) -> list[bytes]:
        """Ids of texts or pre-tokens by the library itself."""
        return [self.np.asarray(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of single words, by the library, which gets many as one text: a word ends with an end-of-word token, or, at byte level, where its bytes do."""
        np = self.np
        if self.kind == "byte":
            led = [x for x in words if x[0] == " "]
            if len(led) < len(words):
                rest = [x for x in words if x[0] != " "]
                made = dict(zip(led + rest, self.words(led) + self.exact(rest), strict=True)) if rest else {}
                return [made[x] for x in words]
        if not words:
            return []
        glue = "" if self.kind == "byte" else " "
        found = self.library.encode_batch_fast([glue.join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], add_special_tokens=False)
        ids = np.asarray([t for x in found for t in x.ids], dtype="<u4")
        if self.kind == "byte":
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x.encode()) for x in words])) + 1
        else:
            ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self.exact(words)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may hold special tokens or what isn't cut safely."""
        return self.exact(texts)

    def _pre_tokens(self, piece: str) -> list[str] | None:
        """What the pre-tokenizer makes of a piece; None if only the whole piece will do."""
        if "<|" in piece or self._odd.search(piece):
            return None
        if self.kind == "word" and not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
            low = piece.lower()
            if "Σ" in piece or unicodedata.normalize("NFC", low) != low:
                return None
            piece = low
        elif self.kind == "word":
            piece = piece.lower()
        return self.cut.findall(piece)

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are cut safely."""
        memo = self.pieces
        new = [x for x in pieces if x not in memo]
        if not new:
            return [memo[x] for x in pieces]
        alone = [x for x in new if x.isalpha() or (x[:1] == " " and x[1:].isalpha())]
        known = dict(zip(alone, self.words(alone), strict=True)) if alone else {}
        if len(known) < len(new):
            rest = [x for x in new if x not in known]
            parts = [self._pre_tokens(x) for x in rest]
            todo = list({t for p in parts if p for t in p if t not in memo and t not in known})
            made = dict(zip(todo, self.exact(todo), strict=True)) if todo else {}
            hard = [x for x, p in zip(rest, parts, strict=True) if p is None]
            known.update(zip(hard, self.whole(hard), strict=True) if hard else ())
            made |= known
            for x, p in zip(rest, parts, strict=True):
                if p is not None:
                    known[x] = b"".join([made[t] if t in made else memo[t] for t in p])
        out = [known[x] if x in known else memo[x] for x in pieces]
        if len(memo) + len(known) > self.limit:
            memo.clear()
        memo.update(known)
        return out

    def _careful(self, text: str) -> bytes:
        if self._odd.search(text) or any(x.lower() in text.lower() for x in self.special):
            return self.whole([text])[0]
        return b"".join(self.of_pieces(self._runs.findall(text)))

    def encode(self, texts):
        """(ids, starts): numpy arrays; the ids of text i are ids[starts[i]:starts[i + 1]]. A null text is empty."""
        np, pa, pc = self.np, self.pa, self.pc
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        odd: dict[int, bytes] = {}
        if self.kind == "other":
            odd = dict(enumerate(self.whole(texts.to_pylist())))
        else:
            odd = {i: self._careful(texts[i].as_py()) for i in np.flatnonzero(pc.match_substring_regex(texts, UNSAFE[self.kind]).to_numpy(zero_copy_only=False))}
        if odd:
            keep = np.ones(len(texts), bool)
            keep[list(odd)] = False
            texts = pc.if_else(pa.array(keep), texts, "")
        if self.kind == "word":
            texts = pc.ascii_lower(texts)
        for pattern, cut in CUTS:
            texts = pc.replace_substring_regex(texts, pattern, cut)
        split = pc.split_pattern(texts, "\1")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        ids = pa.array(self.of_pieces(names), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[: len(ids) + 1] // 4
        flat = np.frombuffer(ids.buffers()[2], dtype="<u4") if ids.buffers()[2] else np.zeros(0, "<u4")
        starts = ends[first - first[0]]
        if odd:
            parts = [np.frombuffer(odd[i], "<u4") if i in odd else flat[starts[i] : starts[i + 1]] for i in range(len(starts) - 1)]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
            flat = np.concatenate(parts)
        return flat, starts
