"""BPE encoding with a contiguous rank array, and decoding, for tokenizer files with word ends."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Unicode's White_Space, which is what the tokenizer's \s stands for
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(f"[{_SPACE}]+")
#: Letters and numbers assigned after Unicode 16.0, which the tokenizer's tables don't know.
_LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


#: Capitals that Unicode got in 16.0 and 17.0, which the tokenizer lower-cases and Python's tables may not know
_LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_LATER_UPPER = re.compile("[" + "".join(map(chr, _LATER_LOWER)) + "]")


def _ranges(text: str) -> str:
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in text.split())


_LETTER, _NUMBER = rf"\p{{L}}--[{_ranges(_LATER_LETTERS)}]", rf"\p{{N}}--[{_ranges(_LATER_NUMBERS)}]"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}[{_LETTER}][{_NUMBER}]]+", regex.V1)
#: the same for words of ASCII, already lower-cased
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: parts up to which the rank array is scanned; beyond, a heap finds the same minimum
SHORT = 96
_NO_RANK = 1 << 60


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class WordBPE:
    """Encoder and decoder of one tokenizers file of this kind.

    Texts are cut at the special tokens' strings, brought to NFC, lower-cased
    and cut at white space; each rest is cut by the split pattern and merged.
    Ids are kept for words met before, in two generations of bounded size.  Words of up to SHORT
    parts, which are all but junk, keep their ranks in a contiguous array; for longer ones, where scanning it would be quadratic,
    a heap finds the same minimum.
    """

    def __init__(self, file: str, keep: int = 200_000):
        spec = json.loads(Path(file).read_text(encoding="utf-8"))
        model, self.keep = spec["model"], keep
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.raw = [self.token.get(i, "").encode() for i in range(max(self.token) + 1)]
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        alphabet = _byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        self.pack = struct.Struct("<I").pack
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.ids: dict[str, bytes] = {}
        self.old_ids: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank, merged = self.rank.get, self.merged
        ranks = list(map(rank, zip(parts, parts[1:]), repeat(_NO_RANK)))
        while ranks:
            low = min(ranks)
            if low == _NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = made = merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], made), _NO_RANK)
            if i < len(ranks):
                ranks[i] = rank((made, parts[i + 1]), _NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get((a, b))) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (s := rank.get((parts[k], parts[after[k]]))) is not None:
                    heappush(heap, (s, k, parts[k], parts[after[k]]))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        """Ids of a stretch without white space, as bytes, which are kept."""
        found = self.old_ids.get(word)
        if found is None:
            ids: list[int] = []
            for piece in (_ASCII_PIECES if word.isascii() else _PIECES).findall(word):
                raw = piece.encode()
                parts = list(map(self.inner.__getitem__, raw))
                parts[-1] = self.last[raw[-1]]
                ids += self.merge(parts)
            found = self.pack(*ids) if len(ids) == 1 else np.array(ids, "<u4").tobytes() if len(ids) > 24 else struct.pack(f"<{len(ids)}I", *ids)
        if len(self.ids) >= self.keep:
            self.old_ids, self.ids = self.ids, {}
        if len(word) <= 64:
            self.ids[word] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased without regard to its place in the word
                text = text.replace("Σ", "σ")
            if _LATER_UPPER.search(text):
                text = text.translate(_LATER_LOWER)
        text = text.lower()
        words = [w for w in _SPLIT.split(text) if w] if _ODD_SPACE.search(text) else text.split()
        ids = list(map(self.ids.get, words))
        if None in ids:
            for k, got in enumerate(ids):
                if got is None:
                    ids[k] = self._word(words[k])
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.special_cut is None or "<|" not in text and not any(s in text for s in self.special):
            return b"".join(self._plain(text))
        ids: list[bytes] = []
        for part in self.special_cut.split(text):
            if part in self.special:
                ids.append(self.pack(self.special[part]))
            elif part:
                ids += self._plain(part)
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        """As decode(ids, skip_special_tokens=False) of a file without a decoder, in UTF-8: tokens with blanks between."""
        return b" ".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, WordBPE] = {}


def load(file: str) -> WordBPE:
    if file not in _LOADED:
        _LOADED[file] = WordBPE(file)
    return _LOADED[file]


def encode_table(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with with_ids).

    file: a tokenizers JSON file that every worker can read.  Null is the empty
    text, which has no tokens; very long words and texts are encoded whole; rows
    that repeat give repeated rows; other columns aren't read.  One pass,
    nothing is exchanged.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for batch in batches:
            n, a, b, ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                got = bpe.encode(text)
                shown = bpe.decode(got)
                n.append(len(got) // 4)
                a.append(hashlib.sha256(got).hexdigest())
                b.append(hashlib.sha256(shown).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(got, "<u4").astype(np.int32))
                    texts.append(shown.decode())
            cols = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
