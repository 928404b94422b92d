"""BPE encoding and decoding by speculation and verification.

For the new words of a batch, greedy longest matches propose tokens. An encoding is the one that
merging gives exactly if every adjacent pair of tokens is compatible: merging the two tokens' text
alone gives those two tokens again. Pairs are looked up as arrays in one step for all words of the
batch (a pair not seen before is decided once, by merging), and only words with an incompatible
pair are merged in full. Words, and the pieces between white space, are kept in bounded caches.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .tokens import vocabulary

MOST_CACHED = 700_000
#: Words of more letters than this are merged over a heap, shorter ones over a plain list.
LONG = 100
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES = regex.compile(r"\s+")
_NONE = 1 << 62


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, iter(range(256, 512))
    return [out.get(b) or chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encodes words of a tokenizer file with an end-of-word suffix, NFC and lower case."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.id: dict[str, int] = made["model"]["vocab"]
        self.suffix: str = made["model"]["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        #: Of a pair of ids (left << 32 | right): the merge's rank and the id it gives (rank << 32 | id).
        self.joins = {self.id[a] << 32 | self.id[b]: k << 32 | self.id[a + b] for k, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.token = {i: t for t, i in [*self.id.items(), *self.special.items()]}
        self.letters = _byte_letters()
        self.words = regex.compile(SPLIT)
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        #: Of each three letters: the longest token that begins with them, the suffix not counted.
        self.reach: dict[str, int] = {}
        for token in self.id:
            body = token.removesuffix(self.suffix) if self.suffix else token
            self.reach[body[:3]] = max(self.reach.get(body[:3], 0), len(body))
        self.sound: dict[int, bool] = {}  # whether merging a token's own letters gives the token
        self.pairs = np.zeros(0, np.int64)  # decided pairs, sorted: left << 32 | right
        self.fits = np.zeros(0, bool)
        self.known: dict[str, bytes] = {}
        self.piece_ids: dict[str, bytes] = {}
        self.piece_text: dict[str, str] = {}

    def _symbols(self, token: str) -> list[int]:
        """Ids of a token's letters, the last one with the suffix if the token has it."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*map(self.id.__getitem__, body[:-1]), self.id[body[-1] + self.suffix]]
        return list(map(self.id.__getitem__, token))

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the adjacent pair of least rank first, the leftmost of equals."""
        if len(ids) > LONG:
            return self._merge_long(ids)
        get = self.joins.get
        found = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (least := min(found)) != _NONE:
            i = found.index(least)
            ids[i : i + 2] = [least & 0xFFFFFFFF]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(found):
                found[i] = get(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """merge over a linked list and a heap of (rank, place), in n log n steps. A heap entry whose
        pair has changed meanwhile is passed over, as its rank is no longer that of the pair."""
        get, n = self.joins.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found >> 32) << 32 | i for i in range(n - 1) if (found := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or (found := get(ids[i] << 32 | ids[j])) is None or found >> 32 != entry >> 32:
                continue
            ids[i], ids[j] = found & 0xFFFFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (found >> 32) << 32 | i)
            if (h := before[i]) >= 0 and (found := get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (found >> 32) << 32 | h)
        return [i for i in ids if i >= 0]

    def _greedy(self, word: str) -> list[int] | None:
        """Longest sound tokens from the left of a word that ends in the suffix."""
        ids, at, inner = [], 0, len(word) - len(self.suffix)
        while at < inner:
            reach = self.reach.get(word[at : at + 3], 2) if at + 3 <= inner else 2
            for end in range(min(inner, at + reach), at, -1):
                token = word[at:end] if end < inner else word[at:]
                i = self.id.get(token)
                if i is not None and self._sound(i, token):
                    ids.append(i)
                    at = end
                    break
            else:
                return None
        return ids

    def _sound(self, i: int, token: str) -> bool:
        got = self.sound.get(i)
        if got is None:
            got = self.sound[i] = self.merge(self._symbols(token)) == [i]
        return got

    def _compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair (left << 32 | right) survives merging, by one sorted lookup."""
        fresh = np.setdiff1d(codes, self.pairs)
        if len(fresh):
            fit = []
            for code in fresh.tolist():
                left, right = code >> 32, code & 0xFFFFFFFF
                fit.append(self.merge(self._symbols(self.token[left]) + self._symbols(self.token[right])) == [left, right])
            if len(self.pairs) > 2_000_000:
                self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
            every, verdict = np.concatenate([self.pairs, fresh]), np.concatenate([self.fits, fit])
            if len(self.pairs) == 0 and len(np.setdiff1d(codes, every)):
                return self._compatible(codes)
            order = np.argsort(every)
            self.pairs, self.fits = every[order], verdict[order]
        return self.fits[np.searchsorted(self.pairs, codes)]

    def _learn(self, words: list[str]) -> None:
        """Encode words (in byte letters, without suffix) that are not known yet, as one batch."""
        proposals = [self._greedy(w + self.suffix) for w in words]
        sizes = np.array([len(p) if p else 0 for p in proposals])
        flat = np.fromiter((i for p in proposals if p for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        wrong = {k for k, p in enumerate(proposals) if p is None}
        if len(flat) > 1:
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            good = self._compatible(flat[inside] << 32 | flat[inside + 1])
            wrong |= set(owner[inside[~good]].tolist())
        for k, word in enumerate(words):
            ids = proposals[k] if k not in wrong else self.merge(self._symbols(word + self.suffix))
            self.known[word] = array("I", ids).tobytes()

    def _letters(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))

    def _prepare(self, texts: list[str]) -> list[list[str]]:
        """Pieces between white space of each text, whose encodings are then kept. A special token
        stands between them as its string after a space, which no piece has."""
        out: list[list[str]] = []
        for text in texts:
            items: list[str] = []
            at = 0
            for mark in self.marks.finditer(text) if "<|" in text else ():
                items += [*self._split(text[at : mark.start()]), " " + mark[0]]
                at = mark.end()
            out.append(items + self._split(text[at:]) if at else self._split(text))
        used = set(chain.from_iterable(out))
        if len(self.piece_ids) > MOST_CACHED or not self.piece_ids:  # keep what this batch has
            marks = {" " + t: i for t, i in self.special.items()}
            self.piece_ids = {p: self.piece_ids[p] for p in used & self.piece_ids.keys()} | {m: array("I", [i]).tobytes() for m, i in marks.items()}
            self.piece_text = {p: self.piece_text[p] for p in used & self.piece_text.keys()} | {m: m[1:] for m in marks}
        if len(self.known) > MOST_CACHED:
            self.known.clear()
        new = used - self.piece_ids.keys()
        parts = {p: [self._letters(w) for w in self.words.findall("".join("σ" if c == "Σ" else c.lower() for c in p) if "Σ" in p else p.lower())] for p in new}
        if fresh := list(set(chain.from_iterable(parts.values())) - self.known.keys()):
            self._learn(fresh)
        for piece, words in parts.items():
            ids = self.piece_ids[piece] = b"".join(map(self.known.__getitem__, words))
            self.piece_text[piece] = self.decode(array("I", ids))
        return out

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        pieces = text.split() if not _CONTROL.search(text) else _SPACES.split(text)
        return pieces if pieces and pieces[0] and pieces[-1] else [p for p in pieces if p]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces, as a tokenizer without a decoder gives."""
        return " ".join(map(self.token.__getitem__, ids))

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Little-endian ids and the decoded text of each text (null: empty)."""
        for items in self._prepare([t or "" for t in texts]):
            yield b"".join(map(self.piece_ids.__getitem__, items)), " ".join(map(self.piece_text.__getitem__, items))


#: str.split() also splits at these four, which are not white space to a tokenizer.
_CONTROL = regex.compile(r"[\x1c-\x1f]")


@lru_cache(maxsize=2)
def word_bpe(path: str | None = None) -> WordBpe:
    return WordBpe(path or vocabulary("word_bpe_49k.json"))


def encode_documents(docs: DataFrame, vocabulary_path: str | None = None, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array) and decoded text, and SHA-256 digests of both.

    Without keep, ids and decoded are null. A null or empty text has no ids. One row for each row of
    docs, with repeats and null doc_ids as they are; further columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary_path)
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.slice(begin, 500)
                n, ids_at, ids, text_at, decoded = [], [], [], [], []
                for raw, text in bpe.encode_batch(part.column("text").to_pylist()):
                    n.append(len(raw) // 4)
                    ids_at.append(hashlib.sha256(raw).hexdigest())
                    text_at.append(hashlib.sha256(text.encode()).hexdigest())
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int32) if keep else None)
                    decoded.append(text if keep else None)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_at, pa.string()), pa.array(text_at, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"), keep=False).drop("ids", "decoded")
