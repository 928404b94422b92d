"""Token counts by byte-pair merging over a heap and a linked list; no ids are made.

The bytes of a piece are its symbols. The adjacent pair of lowest rank (the leftmost of equals) is popped from
a heap and merged, and the pairs it makes with its neighbours in the linked list are pushed; a piece has as
many tokens as it had bytes, less the merges. Counts of short pieces are kept, bounded by their letters.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .common import fresh_name, load
from .tokens import vocabulary

LIMIT = 512
#: Pieces of more letters are merged each time they occur; kept ones have so many letters in all.
KEPT_LETTERS, MOST_LETTERS = 64, 6_000_000
LOW, HIGH = 0xFFFFFFFF, 0xFFFFFFFF << 32


class KeptCounts(dict):
    """Counts of pieces, each after a fixed start; begins anew when the pieces hold MOST_LETTERS."""

    def __init__(self, count: Callable[[str], int], start: str = "") -> None:
        self.count, self.start, self.letters = count, start, 0

    def __missing__(self, piece: str) -> int:
        found = self.count(self.start + piece)
        if len(piece) <= KEPT_LETTERS:
            if self.letters > MOST_LETTERS:
                self.clear()
                self.letters = 0
            self.letters += len(piece) + 8
            self[piece] = found
        return found


class TokenCounter:
    """count(text) is the number of ids that the tokenizers library gives for a byte-level BPE file with
    add_special_tokens=False: strings of special tokens count one, other text by pieces."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        byte = {c: bytes([b]) for b, c in enumerate(_byte_letters())}
        plain = {token: b"".join(map(byte.__getitem__, token)) for token in made["model"]["vocab"] if all(c in byte for c in token)}
        number = {raw: k for k, raw in enumerate(dict.fromkeys([bytes([b]) for b in range(256)] + list(plain.values())))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        #: Of a pair of symbols (left << 32 | right): the merge's rank and the symbol made (rank << 32 | symbol).
        self.joins: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = plain.get(a) or byte[a], plain.get(b) or byte[b]
            self.joins.setdefault(number[left] << 32 | number[right], rank << 32 | number[left + right])
        special = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.piece = KeptCounts(self.merged)  # as the file's pattern cuts them
        self.first, self.spaced = KeptCounts(self._count), KeptCounts(self._count, " ")  # between white space

    def merged(self, piece: str) -> int:
        """Tokens of one piece: its bytes less the merges."""
        raw = piece.encode()
        get, n = self.joins.get, len(raw)
        symbol, after, before = list(raw), list(range(1, n + 1)), list(range(-1, n - 1))
        # a heap entry is rank and place; it is stale if the pair at the place has another rank by now
        pairs = [get(a << 32 | b) for a, b in zip(symbol, raw[1:], strict=False)]
        heap = [found & HIGH | i for i, found in enumerate(pairs) if found is not None]
        heapq.heapify(heap)
        pairs.append(None)
        while heap:
            i = (entry := heapq.heappop(heap)) & LOW
            if (found := pairs[i]) is None or found & HIGH != entry & HIGH:
                continue
            j = after[i]
            made = symbol[i] = found & LOW
            pairs[j] = None
            n -= 1
            k = after[i] = after[j]
            if k < len(raw):
                before[k] = i
                found = pairs[i] = get(made << 32 | symbol[k])
                if found is not None:
                    heapq.heappush(heap, found & HIGH | i)
            else:
                pairs[i] = None
            if (h := before[i]) >= 0:
                found = pairs[h] = get(symbol[h] << 32 | made)
                if found is not None:
                    heapq.heappush(heap, found & HIGH | h)
        return n

    def _count(self, text: str) -> int:
        return sum(map(self.piece.__getitem__, self.pieces.findall(text)))

    def _plain(self, text: str) -> int:
        # a piece holds no white space but one leading space, so words after single spaces or line feeds are apart
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        if len(words) != gaps + 1 or sum(map(len, words)) + gaps != len(text):
            return self._count(text)  # runs of white space, or other kinds of it
        total = text.count("\n") * self.first["\n"]
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            total += self.first[head] + sum(map(self.spaced.__getitem__, rest))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(self._plain(p) for p in parts if p) + len(parts) - 1


@lru_cache(maxsize=2)
def token_counter(path: str | None = None) -> TokenCounter:
    return TokenCounter(path or vocabulary("byte_bpe_50k.json"))


def count_tokens(docs: DataFrame, text: str = "text", limit: int = LIMIT, vocabulary_path: str | None = None) -> DataFrame:
    """docs with n_bytes (of the text in UTF-8), n_tokens and over_limit (more tokens than limit).

    A null or empty text has 0 of both. Each row is counted for itself, so repeats, null ids and further
    columns stay as they are; columns of docs named as a result give way to it. An empty table gives none.
    """
    [n] = fresh_name(docs, "_n")

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = token_counter(vocabulary_path)
        for batch in texts:
            yield batch.map(counter.count, na_action=None).astype("int64")

    made = docs.withColumn(n, counted(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    return made.withColumns({"n_bytes": size, "n_tokens": F.col(n), "over_limit": F.col(n) > limit}).drop(n)


def op13_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
