"""Byte-level BPE ids of many texts, with the pieces between white space looked up in a bounded cache."""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable
from functools import lru_cache

import tiktoken

END = "<|endoftext|>"
MOST_CACHED = 500_000


class Kept(dict):
    """Bounded cache of function values; it starts anew when full."""

    def __init__(self, function: Callable[[str], bytes]) -> None:
        self.function = function

    def __missing__(self, key: str) -> bytes:
        if len(self) >= MOST_CACHED:
            self.clear()
        found = self[key] = self.function(key)
        return found


def vocabulary(name: str) -> str:
    """A file of the installed vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """ids(text) as the tokenizers library gives with add_special_tokens=False: the end-of-text
    string is its special id, other text is encoded piece by piece. Pieces never span white space
    except for one leading space, so each is encoded once and kept; texts with other white space
    than single spaces and line feeds go through the encoder whole."""

    def __init__(self, path: str, ranks_path: str) -> None:
        import public_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode = lambda text: array("I", encode(text)).tobytes()
        self.end = array("I", [len(ranks)]).tobytes()
        self.first, self.spaced = Kept(self.encode), Kept(lambda word: self.encode(" " + word))

    def _plain(self, text: str) -> bytes:
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        if len(words) != gaps + 1 or sum(map(len, words)) + gaps != len(text):
            return self.encode(text)  # runs of white space, or other kinds of it
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self.first[head] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.first["\n"].join(out)

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; none for null and empty texts."""
        if not text:
            return b""
        if END not in text:
            return self._plain(text)
        return self.end.join(self._plain(p) if p else b"" for p in text.split(END))


@lru_cache(maxsize=2)
def byte_bpe(path: str | None = None) -> ByteBpe:
    path = path or vocabulary("byte_bpe_50k.json")
    return ByteBpe(path, os.path.splitext(path)[0] + ".tiktoken")
