"""Token ids of whole texts, with a cache of space-separated chunks.

The byte-level pre-tokeniser lets white space only begin a token, so a text may be cut before every single
space, and around every single line feed, that stands between two visible characters; each chunk's ids can
then be kept.  Most chunks are letters and then ASCII punctuation, which the pre-tokeniser parts as well.
Ids of such letters come from the same vocabulary's rank file (``tiktoken``, one piece at a time, several
times as fast); all other chunks, and texts with any other white space, go through ``tokenizers``.  The
tests compare both ways with plain encoding.
"""

from __future__ import annotations

import base64
import os
import re
import string
from functools import lru_cache

import numpy as np

#: Most chunks, and most words, kept in a worker.
CACHE = 100_000

#: White space, and other characters that some libraries count as such, besides the space and the line feed.
_RARE = [*range(0x09, 0x0A), 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_RARE_SPACE = re.compile("[" + "".join(map(chr, _RARE)) + "]")
_LATIN_END = chr(0x250)


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class CachedTokenizer:
    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.piece = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.line_feed = self._plain(["\n"])[0]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = _bytes(self.piece(word.encode()))
            if len(self.words) < CACHE:
                self.words[word] = ids
        return ids

    def _learn(self, new: list[str]) -> None:
        """Add the ids of new chunks (a chunk begins with its space, if it has one)."""
        odd, tails = [], self.tails
        for chunk in new:
            word = chunk.rstrip(string.punctuation)
            letters = word[1:] if word[:1] == " " else word
            if not (letters.isalpha() and (letters.isascii() or max(letters) < _LATIN_END)):
                odd.append(chunk)
                continue
            tail = chunk[len(word):]
            after = tails.get(tail)
            if after is None:
                after = self._plain([tail])[0]
                if len(tails) < CACHE:
                    tails[tail] = after
            self.chunks[chunk] = self._word(word) + after
        self.chunks.update(zip(odd, self._plain(odd)))

    @staticmethod
    def _simple(text: str) -> bool:
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or _RARE_SPACE.search(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        out: list = [None] * len(texts)
        cut: dict[int, list[list[str]]] = {}
        whole = []
        for i, text in enumerate(texts):
            if text and self._simple(text):
                cut[i] = [x.replace(" ", "\n ").split("\n") for x in text.split("\n")]
            else:
                whole.append(i)
        seen = set()
        for lines in cut.values():
            seen.update(*lines)
        new = list(seen.difference(self.chunks))
        self._learn(new)
        ids = self.chunks.__getitem__
        for i, lines in cut.items():
            out[i] = self.line_feed.join([b"".join(map(ids, chunks)) for chunks in lines])
        for i, own in zip(whole, self._plain([texts[i] for i in whole])):
            out[i] = own
        if len(self.chunks) > CACHE:  # keep the older ones: frequent chunks come early
            for chunk in new:
                del self.chunks[chunk]
        return [np.frombuffer(x, dtype="<u4") for x in out]


@lru_cache(maxsize=4)
def cached_tokenizer(path: str, ranks: str) -> CachedTokenizer:
    """One per worker process and vocabulary."""
    return CachedTokenizer(path, ranks)
