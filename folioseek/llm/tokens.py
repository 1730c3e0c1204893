"""Token ids of whole texts, word by word with a memory.

The vocabulary is a byte-pair encoding whose tokens never span white space and
whose last symbol of each piece carries an end mark. Each distinct piece is
merged by its ranks once; a test holds the ids against the tokenizers library,
which is several times slower on words that it meets for the first time.
"""

from __future__ import annotations

import json
import re
from array import array
from unicodedata import normalize

import numpy as np

# Fixed values of the vocabulary: its mark of a piece's end, its pattern of
# pieces, and the byte that stands for the end mark here (no UTF-8 text has it).
END_MARK = "</w>"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_BYTE = b"\xff"
# Characters that str.split parts at, but the vocabulary's pattern does not.
_NOT_WHITE = re.compile("[\x1c-\x1f]")


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(vocabulary: dict[str, int], special: set[str]) -> dict[bytes, int]:
    byte_of, ranks = _byte_of(), {}
    for token, number in vocabulary.items():
        if token not in special:
            plain = token.removesuffix(END_MARK)
            end = END_BYTE if plain != token else b""
            ranks[bytes(byte_of[c] for c in plain) + end] = number
    return ranks


class WordTokens(dict):
    """Ids of each word met so far, as bytes of `dtype`.

    At most `limit` words are remembered; then all are forgotten, which costs
    time and nothing else.
    """

    def __init__(self, path: str, dtype: str = "<u4", limit: int = 1_000_000):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        self.special = {t["content"]: t["id"] for t in known["added_tokens"]}
        ranks = _ranks(known["model"]["vocab"], set(self.special))
        self.merge = tiktoken.Encoding(
            "words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}
        )._encode_single_piece
        self.pieces = regex.compile(PIECES).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        size = np.dtype(dtype).itemsize
        self.code, self.limit = {2: "H", 4: "I"}[size], limit
        if max([*ranks.values(), *self.special.values()]) >= 1 << 8 * size:
            raise ValueError(f"ids do not fit into {dtype}")

    def _ids(self, text: str) -> list[int]:
        found: list[int] = []
        for part in self.cut(text) if "<|" in text else (text,):
            if part in self.special:
                found.append(self.special[part])
                continue
            if not part.isascii():
                part = normalize("NFC", part)
            # Character by character: str.lower treats one Greek letter by its place.
            part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            for piece in (part,) if part.isalpha() else self.pieces(part):
                found += self.merge(piece.encode() + END_BYTE)
        return found

    def _packed(self, text: str) -> bytes:
        return array(self.code, self._ids(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = self._packed(word)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null texts have none."""
        out = []
        for text in texts:
            if text and _NOT_WHITE.search(text):
                out.append(self._packed(text))
            else:
                out.append(b"".join(map(self.__getitem__, (text or "").split())))
        return out


_shared: dict[tuple[str, str], WordTokens] = {}


def word_tokens(path: str, dtype: str = "<u4") -> WordTokens:
    """One memory for each worker process, so that later tasks find it filled."""
    key = (path, dtype)
    if key not in _shared:
        _shared[key] = WordTokens(*key)
    return _shared[key]
