"""Words of untidy texts: how documents and passages are cut before they are compared."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

WORD = re.compile(r"[^\W_]+")
BREAK = re.compile(r"[-\u2010][ \t\r]*\n\s*(?=\w)")
UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def join_lines(text: str) -> str:
    """The text with hyphens at line ends closed."""
    return BREAK.sub("", text)


def token_words(token: str) -> list[str]:
    """Words of a piece without white space: lower case, letters and digits only."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", UNSEEN.sub("", token))
    return WORD.findall(token.lower())


def words(text: str) -> list[str]:
    """Words of a text as they are compared."""
    return [w for token in join_lines(text).split() for w in token_words(token)]


class WordIds(dict):
    """Ids (int32 bytes) of the words in a token, found once for each distinct token; 0 for words not in ``vocab``."""

    LIMIT = 1_000_000

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        ids = np.array([self.vocab.get(w, 0) for w in token_words(token)], np.int32).tobytes()
        self[token] = ids
        return ids

    def of(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, join_lines(text).split())), np.int32)
