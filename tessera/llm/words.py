"""Words of a text for comparison: case, punctuation, typography, character forms and markup left out."""

from __future__ import annotations

import html
import re
import unicodedata

#: Where the vocabulary files of public tokenizers lie, unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's tokenizer parts a text before it merges bytes.
TOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_BROKEN = re.compile("[-­‐‑]\r?\n[\\s>|#*/-]*")
_DASH = re.compile("[‒-―−]|--+|/(?=[^/])")
_BEYOND = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    """One word: compatibility forms and accents folded, invisible characters and punctuation removed, lower case."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return _BEYOND.sub("", word).lower()


def tokens(text: str) -> list[str]:
    """Blank-separated words with their punctuation; markup, entities and words broken at line ends resolved."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "-\n" in text or "-\r" in text or not text.isascii():
        text = _BROKEN.sub("-", text)
    if not text.isascii() or "--" in text or "/" in text:
        text = _DASH.sub(" ", text)
    return text.split()


class Vocabulary(dict):
    """Ids of raw words: from 1 for the known plain words, 0 for others, -1 for what holds no letter or digit."""

    #: Raw spellings remembered at most; beyond it the memory starts anew.
    MOST = 1_000_000

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        p = plain(word)
        i = self.known.get(p, 0) if p else -1
        if len(self) >= self.MOST:
            self.clear()
        self[word] = i
        return i
