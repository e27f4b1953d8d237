"""Bags of tokens of many texts at once, the tokens of `text.words`, as numbers: what Arrow batches of texts are searched by."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

HAN, HAN_END = 0x4E00, 0x9FFF
_N = HAN_END - HAN + 1
#: Codes of tokens: pairs of Han characters, then single ones, then words in the order in which they were met.
_LONE, _WORD = _N * _N, _N * _N + _N
_WORDS = re.compile("[a-z0-9]+")
#: Characters cut at once, in whole texts.
PIECE = 2_000_000


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE characters each, which bounds the memory of a batch of long texts."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= PIECE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Cutter:
    """Cuts texts into tokens.  With `known` words, others get the code -1 and so do no work; without, all words get codes."""

    def __init__(self, known: list[str] | None = None):
        self.closed, self.ids, self.names = known is not None, {}, []
        for t in known or ():
            if _WORDS.fullmatch(t):
                self._id(t)

    def _id(self, word: str) -> int:
        i = self.ids.setdefault(word, len(self.names) + _WORD)
        if i == len(self.names) + _WORD:
            self.names.append(word)
        return i

    def code(self, token: str) -> int:
        """The code of a known token."""
        if token in self.ids:
            return self.ids[token]
        a = ord(token[0]) - HAN
        return _LONE + a if len(token) == 1 else a * _N + ord(token[1]) - HAN

    def token(self, code: int) -> str:
        if code >= _WORD:
            return self.names[code - _WORD]
        return chr(code - _LONE + HAN) if code >= _LONE else chr(code // _N + HAN) + chr(code % _N + HAN)

    def cut(self, texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens the place of their text and their code, and each text's number of tokens; of `wanted` codes alone (sorted), if given."""
        low = [t.lower() for t in texts]
        joined = "\n".join(low)
        ch = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)  # behind each text's separator
        han = np.zeros(len(ch) + 2, bool)
        han[1:-1] = (ch >= HAN) & (ch <= HAN_END)
        here = han[1:-1]
        pair, lone = here & han[2:], here & ~han[:-2] & ~han[2:]
        latin = np.zeros(len(ch) + 1, bool)
        latin[1:] = ((ch >= 97) & (ch <= 122)) | ((ch >= 48) & (ch <= 57))
        first = latin[1:] & ~latin[:-1]
        till = np.zeros(len(ch) + 1, np.int64)
        np.cumsum(pair | lone | first, out=till[1:])
        at = till[np.minimum(ends, len(ch))]
        sizes = np.diff(at, prepend=0)
        if wanted is not None:  # characters that begin a wanted token, and those that end one
            pairs, lones = wanted[wanted < _LONE], wanted[(wanted >= _LONE) & (wanted < _WORD)]
            heads, tails = np.zeros(_N, bool), np.zeros(_N, bool)
            heads[pairs // _N] = tails[pairs % _N] = True
            i = np.flatnonzero(pair)
            i = i[heads[ch[i] - HAN]]
            i = i[tails[ch[i + 1] - HAN]]
            j = np.flatnonzero(lone) if len(lones) else np.zeros(0, np.int64)
        else:
            i, j = np.flatnonzero(pair), np.flatnonzero(lone)
        get = (lambda w: self.ids.get(w, -1)) if self.closed else self._id
        w = np.flatnonzero(first)
        codes = [(ch[i].astype(np.int64) - HAN) * _N + (ch[i + 1].astype(np.int64) - HAN), ch[j].astype(np.int64) - HAN + _LONE, np.fromiter(map(get, _WORDS.findall(joined)), np.int64, len(w))]
        code, place = np.concatenate(codes), np.concatenate([i, j, w])
        if wanted is not None:
            k = np.minimum(np.searchsorted(wanted, code), max(len(wanted) - 1, 0))
            kept = wanted[k] == code if len(wanted) else np.zeros(len(code), bool)
            code, place = code[kept], place[kept]
        return np.searchsorted(ends, place, side="right"), code, sizes


def counted(text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token of each text once, with how often it stands there, in the order of texts and codes."""
    key = np.sort((text << 32) | code)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at] >> 32, key[at] & 0xFFFFFFFF, np.diff(at, append=len(key))


def added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal codes."""
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)
