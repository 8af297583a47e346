"""Pre-tokens of a text, cut so that most of it never meets the regular expression.

Between a character that is no white space and a single space that such a
character follows, the byte-level pattern always ends one match and starts the
next.  Texts are cut there first; each piece depends on itself alone, so what is
known of a piece can be kept and looked up again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# Where other white space stands beside a space, only a cut between two visible characters is safe.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MARKS = frozenset(".,;:!?")
KEPT_CHARS = 64


def pieces(text: str) -> tuple[str, list[str]]:
    """First piece, and the others, each of which follows one space."""
    plain = not ("  " in text or " \n" in text or "\n " in text or any(c in text for c in _RARE))
    first, *rest = text.split(" ") if plain else _SAFE.split(text)
    return first, rest


class Recent(dict):
    """Memo of a function in two generations: bounded, and what is used often stays."""

    def __init__(self, make: Callable[[str], object], bound: int):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key: str) -> object:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class PieceTable(Recent):
    """What ``join`` makes of the values of the pre-tokens in " " + piece."""

    def __init__(
        self,
        pattern: str,
        value: Callable[[str], object],
        join: Callable[[list], object],
        bound: int = 60_000,
        words_bound: int = 160_000,
    ):
        super().__init__(self.parted, bound)
        self.find = regex.compile(pattern).finditer
        self.words, self.join = Recent(value, words_bound), join
        self.first = Recent(self.of, bound // 10)

    def of(self, text: str) -> object:
        words = self.words
        return self.join([words[m.group()] for m in self.find(text)])

    def parted(self, piece: str) -> object:
        """Letters alone are one pre-token; letters and one mark are two; the pattern cuts all else."""
        if piece.isalpha():
            return self.words[" " + piece]
        if piece[-1:] in _MARKS and piece[:-1].isalpha():
            return self.join([self.words[" " + piece[:-1]], self.words[piece[-1]]])
        return self.of(" " + piece)

    def of_text(self, text: str) -> object:
        first, rest = pieces(text)
        return self.join([self.first[first], *map(self.__getitem__, rest)])
