"""Token ids by the tokenizers library, with a memo of the units between white space.

Both vocabularies cut a text at white space before any merge, so the ids of a text are
the ids of its units in a row. Units recur, texts don't: each worker keeps a bounded memo
from unit to packed ids and asks the library for the rest. Texts for which that cut isn't
certain (other white space than ASCII's, strings of special tokens) go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

#: Units a worker remembers; when full, the memo starts anew. Memory only, never results.
MEMO_UNITS = 1_200_000

#: White space that a library's regular expressions and ASCII's set may see differently.
_DOUBTFUL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0̀-ͯ ᠎ -‏ -  -⁯　﻿]")
#: A unit of byte-level vocabularies: a word with the one space before it, or white space.
_SPACED = re.compile(r" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]")
_BARE = re.compile(r"[^\x20\x09-\x0D]+")
#: A word of letters and the ASCII signs after it, which never merge with letters.
_SIGNED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-&(-/:-@\[-_{-~]+)")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-įı-ſ]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies spell a byte as itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


_SPELT = _byte_letters()


class Encoder(dict):
    """text -> little-endian unsigned 32-bit ids. The dict is the memo."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        super().__init__()
        self.memo_units = memo_units
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_level = self.tokenizer.normalizer is None
        self.units = (_SPACED if self.byte_level else _BARE).findall
        self.sure = self._layout_is_known()

    def _layout_is_known(self) -> bool:
        """Whether units are safe: proven on a probe text, else every text goes whole."""
        probe = "Ab  cd,\n e\tf é'll x1 !? don't\n\n G  "
        return b"".join(self[u] for u in self.units(probe)) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.memo_units:
            self.clear()
        if m := _SIGNED.fullmatch(unit):
            ids = self[m[1]] + self[m[2]]
        elif len(unit) < 64 and _LETTERS.fullmatch(unit):
            ids = array("I", [t.id for t in self.model.tokenize(self._spell(unit))]).tobytes()
        else:
            ids = self._whole(unit)
        self[unit] = ids
        return ids

    def _spell(self, unit: str) -> str:
        if not self.byte_level:
            unit = unit.lower()
        return unit.encode().decode("latin-1").translate(_SPELT)

    def encode(self, text: str) -> bytes:
        if not self.sure or _DOUBTFUL.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(map(self.__getitem__, self.units(text)))


@lru_cache(maxsize=2)
def encoder(path: str, memo_units: int = MEMO_UNITS) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(path, memo_units)
