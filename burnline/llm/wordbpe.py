"""Word-level BPE ids from the tokenizers library, memoised by space-separated run.

The vocabulary's normaliser and pre-tokeniser never look past white space, so a
text's ids are those of its runs between spaces, one after the other. Printable
ASCII runs, and letters with punctuation after them, are cut by the vocabulary's
own pattern; others by the library's normaliser and pre-tokeniser. The library's
model encodes each piece. A run that holds an added token's text goes to the
library's encoder whole. No run is cut before its normal form is known: a letter
may become a letter and a mark, and a mark belongs to the punctuation after it."""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np

#: Fixed value: the vocabulary's pre-token pattern, for printable lower-case ASCII.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
#: Letters of any script and ASCII punctuation after them; isalpha() checks the letters.
LETTERS = re.compile(r"([^\W\d_]+)([.,;:!?)\]]*)")
#: Punctuation that is a pre-token of its own after a letter or digit.
ENDS = frozenset(".,;:!?")
#: Characters of the longest run that is remembered.
LONGEST = 32


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTER_OF_BYTE = byte_letters()


def ends_plainly(c: str) -> bool:
    """Whether the lower-case normal form of a letter or digit ends in one."""
    return normalize("NFC", c).lower()[-1].isalnum()


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    raw = array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return raw.tobytes()


class Runs(dict):
    """Run of text -> its ids as little-endian 32-bit bytes. Two generations of `limit` runs of at most LONGEST characters bound the memory."""

    def __init__(self, path: str, limit: int = 500_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tokenize, self.norm, self.pre = self.tok.model.tokenize, self.tok.normalizer, self.tok.pre_tokenizer
        self.limit, self.old = limit, {}
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())

    def pack(self, piece: str) -> bytes:
        """Ids of one pre-token in the byte-level alphabet."""
        return little([t.id for t in self.tokenize(piece)])

    def marked(self, run: str) -> bytes:
        """Ids of a run that holds an added token's text."""
        return np.array(self.tok.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def fresh(self, run: str) -> bytes:
        if "<|" in run and any(a in run for a in self.added):
            return self.marked(run)
        if run.isascii() and run.isprintable():
            cut = ASCII.findall(run.lower())
            return self.kept(run, self.pack(cut[0])) if len(cut) == 1 else self.kept(run, b"".join(map(self.__getitem__, cut)))
        m = LETTERS.fullmatch(run)
        if m and m[1].isalpha() and m[1].lower().isalpha() and "Σ" not in run and is_normalized("NFC", run):
            if m[2]:
                return self.kept(run, self[m[1]] + self[m[2]])
            return self.kept(run, self.pack(run.lower().encode().decode("latin-1").translate(LETTER_OF_BYTE)))
        return self.kept(run, b"".join(self.pack(p) for p, _ in self.pre.pre_tokenize_str(self.norm.normalize_str(run))))

    def kept(self, run: str, ids: bytes) -> bytes:
        """Remembers a run's ids."""
        if len(run) <= LONGEST:
            if len(self) >= self.limit:
                self.old.clear()  # before the copy, so that no three generations are held
                self.old = self.copy()
                self.clear()
            self[run] = ids
        return ids

    def __missing__(self, run: str) -> bytes:
        got = self.old.get(run)
        if got is not None:
            return self.kept(run, got)
        if run[-1:] in ENDS and (c := run[-2:-1]).isalnum() and (c.isascii() or ends_plainly(c)) and "<|" not in run and "Σ" not in run:
            return self.kept(run, self[run[:-1]] + self[run[-1]])
        return self.fresh(run)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def runs(path: str) -> Runs:
    """One memo for each worker process and vocabulary."""
    return Runs(path)
