"""Ids of whole texts by a public tokenizer, with repeated space-separated parts encoded once per worker."""

from __future__ import annotations

import os
from functools import lru_cache
from unicodedata import normalize

#: Texts with this mark may hold the string of an added token; they are encoded whole.
SPECIAL_MARK = "<|"
#: Parts kept per worker; a full table is emptied, which changes the speed only.
CACHE_PARTS = 1_200_000
#: Marks that may follow a word; an apostrophe is none, as it starts a contraction.
TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer runs of marks are encoded with their word, so that the table of runs stays small.
LONGEST_TAIL = 4


@lru_cache(maxsize=None)
def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: itself if visible, else the next free one above 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def ends_in_letter(stem: str) -> bool:
    """Whether a word still ends in a letter as the tokenizer sees it: some letters become a letter and a mark, which
    would be one pre-token with the marks that follow."""
    return stem.isalpha() and (stem.isascii() or normalize("NFC", stem).lower()[-1].isalpha())


class Irregular(Exception):
    """The text has to be encoded whole."""


class Parts(dict):
    """Ids (little-endian bytes) of parts without white space, all following the same lead ("" or a space).

    White space starts a pre-token in both tokenizers and letters, digits and marks never share one, so a
    part keeps its ids wherever it stands, and a word followed by a run of marks has the ids of both.
    """

    def __init__(self, owner: "TextEncoder", lead: str):
        self.owner, self.lead = owner, lead

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise Irregular
        if len(self) >= CACHE_PARTS:
            self.clear()
        stem = part.rstrip(TAILS)
        if 0 < len(part) - len(stem) <= LONGEST_TAIL and ends_in_letter(stem):
            ids = self[stem] + self.owner.mark(part[len(stem):])
        else:
            ids = self.owner.word(self.lead, part)
        self[part] = ids
        return ids


class TextEncoder:
    """``encode`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.lower = self.tokenizer.normalizer is not None
        self.space = "" if self.lower else self.letters[32]
        self.first = Parts(self, "")
        self.later = self.first if self.lower else Parts(self, " ")  # this tokenizer drops white space, so a lead changes nothing
        self.marks: dict[str, bytes] = {}
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        import numpy as np

        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def mark(self, tail: str) -> bytes:
        if tail not in self.marks:
            self.marks[tail] = self.whole(tail)
        return self.marks[tail]

    def word(self, lead: str, part: str) -> bytes:
        """A word of Latin letters is one pre-token and goes to the BPE model at once; anything else takes the full way."""
        if part.isalpha() and max(part) < "Ā":
            text = part.lower() if self.lower else part
            if text != part:
                return self.first[text]
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            tokens = self.model.tokenize(self.space + shown if lead else shown)
            return b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return self.whole(lead + part)

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if SPECIAL_MARK in text:
            return self.whole(text)
        try:
            lines = []
            for line in text.split("\n"):
                parts = line.split(" ")
                head = self.first[parts[0]]
                lines.append(head + b"".join(map(self.later.__getitem__, parts[1:])))
            return self.newline.join(lines)
        except Irregular:
            return self.whole(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and tokenizer file."""
    return TextEncoder(path)
