"""Token ids of long texts at low cost, equal to those of the tokenizer itself.

The tokenizer drops white space and never joins what stands on both sides of a space
or line break, so a text's ids are those of its parts one after the other. Stretches of
printable ASCII and Latin-1 letters are lowered and split into pre-tokens here, and the
model runs once per new pre-token; chunks with other characters go through the whole
tokenizer. The memory of pre-tokens is bounded and starts over when full.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: The vocabulary's split on characters that need no normalisation, and those characters.
PRE_TOKENS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
PLAIN_BYTES = (range(33, 127), range(161, 173), range(174, 256))

STRETCH = 1 << 20
MEMORY = 600_000
LONGEST_KEPT = 40


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte in byte-level vocabularies."""
    plain = {b for part in PLAIN_BYTES for b in part}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class WordTokenizer:
    """Ids of texts for a lower-case vocabulary with word ends (the file ``word_bpe_49k.json``).

    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        known = self.words.get
        return b"".join([known(w) or self.word(w) for w in PRE_TOKENS.findall(text.lower())])

    def mixed(self, text: str) -> bytes:
        return b"".join([
            self.plain(chunk) if PLAIN.fullmatch(chunk)
            else array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()
            for chunk in text.replace("\n", " ").split(" ")
        ])

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text as unsigned 32-bit numbers."""
        parts = [self.plain(s) if PLAIN.fullmatch(s) else self.mixed(s) for s in stretches(text)]
        return np.frombuffer(b"".join(parts), dtype=np.uint32)


#: The byte-level vocabulary's split of texts of ASCII and Latin-1 letters.
SPACED = re.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9À-ÖØ-öø-ÿ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
SIMPLE = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*")
#: A single space always opens a pre-token, so a text may be cut in front of it.
CUT = re.compile(r"(?<=\S)(?= \S)")


class ByteTokenizer(WordTokenizer):
    """Ids of texts for a byte-level vocabulary that keeps white space (the file ``byte_bpe_50k.json``).

    Texts of ASCII and Latin-1 letters are split into pre-tokens here; parts with other characters go
    through the whole tokenizer.
    """

    def word(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        known = self.words.get
        return b"".join([known(w) or self.word(w) for w in SPACED.findall(text)])

    def mixed(self, text: str) -> bytes:
        return b"".join([
            self.plain(part) if SIMPLE.fullmatch(part)
            else array("I", self.whole.encode(part, add_special_tokens=False).ids).tobytes()
            for part in CUT.split(text)
        ])

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text as unsigned 32-bit numbers."""
        parts, begin = [], 0
        while begin < len(text):
            place = CUT.search(text, begin + STRETCH)
            end = place.start() if place else len(text)
            part = text[begin:end]
            parts.append(self.plain(part) if SIMPLE.fullmatch(part) else self.mixed(part))
            begin = end
        return np.frombuffer(b"".join(parts), dtype=np.uint32)


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer for each Python worker, with its memory of pre-tokens."""
    return ByteTokenizer(path)


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about ``STRETCH`` characters, cut at spaces."""
    begin = 0
    while begin < len(text):
        end = begin + STRETCH
        if end < len(text):
            space = text.find(" ", end)
            end = len(text) if space < 0 else space
        yield text[begin:end]
        begin = end + 1


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, with its memory of words."""
    return WordTokenizer(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
