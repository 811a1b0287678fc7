"""Ids of whole texts by a given vocabulary file of the tokenizers library.

Both kinds of vocabulary cut a text into pre-tokens that never reach across the
segments used here, so the ids of a text are those of its segments in a row. Most
segments recur; a memo of bounded bytes holds the ids of the latest. The library is
asked for a new segment: by its model alone where a segment is plain Latin letters
and perhaps punctuation, with all its steps otherwise.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

from promptloom.llm.common import kept

MEMO_BYTES = 64 << 20
LONGEST_KEPT = 32  # characters of a segment that is remembered

# plain letters, then nothing or something that starts with ASCII punctuation
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)((?:[!-/:-@\[-`{-~].*)?)", re.S)
# plain letters and ASCII punctuation
_ENDED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
# segments that no pre-token of a byte-level vocabulary crosses
_SEGMENTS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# white space for Python only, so segments could differ from the library's
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SegmentIds(dict):
    """Little-endian 32-bit ids of a segment, worked out when it is first seen.

    ``core(letters)`` encodes plain Latin letters, perhaps after a space, and
    ``whole(text)`` anything. Long segments are not kept. What has been asked for since
    the memo was last half full stays when the other half goes.
    """

    def __init__(
        self,
        core: Callable[[str], bytes],
        whole: Callable[[str], bytes],
        lower: bool = False,
        memo_bytes: int = MEMO_BYTES,
    ) -> None:
        super().__init__()
        self.half = memo_bytes // 2
        self.core, self.whole, self.lower = core, whole, lower
        self.before: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, segment: str) -> bytes:
        made = self.before.get(segment)
        if made is None:
            plain = _PLAIN.fullmatch(segment)
            if plain:
                word, rest = plain.groups()
                small = word.lower() if self.lower else word
                if rest or small != word:
                    known = small in self
                    made = self[small] + self[rest] if rest else self[small]
                    if not known:
                        # a new word is kept, what it first stood in is not
                        return made
                else:
                    made = self.core(word)
            else:
                made = self.whole(segment)
        self.keep(segment, made)
        return made

    def keep(self, segment: str, made: bytes) -> None:
        if len(segment) <= LONGEST_KEPT:
            self.held += 150 + len(segment) + len(made)
            if self.held > self.half:
                self.before = dict(self)
                self.clear()
                self.held = 0
            self[segment] = made

    def encode(self, text: str, cut: Callable[[str], list[str]] = _SEGMENTS.findall) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, cut(text)))


class Apart(Exception):
    """A text that can't be cut at its spaces alone."""


class SpacedIds(SegmentIds):
    """Ids of a space and what follows it up to the next space, by the latter alone.

    Cutting at single spaces gives the segments, as white space before one never joins
    it, unless the space is followed by white space or a text holds what Python alone
    takes for white space: then ``Apart`` is raised. ``others`` has the segments without a space.
    """

    def __init__(
        self, core: Callable[[str], bytes], others: SegmentIds, memo_bytes: int = MEMO_BYTES
    ) -> None:
        super().__init__(core, others.whole, memo_bytes=memo_bytes)
        self.others = others

    def __missing__(self, word: str) -> bytes:
        made = self.before.get(word)
        if made is None:
            if word.isascii() and word.isalpha():
                made = self.core(word)
            elif ended := _ENDED.fullmatch(word):
                head, rest = ended.groups()
                made = self.get(head)
                if made is None:
                    # a new word is kept, what it first stood in is not
                    return self[head] + self.others[rest]
                made += self.others[rest]
            elif not word or word[0].isspace() or _ODD.search(word):
                raise Apart
            elif len(word.split()) > 1 or word[-1].isspace():
                first, *after = _SEGMENTS.findall(word)
                return self[first] + b"".join(map(self.others.__getitem__, after))
            elif plain := _PLAIN.fullmatch(word):
                made = self[plain[1]] + self.others[plain[2]] if plain[2] else self.core(word)
            else:
                made = self.whole(" " + word)
        self.keep(word, made)
        return made


def packed(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def encoder(
    path: str, added: bool = False, memo_bytes: int = MEMO_BYTES
) -> Callable[[str], bytes]:
    """``encode(text)``: the ids as bytes.

    The strings of added tokens (``<|endoftext|>``) are plain text, or with ``added``
    the tokens they name, as by the library's ``encode(text, add_special_tokens=False)``;
    a text that holds one then goes through the library whole.

    For a vocabulary that drops white space and lowers case (its model marks word
    ends) segments are words; for a byte-level one a word keeps the space before it, and
    most texts can be cut at their spaces.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    named = list(tokenizer.get_added_tokens_decoder().values()) if added else []
    # what is matched in normalized text could stand in any text
    strings = ["" if t.normalized else re.escape(t.content) for t in named]
    holds = re.compile("|".join(strings)).search if strings else lambda text: None
    model, letters = tokenizer.model, byte_letters()
    by_words = bool(getattr(model, "end_of_word_suffix", None))

    def core(word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(letters)
        return packed([t.id for t in model.tokenize(mapped)])

    def whole(text: str) -> bytes:
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    if by_words:
        known = SegmentIds(core, whole, True, memo_bytes)
        return lambda text: whole(text) if holds(text) else known.encode(text, str.split)

    blank = letters[32]

    def spaced(word: str) -> bytes:
        if not word.isascii():
            return core(" " + word)
        return packed([t.id for t in model.tokenize(blank + word)])

    others = SegmentIds(core, whole, memo_bytes=memo_bytes // 8)
    words = SpacedIds(spaced, others, memo_bytes)

    def encode(text: str) -> bytes:
        if holds(text):
            return whole(text)
        first, *rest = text.split(" ")
        if _ODD.search(first):
            return whole(text)
        try:
            return others.encode(first) + b"".join(map(words.__getitem__, rest))
        except Apart:
            return others.encode(text)

    return encode


def worker_encoder(path: str, memo_bytes: int = MEMO_BYTES) -> Callable[[str], bytes]:
    """``encoder(path, added=True)`` with the memo of earlier tasks on this worker and file."""
    about = os.stat(path)
    key = ("encoder", path, about.st_mtime_ns, about.st_size, memo_bytes)
    return kept(key, lambda: encoder(path, added=True, memo_bytes=memo_bytes))
