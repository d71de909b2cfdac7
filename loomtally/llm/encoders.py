"""Encoding by a tokenizer file of the tokenizers library, with a cache bounded in bytes.

Both byte-level vocabularies cut a text before they merge: no merge crosses a
single space or line feed that stands between two characters that are not white
space. A text is cut there, each distinct word is encoded once by the library
and the ids are strung together, so that a known word costs a dictionary look-up.
Texts with other white space are cut only where that is safe, and what is left
together goes to the library as it is. Words of over LONGEST characters are never kept.
"""

from __future__ import annotations

import gc
import json
import os
from array import array
from collections.abc import Callable, Sequence

from loomtally.session import release_memory

#: Bytes of words and ids in a generation, of all tables of an encoder together (two generations each): a
#: full generation becomes the old one, of which the words still in use move to the next.
CACHE_BYTES = 80 << 20
#: Bytes that a word and its ids take besides their own (headers and a place in the table).
ENTRY = 190
#: Longest word that is kept; a longer one is encoded each time.
LONGEST = 64
#: White space other than the space and the line feed, as the vocabularies' patterns and str.split know it.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


class Room:
    """Bytes that tables share, with an estimate for each word and its ids: their own and ENTRY."""

    def __init__(self, size: int):
        self.size = self.left = size
        self.tables: list[Generations] = []

    def turn(self) -> None:
        """What the tables hold becomes their old generation."""
        for t in self.tables:
            t.old = dict(t)
            t.clear()
        self.left = self.size


class Generations(dict):
    """A table that makes what it lacks, bounded in bytes: a full generation becomes the old
    one, of which what is still asked for moves to the next."""

    def __init__(self, make: Callable[[str], bytes], room: Room):
        super().__init__()
        self.make, self.room, self.old = make, room, {}
        room.tables.append(self)

    def __missing__(self, word: str) -> bytes:
        found = self.old.pop(word, None) or self.make(word)
        if len(word) <= LONGEST:
            self.room.left -= 2 * len(word) + len(found) + ENTRY
            if self.room.left < 0:
                self.room.turn()
            self[word] = found
        return found


class WordCache(Generations):
    """word -> ids as little-endian unsigned 32-bit integers. before: what stands
    before the word where it is encoded; lower: the vocabulary folds case."""

    def __init__(self, tokenizer, merge: Callable[[bytes], list[int]] | None, before: str, lower: bool, room: Room):
        super().__init__(self.made, room)
        self.tokenizer, self.model, self.merge, self.before, self.lower = tokenizer, tokenizer.model, merge, before, lower
        self.lead = before.translate(_LETTERS)
        self.marks = {m: self.whole(m) for m in ",."}

    def made(self, word: str) -> bytes:
        core, mark = word, b""
        if word[-1] in self.marks and word[:-1].isalpha():
            # a comma or full stop behind letters is a unit of its own
            core, mark = word[:-1], self.marks[word[-1]]
            if core in self:
                return self[core] + mark
        return (self.letters(core) if core.isalpha() else self.whole(self.before + core)) + mark

    def letters(self, word: str) -> bytes:
        """Latin letters are one unit, which the model can merge without the library's
        normalizing and cutting (most of its time)."""
        ascii_only = word.isascii()
        if not ascii_only:
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                return self.whole(self.before + word)
        if self.lower:
            word = word.lower()
        if self.merge is not None:
            return array("I", self.merge((self.before + word).encode())).tobytes()
        # ASCII letters stand for themselves
        data = self.lead + word if ascii_only else (self.before + word).encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(data)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def ranked_merges(path: str) -> Callable[[bytes], list[int]] | None:
    """Merging of a unit's bytes by ranks (tiktoken's, of less than half the library's cost), for a
    byte-level file whose ids stand in the order of its merges; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    byte_of = {letter: value for value, letter in _LETTERS.items()}
    if model.get("end_of_word_suffix") or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    units = [*byte_of, *(a + b for a, b in merges)]
    ranks = {bytes(byte_of[c] for c in unit): vocabulary[unit] for unit in units}
    return tiktoken.Encoding("merges", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordEncoder:
    """path: a tokenizer file. encode(texts) gives each text's ids as little-endian
    unsigned 32-bit integers. spaced: the vocabulary encodes the space before a word
    (else white space is dropped and letters are lower-cased). Special tokens'
    strings in a text are ordinary text; null is the empty text."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        room, merge = Room(CACHE_BYTES), ranked_merges(path) if spaced else None
        self.bare = WordCache(self.tokenizer, merge, "", not spaced, room)
        self.after_space = WordCache(self.tokenizer, merge, " ", False, room) if spaced else self.bare
        self.feed = self.bare.whole("\n")

    def encode(self, texts: Sequence[str | None], lead: bool = False) -> list[bytes]:
        """lead: as if a space stood before each text (spaced vocabularies)."""
        bare, after = self.bare, self.after_space
        first = after if lead else bare
        word, out = after.__getitem__, []
        for text in texts:
            lines = self._lines(text)
            if self.spaced:
                out.append(self.feed.join([b"".join([(bare if at else first)[line[0]], *map(word, line[1:])]) for at, line in enumerate(lines)]))
            else:
                out.append(b"".join([b"".join(map(word, line)) for line in lines]))
        return out

    def _lines(self, text: str | None) -> list[list[str]]:
        """The text's words by line. A line that can't be cut at spaces is one word."""
        if not text:
            return []
        if not self.spaced:
            if text.isascii() and not any(c in text for c in OTHER_SPACE[:8]):
                return [text.lower().split()]  # the vocabulary lowers ASCII letters alike
            return [w for line in text.split("\n") if (w := [x for x in line.split(" ") if x])]
        lines = [line.split(" ") for line in text.split("\n")]
        if all(map(all, lines)) and not any(c in text for c in (OTHER_SPACE[:8] if text.isascii() else OTHER_SPACE)):
            return lines
        return [[text]]  # white space that may stand together with other: the library cuts it


_KEPT: dict[tuple, object] = {}


def held(key: tuple, make):
    """What the worker keeps under the key, between tasks that reuse the worker; made at first."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def encoder(path: str, spaced: bool) -> WordEncoder:
    """The worker's encoder for a file."""
    return held((path, spaced), lambda: WordEncoder(path, spaced))


def forget() -> None:
    """Drop the worker's encoders and models: for tasks that need none, in a worker that has run others."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # tables know each other
        release_memory()
