"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalized (a space in front, spaces as U+2581) and its code points become
symbols in a row. An agenda holds every adjacent pair whose joined string is a piece, best
score first and leftmost among equals; the best pair that still stands is merged and the
two pairs it forms with its neighbours join the agenda, until none is left. Symbols that
are no piece become the pieces of their bytes. A merge never crosses two code points that
stand side by side in no piece of the vocabulary, so a text is cut there (before spaces,
around line feeds, in front of punctuation) and each distinct word passes the agenda once.

Decoding joins the pieces' bytes, gives runs of byte pieces back as text (each byte that
is no UTF-8 as U+FFFD) and takes the space in front away.

In every Arrow batch the library sentencepiece encodes all that has passed the agenda (each
word, run of spaces with its word or other part that was cut) and decodes all texts; a
difference raises ValueError. With whole_texts it encodes each text as a whole too, which
costs more than the agenda itself.

Defined results: a null or empty text has the end id alone and decodes to ''; rows that
repeat are encoded each; null ids are kept; an empty table gives no rows; extra columns
are ignored. Special pieces' strings inside a text are ordinary text. A model with
another algorithm, a table of character rules, user-defined or unused pieces or without
byte pieces raises ValueError.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomtally.llm.encoders import CACHE_BYTES, Generations, Room, held

SPACE = "▁"
#: Bytes of text whose ids are held at a time.
SLICE_BYTES = 1 << 20


class PieceModel:
    """A sentencepiece model file of merge type: encode and decode by the agenda."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as spec

        proto = spec.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = spec.ModelProto.SentencePiece
        types = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != spec.TrainerSpec.BPE or kind.BYTE not in types:
            raise ValueError("the model is not of merge type with byte pieces")
        rules = proto.normalizer_spec
        if types & {kind.USER_DEFINED, kind.UNUSED} or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model has user-defined or unused pieces or character rules")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefixed = rules.add_dummy_prefix
        self.end_id = self.library.eos_id()
        #: piece -> id, and its key in the agenda; equal scores have equal keys
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.keys = {p: -proto.pieces[i].score for p, i in self.pieces.items()}
        self.byte_ids = [0] * 256
        #: what an id stands for when decoded; control pieces are silent
        self.surface = [b""] * len(proto.pieces)
        self.leads = np.zeros(len(proto.pieces), dtype=bool)
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            elif p.type == kind.UNKNOWN:
                self.surface[i] = proto.trainer_spec.unk_surface.encode()
            elif p.type == kind.NORMAL:
                self.surface[i], self.leads[i] = p.piece.replace(SPACE, " ").encode(), p.piece[0] == SPACE
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL}
        #: code points that stand side by side in some piece: only these can be merged across
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.cut_before_space = not any(a != SPACE and b == SPACE for a, b in self.joined)
        self.feed_alone = not any("\n" in j for j in self.joined)
        room = Room(CACHE_BYTES)
        self.spaced = Generations(lambda w: self._made(SPACE, w, self.spaced), room)
        self.bare = Generations(lambda w: self._made("", w, self.bare), room)
        #: (normalized text, ids) of what has passed the agenda, where it is kept for a check
        self.passed: list[tuple[str, bytes]] | None = None
        self.feed = self.agenda("\n")

    def agenda(self, text: str) -> bytes:
        """ids of a normalized text, as little-endian signed 32-bit integers."""
        keys, symbols = self.keys, list(text)
        n = len(symbols)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(keys[both], i, both) for i, both in enumerate(map(add, text, text[1:])) if both in keys]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] + symbols[j] != both or not symbols[i]:
                continue  # one of the two has been merged with another
            symbols[i], symbols[j] = both, ""
            k = after[i] = after[j]
            if k < n:
                ahead[k] = i
                right = both + symbols[k]
                if right in keys:
                    heappush(heap, (keys[right], i, right))
            k = ahead[i]
            if k >= 0:
                left = symbols[k] + both
                if left in keys:
                    heappush(heap, (keys[left], k, left))
        ids, pieces = [], self.pieces
        for symbol in symbols:
            if symbol in pieces:
                ids.append(pieces[symbol])
            elif symbol:
                ids += [self.byte_ids[b] for b in symbol.encode()]
        made = array("i", ids).tobytes()
        if self.passed is not None:
            self.passed.append((text, made))
        return made

    def _made(self, lead: str, word: str, table: Generations) -> bytes:
        """ids of lead + word; a last mark that joins no letter is cut off, so that the word
        is found without it."""
        if len(word) > 1 and word[-2:] not in self.joined:
            return table[word[:-1]] + self.bare[word[-1]]
        return self.agenda(lead + word)

    def encode(self, text: str | None) -> bytes:
        """ids without the end id, as little-endian signed 32-bit integers."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        if not self.cut_before_space:
            return self.agenda(((" " if self.prefixed else "") + text).replace(" ", SPACE))
        spaced, bare, out = self.spaced.__getitem__, self.bare, []
        lines = text.split("\n") if self.feed_alone else [text]
        for at, line in enumerate(lines):
            words = line.split(" ")
            lead = self.prefixed and not at  # a space stands before the first word
            if all(words):
                out.append(b"".join(map(spaced, words)) if lead else bare[words[0]] + b"".join(map(spaced, words[1:])))
            elif line or lead:
                out.append(self._runs(line, lead))
            else:
                out.append(b"")
        return self.feed.join(out)

    def _runs(self, line: str, lead: bool) -> bytes:
        """A line with spaces at its ends or side by side: a run of spaces stays with its word."""
        out, run = [], SPACE if lead else ""
        for at, word in enumerate(line.split(" ")):
            run += SPACE if at else ""
            if word:
                out.append(self.spaced[word] if run == SPACE else self.agenda(run + word) if run else self.bare[word])
                run = ""
        return b"".join(out) + (self.agenda(run) if run else b"")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids."""
        surface = list(map(self.surface.__getitem__, ids))
        if self.prefixed:
            first = next((i for i, token in enumerate(ids) if token not in self.silent), None)
            if first is not None and self.leads[ids[first]]:
                surface[first] = surface[first][1:]
        try:
            if self.silent.isdisjoint(ids[:-1]):
                return b"".join(surface).decode()
        except UnicodeDecodeError:  # byte pieces that are no UTF-8
            pass
        # a silent piece ends a run of bytes
        runs: list[list[bytes]] = [[]]
        for token, part in zip(ids, surface, strict=True):
            if token in self.silent:
                runs.append([])
            runs[-1].append(part)
        return "".join(_each_byte(b"".join(run)) for run in runs)


def _each_byte(data: bytes) -> str:
    """data as text, every byte that belongs to no code point as U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


def model(path: str) -> PieceModel:
    """The worker's model for a file; kept between tasks that reuse the worker."""
    return held((path,), lambda: PieceModel(path))


def slices(sizes: Sequence[int], room: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of at most `room` bytes together, one row at least."""
    first, held = 0, 0
    for at, size in enumerate(sizes):
        if at > first and held + size > room:
            yield first, at
            first, held = at, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def id_lists(encoded: Sequence[bytes]) -> pa.ListArray:
    """Lists of 32-bit ids, from their bytes."""
    ends = np.cumsum([0] + [len(x) // 4 for x in encoded]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_texts(docs: DataFrame, path: str, whole_texts: bool = False) -> DataFrame:
    """doc_id, ids (with the end id), decoded of every row of docs (doc_id, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model(path)
        end = np.array([made.end_id], dtype="<i4").tobytes()
        made.passed = []
        try:
            for batch in batches:
                texts = batch.column("text")
                sizes = [x or 0 for x in pc.binary_length(texts).to_pylist()]
                for first, stop in slices(sizes, SLICE_BYTES):
                    part = [x or "" for x in texts.slice(first, stop - first).to_pylist()]
                    encoded = [made.encode(x) + end for x in part]
                    listed = [array("i", x).tolist() for x in encoded]
                    decoded = [made.decode(x) for x in listed]
                    check_parts(made)
                    check(made, part if whole_texts else None, listed, decoded)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, stop - first), id_lists(encoded), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"]
                    )
        finally:
            made.passed = None

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def check_parts(made: PieceModel) -> None:
    """Raise ValueError where the library encodes what has passed the agenda otherwise, and forget it."""
    led, bare = [], []
    for part in made.passed:  # the library puts a space in front, but not of nothing
        (led if made.prefixed and part[0][0] == SPACE != part[0] else bare).append(part)
    mark = made.library.encode("\n")  # joins with nothing
    for parts, front, skip in ((led, "", 0), (bare, "\n", len(mark))):
        texts = [front + text if front else text[1:] for text, _ in parts]
        for (text, ids), theirs in zip(parts, made.library.encode(texts, num_threads=1), strict=True):
            if array("i", ids).tolist() != theirs[skip:]:
                raise ValueError(f"the library gives other ids for {text[:80]!r}")
    made.passed.clear()


def check(made: PieceModel, texts: Sequence[str] | None, ids: Sequence[list[int]], decoded: Sequence[str]) -> None:
    """Raise ValueError where the library encodes the texts or decodes the ids otherwise."""
    if texts is not None and made.library.encode(list(texts), add_eos=True, num_threads=1) != list(ids):
        raise ValueError("the library gives other ids")
    if made.library.decode(list(ids), num_threads=1) != list(decoded):
        raise ValueError("the library decodes to other texts")
