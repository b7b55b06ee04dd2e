"""Which of many literal pieces a text holds, and its cleaned text, in one pass over its bytes.

A piece is known by its rarest three bytes: one number per place of a run of texts
tells whether a piece may lie there, and only those places are compared in full.
The cost hardly depends on the number of pieces, where a substring test for each
reads the text once per piece, and a regular expression beside hundreds of tests
falls out of compiled code.  Runs are cut at STEP bytes, so a task holds a few
times that whatever the size of its batches; a longer text is one run.

Defined cases: a null text has null, an empty one no pieces; pieces are compared
byte by byte in UTF-8, as a substring test does; no piece reaches into the next text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Bytes of texts looked at together.
STEP = 1 << 20
#: Bytes that identify a piece; shorter pieces cannot be looked for.
WIDTH = 3
#: Pieces to a word of bits.
BITS = 62
_BASE = 40  # classes of bytes; their triples fit 16 bits
_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
_COMMON = b"etaoinsrhldcumfpgwybvkxjqz"  # from the most frequent letter


def _anchor(piece: bytes) -> int:
    """Place of the piece's rarest three bytes, by the frequency of letters."""
    weight = [len(_COMMON) - _COMMON.index(c) if c in _COMMON else len(_COMMON) if c == 32 else 0 for c in piece]
    return min(range(len(piece) - WIDTH + 1), key=lambda i: (sum(weight[i:i + WIDTH]), i))


class Finder:
    """Finds the given pieces (of WIDTH bytes or more) in texts."""

    def __init__(self, pieces: tuple[str, ...]) -> None:
        self.pieces = [p.encode() for p in pieces]
        anchors = [(p[(at := _anchor(p)):at + WIDTH], at) for p in self.pieces]
        kind = np.zeros(256, np.uint16)
        for i, byte in enumerate(sorted({b for a, _ in anchors for b in a})):
            kind[byte] = 1 + i % (_BASE - 1)
        self.parts = [kind * np.uint16(_BASE ** (WIDTH - 1 - i)) for i in range(WIDTH)]
        self.wanted = np.zeros(1 << 16, bool)
        self.by_code: dict[int, list[tuple[int, bytes, int]]] = {}
        for number, (piece, (anchor, at)) in enumerate(zip(self.pieces, anchors)):
            code = sum(int(part[b]) for part, b in zip(self.parts, anchor))
            self.wanted[code] = True
            self.by_code.setdefault(code, []).append((number, piece, at))

    def _run(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, piece) of every piece a text of the run holds, once, in order; starts has a text's first byte and the end."""
        n = len(data)
        code = self.parts[0][data[:max(n - 2, 0)]]
        code += self.parts[1][data[1:max(n - 1, 1)]]
        code += self.parts[2][data[2:]]
        places = np.flatnonzero(self.wanted[code])
        codes = code[places]
        order = np.argsort(codes, kind="stable")
        places, codes = places[order], codes[order]
        first = np.flatnonzero(np.concatenate([codes[:1] == codes[:1], codes[1:] != codes[:-1]]))
        found = [np.zeros(0, np.int64)]
        for lo, hi in zip(first, [*first[1:], len(codes)]):
            for number, piece, at in self.by_code[int(codes[lo])]:
                start = places[lo:hi] - at
                start = start[(start >= 0) & (start + len(piece) <= n)]
                for i, byte in enumerate(piece):
                    start = start[data[start + i] == byte]
                text = np.searchsorted(starts, start, "right") - 1
                text = text[start + len(piece) <= starts[text + 1]]
                found.append(text * len(self.pieces) + number)
        return np.divmod(np.unique(np.concatenate(found)), len(self.pieces))

    def look(self, texts: pa.Array) -> pa.StructArray:
        """A word of bits for every BITS pieces and the cleaned text; null for a null text."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        content = texts.buffers()[2]
        data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
        words = np.zeros((len(word_names(self.pieces)), len(texts)), np.int64)
        parts, sizes, at = [np.zeros(0, np.uint8)], np.zeros(len(texts) + 1, np.int64), 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1)
            run, starts = data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            text, number = self._run(run, starts)
            np.add.at(words, (number // BITS, at + text), np.int64(1) << number % BITS)
            part, sizes[at + 1:end + 1] = cleaned(run, starts)
            parts.append(part)
            at = end
        whole = pa.LargeStringArray.from_buffers(
            len(texts), pa.py_buffer(np.cumsum(sizes)), pa.py_buffer(np.concatenate(parts))).cast(pa.string())
        return pa.StructArray.from_arrays([*map(pa.array, words), whole], [*word_names(self.pieces), "cleaned"],
                                          mask=texts.is_null())


def cleaned(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A run of lower-cased texts in which every stretch outside a-z and 0-9 is one space, none at a text's ends,
    and the bytes that each text keeps."""
    word = _WORD[data]
    space = ~word
    space[:-1] &= word[1:]  # the last of a stretch, before a word
    first = np.append(np.flatnonzero(word), len(data))
    space[-1:] = False
    inner = starts[1:-1]
    space[inner[inner > 0] - 1] = False  # the next word is another text's
    lead = first[np.searchsorted(first, starts[:-1])] - 1  # before a text's first word
    space[lead[(lead >= starts[:-1]) & (lead < starts[1:])]] = False
    kept = word | space
    count = np.concatenate([[0], np.cumsum(kept)])[starts]
    return np.where(space, np.uint8(32), data)[kept], np.diff(count)


def word_names(pieces) -> list[str]:
    return [f"w{i}" for i in range(-(-len(pieces) // BITS))]


def look(text: Column, pieces: tuple[str, ...]) -> Column:
    """Struct of the bits of the pieces that a lower-cased text holds (`bits` tests them), and `cleaned`."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(pieces)
        for texts in batches:
            yield finder.look(texts)

    fields = [*(f"{w}: bigint" for w in word_names(pieces)), "cleaned: string"]
    return F.arrow_udf(run, f"struct<{', '.join(fields)}>")(text)


def bits(looked: Column, numbers: list[int]) -> Column:
    """Whether a text holds any of the pieces of these numbers."""
    test = None
    for word in sorted({n // BITS for n in numbers}):
        mask = sum(1 << n % BITS for n in set(numbers) if n // BITS == word)
        hit = looked[f"w{word}"].bitwiseAND(F.lit(mask).cast("bigint")) != 0
        test = hit if test is None else test | hit
    return test
