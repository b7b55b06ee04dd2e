"""Vector bin packing of token sequences (free style: numpy inside tasks, no shuffle).

An example has three sizes: tokens, one segment, and the loss-bearing tokens at
its end.  A sequence has a limit on each.  From a bounded pool of waiting
examples, the one whose sizes have the largest dot product with the sequence's
free space (both as shares of the limits) is placed, until none fits; then the
free space is filled with the start of a waiting example, whose rest waits on.
Every task packs the rows of its own partition, so its sequences depend on these
rows alone and a lost executor's task gives the same sequences again.

Defined cases: a null or empty text is the end-of-text id alone; repeated rows
are packed each on its own; null ids pass through; an empty table gives an empty
result; very long texts are cut into many pieces; of equal dot products the example
first in the pool is placed; other columns are ignored.
"""

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from advisoryspark.llm.common import each_step, texts

#: Examples that wait at a time in a task.
POOL = 1024
#: Free space of fewer tokens is padded rather than filled with a cut piece.
LEAST_CUT = 8
#: Distinct pieces whose ids a Python worker keeps.
KEPT_PIECES = 200_000
#: Words of these characters are cut by the pattern below, which is the tokenizer's with its classes of letters and
#: numbers written out for them; all other words are cut by the tokenizer.
_LATIN = re.compile(r"[\n\x20-\x7e\xa1-\u024f]*").fullmatch
_LETTERS, _NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+"
                     r"|\s+(?!\S)|\s+").findall
#: The same pattern as written in the tokenizer's files, and the texts it is used for: of the characters above.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = r"^[\n\x20-\x7e\x{a1}-\x{24f}]*$"
#: Text with white space that is not single spaces between words is encoded whole.
_WIDE_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}] (?:[\s\x1c-\x1f\x{85}\p{Z}]|$)"


def byte_spelling() -> dict[str, str]:
    """The printable character that stands for each byte (as a Latin-1 character) in byte-level vocabularies: itself
    where it is printable there, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(b): chr(0x100 + k) for k, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class WordEncoder:
    """Token ids of texts, exactly as the tokenizer gives them for the whole text.

    Most texts are encoded whole by ranked merges of the same vocabulary, where its
    ids are in the order of its merges (checked).  For others: byte-level BPE never
    merges across the space before a word, so a text is the sequence of its words
    with that space.  A distinct word is cut into the tokenizer's pieces, and each
    distinct piece is merged once.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.cut, self.merge = self.whole.pre_tokenizer.pre_tokenize_str, self.whole.model.tokenize
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.spelling = byte_spelling()
        self.known: dict[str, bytes] = {}
        self.ranked = self._ranked()
        self.spelling = str.maketrans(self.spelling)

    def _ranked(self) -> tiktoken.Encoding | None:
        """Encoder by ranks, if the file is a plain byte-level vocabulary: bytes, then merges in order, then special tokens."""
        told = json.loads(self.whole.to_str())
        model, cut = told["model"], told["pre_tokenizer"] or {}
        byte = {ord(mark): char.encode("latin-1") for char, mark in self.spelling.items()}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        first = [t for t, i in sorted(model["vocab"].items(), key=lambda x: x[1]) if i < 256]
        ordinary = [*first, *merged]
        if (told["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)
                or model.get("dropout") or model.get("ignore_merges") or sorted(map(ord, first)) != sorted(byte)
                or any(model["vocab"][t] != i for i, t in enumerate(ordinary))):
            return None
        ranks = {b"".join(byte[ord(c)] for c in token): i for i, token in enumerate(ordinary)}
        return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def piece(self, text: str) -> bytes:
        spelled = text if text.isascii() else text.encode().decode("latin-1")
        return _packed([t.id for t in self.merge(spelled.translate(self.spelling))])

    def word(self, text: str) -> bytes:
        """Ids of a word as packed 32-bit integers, which cost a tenth of a list of them."""
        if not _LATIN(text):
            return _packed([t.id for piece, _ in self.cut(text) for t in self.merge(piece)])
        known, out = self.known, []
        for piece in _PIECES(text):
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self.piece(piece)
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def words(self, distinct: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        # Most words are one piece, and a piece met before needs no cutting.
        spaced = [" " + text for text in distinct]
        return [self.word(text) if ids is None else ids for text, ids in zip(spaced, map(self.known.get, spaced))]

    def encode(self, column: pa.Array, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places where the texts start (and the end), and all ids, each text closed by `end_id`."""
        column = column.cast(pa.binary()).cast(pa.string())
        if self.ranked is None:
            return self._by_word(column, end_id)
        plain = pc.match_substring_regex(column, _PLAIN)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(column, token))
        end, out = _packed([end_id]), [b""] * len(column)
        which = plain.to_numpy(zero_copy_only=False)
        for i, text in zip(np.flatnonzero(which).tolist(), column.filter(plain).to_pylist()):
            out[i] = _packed(self.ranked.encode_ordinary(text)) + end
        if not which.all():
            starts, ids = self._by_word(column.filter(pc.invert(plain)), end_id)
            for i, x, y in zip(np.flatnonzero(~which).tolist(), starts[:-1].tolist(), starts[1:].tolist()):
                out[i] = ids[x:y].tobytes()
        sizes = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(out), np.int32)

    def _by_word(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(column, _WIDE_SPACE).to_numpy(zero_copy_only=False)
        for token in self.special:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", column), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat = split.flatten()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        word_ids = self.words(coded.dictionary.to_pylist())
        # The first word of a text has no space before it; texts to encode whole are one such entry.
        first = flat.take(pa.array(offsets[:-1])).to_pylist()
        for i in np.flatnonzero(whole).tolist():
            first[i] = None
        own = [_packed(self.whole.encode(column[i].as_py(), add_special_tokens=False).ids) if text is None
               else self.word(text) for i, text in enumerate(first)]
        table = [*word_ids, *own, _packed([end_id])]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        ids = np.frombuffer(b"".join(table), np.int32)
        at = np.concatenate([[0], np.cumsum(sizes)])
        # Entry numbers in text order, with the end id behind each text.
        n = len(first)
        entries = np.empty(len(codes) + n, np.int64)
        place = np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(offsets))
        entries[place] = codes
        entries[offsets[:-1] + np.arange(n)] = len(word_ids) + np.arange(n)
        ends = offsets[1:] + np.arange(n)
        entries[ends] = len(table) - 1
        lengths = sizes[entries]
        total = np.concatenate([[0], np.cumsum(lengths)])
        out = ids[np.repeat(at[entries] - total[:-1], lengths) + np.arange(total[-1])]
        return np.concatenate([[0], total[ends + 1]]), out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = 0) -> DataFrame:
    """Examples (id, ids as little-endian 32-bit binary, n_loss): all ids of a document bear loss."""
    narrow = docs.select(F.col(id_col).alias("id"), texts(text_col).alias("text"))
    schema = narrow.select("id", F.col("text").alias("ids"), F.lit(0).cast("long").alias("n_loss")).schema
    return narrow.mapInArrow(lambda batches: _encoded(batches, tokenizer_path, end_id), schema)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    def encode(batch):
        starts, ids = encoder(tokenizer_path).encode(batch.column("text"), end_id)
        raw = ids.astype("<u4").tobytes()
        return pa.record_batch([
            batch.column("id"), pa.array([raw[4 * a:4 * b] for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
            pa.array(np.diff(starts))], names=["id", "ids", "n_loss"])

    # Slices of few rows: the ids of a step take several times its text.
    thin = (batch.slice(at, 1000) for batch in batches for at in range(0, batch.num_rows, 1000))
    return each_step(thin, "text", encode)


class Packer:
    """Packs examples (key, ids as binary, n_loss) given one after the other."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first_sequence: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.next_sequence = first_sequence
        self.pool: list[tuple] = []  # (key, ids, tokens placed before, tokens of the whole example)
        self.sizes = np.zeros((POOL, 3))
        self.out: list[tuple] = []

    def add(self, key, ids: bytes, n_loss: int):
        """Take an example; what fills a sequence by itself is placed at once."""
        whole, most_loss, total, at = int(self.limits[0]), int(self.limits[2]), len(ids) // 4, 0
        bare = total - min(n_loss, total)  # tokens before those that bear loss
        while total - at >= whole or total - max(at, bare) > most_loss:
            head = min(whole, total - at, max(0, bare - at) + most_loss)
            self._place(key, ids, at, head, total, self.next_sequence, 0)
            self.next_sequence += 1
            at += head
        if at < total:
            if len(self.pool) == POOL:
                self.fill()
            self.sizes[len(self.pool)] = total - at, 1, total - max(at, bare)
            self.pool.append((key, ids, at, total))

    def _place(self, key, ids, start, length, total, sequence, offset):
        self.out.append((key, start, length, ids[4 * start:4 * (start + length)], total, sequence, offset))

    def _take(self, k: int):
        """Remove place `k` of the pool; the last one moves there."""
        item = self.pool[k]
        last = self.pool.pop()
        if k < len(self.pool):
            self.pool[k] = last
            self.sizes[k] = self.sizes[len(self.pool)]
        return item

    def fill(self):
        """Pack one sequence from the pool."""
        free, offset, sequence = self.limits.copy(), 0, self.next_sequence
        self.next_sequence += 1
        while self.pool:
            sizes = self.sizes[:len(self.pool)]
            score = (sizes / self.limits) @ (free / self.limits)
            score[(sizes > free).any(axis=1)] = -1
            k = int(score.argmax())
            if score[k] >= 0:
                size = self.sizes[k].copy()
                key, ids, start, total = self._take(k)
                self._place(key, ids, start, total - start, total, sequence, offset)
                free -= size
                offset += int(size[0])
                if free[0] < 1 or free[1] < 1:
                    return
                continue
            k = int(sizes[:, 0].argmax())
            tokens, loss = sizes[k, 0], sizes[k, 2]
            head = int(min(free[0], tokens - loss + free[2], tokens - 1))
            if free[1] < 1 or head < LEAST_CUT:
                return
            key, ids, start, total = self.pool[k]
            self._place(key, ids, start, head, total, sequence, offset)
            self.sizes[k] = tokens - head, 1, min(loss, tokens - head)
            self.pool[k] = (key, ids, start + head, total)
            return


NAMES = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _packed_pieces(batches: Iterator[pa.RecordBatch], max_tokens: int, max_segments: int,
                   max_loss: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 33)
    kind = None

    def flush():
        rows, packer.out = packer.out, []
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=NAMES)

    for batch in batches:
        kind = batch.schema.field("id").type
        for key, ids, n_loss in zip(*(batch.column(k).to_pylist() for k in ("id", "ids", "n_loss"))):
            packer.add(key, ids, n_loss)
            if len(packer.out) >= 4096:
                yield flush()
    while packer.pool:
        packer.fill()
    if packer.out:
        yield flush()


def _schema(ids: DataFrame):
    long = {name: F.lit(0).cast("long").alias(name) for name in NAMES}
    return ids.select(*(long.get(name) if name not in ("id", "ids") else F.col(name) for name in NAMES)).schema


def pack(examples: DataFrame, max_tokens: int = 1024, max_segments: int = 128,
         max_loss: int | None = None) -> DataFrame:
    """Pieces of the examples (id, ids, n_loss) in sequences under all three limits.

    Returns id, start, length, ids (binary), doc_tokens, sequence_id, offset.  A
    sequence's number is its task's partition and its place there.  A task holds
    one batch of rows and the waiting pool.
    """
    limits = max_tokens, max_segments, max_tokens if max_loss is None else max_loss
    return examples.select("id", "ids", "n_loss").mapInArrow(
        lambda batches: _packed_pieces(batches, *limits), _schema(examples))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 0, max_tokens: int = 1024, max_segments: int = 128,
                   max_loss: int | None = None) -> DataFrame:
    """`pack` of `tokenized` in one pass, so that the ids of an example never leave the task but in its pieces."""
    limits = max_tokens, max_segments, max_tokens if max_loss is None else max_loss
    narrow = docs.select(F.col(id_col).alias("id"), texts(text_col).alias("text"))
    return narrow.mapInArrow(lambda batches: _packed_pieces(_encoded(batches, tokenizer_path, end_id), *limits),
                             _schema(narrow.withColumnRenamed("text", "ids")))
