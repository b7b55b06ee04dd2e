"""Alignment of two tokenizers over whole texts (free style: numpy inside tasks).

Both tokenizers encode a text whole; their tokens must spell the same bytes, a space and the text.  A place where a
token of each ends and a space-marked token of each follows is an anchor.  Anchors split a document into windows of
token ids; a window's alignment depends on its ids alone, so in each run of documents (STEP bytes) the windows are
numbered by their pair of id tuples and each distinct one is aligned once.  Inside a window, places where both tokens
end cut groups, and tokens whose bytes overlap are linked.

The first pass writes the ids, two bytes each where the vocabularies allow, and counts the linked id pairs; the second
reads the ids back and looks the counts up.  The most frequent pairs (HEAD at most) are broadcast; all other links go
out as rows and are joined with their counts, which are small by then, so no pair is a hot key.  The highest count of
each id of B is broadcast too: as many numbers as B has ids.

Defined cases: null and empty texts and texts that one tokenizer does not spell back have no tokens; repeated rows
are aligned each on its own and all count; null ids pass through; ties for an id's highest count all count as best; an
empty table gives an empty result; other columns are ignored.  A very long text makes a numpy step of its own, so a
worker's memory follows the longest text.
"""

import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import each_step, materialize, texts
from advisoryspark.llm.packing import WordEncoder, byte_spelling

#: Bytes of text in a numpy step, words whose ids a worker keeps, pairs it sums up before they go out.
STEP, KEPT_WORDS, OPEN_PAIRS = 2 << 20, 100_000, 1 << 20
#: Pairs whose counts are broadcast at most (16 bytes each).
HEAD = 1 << 20
_LOW = (1 << 32) - 1


class ByteTokens:
    """A: byte-level BPE; its tokens are spelled with one character for each byte."""

    def __init__(self, path: str):
        self.words = WordEncoder(path)
        self.words.whole.encode_special_tokens = True
        byte = {ord(mark): char.encode("latin-1") for char, mark in byte_spelling().items()}
        vocabulary = self.words.whole.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = b"".join(byte.get(ord(c), c.encode()) for c in token)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each text, and where each text starts and the last ends."""
        starts, ids = self.words.encode(pc.binary_join_element_wise("", column.cast(pa.string()), " "))
        closing = starts[1:] - 1
        return starts - np.arange(len(starts)), np.delete(ids, closing)


class PieceTokens:
    """B: sentence pieces.  No piece has a space mark behind another character (checked), so a text of words with
    single spaces is the sequence of its words, each encoded once; other texts are encoded whole."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]
        self.known: dict[str, bytes] = {}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.string())
        if not self.by_word:
            return _flat(self._encoded(column.to_pylist()))
        whole = pc.match_substring_regex(column, "^ |  | $|^$").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", column), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self._encoded(new)))
        table = list(map(self.known.__getitem__, words))
        entries = coded.indices.to_numpy().astype(np.int64)
        if whole.any():  # such a text is the one entry ""; put its own ids there
            own = np.flatnonzero(whole)
            entries[offsets[own]] = len(table) + np.arange(len(own))
            table += self._encoded(column.filter(pa.array(whole)).to_pylist())
        starts, flat = _flat(table)
        sizes = np.diff(starts)[entries]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ends[offsets], flat[np.repeat(starts[entries] - ends[:-1], sizes) + np.arange(ends[-1])]

    def _encoded(self, strings: list[str]) -> list[bytes]:
        """Ids of each string as packed 32-bit integers."""
        return [array("i", x).tobytes() for x in self.model.encode(strings, num_threads=1)] if strings else []


def _flat(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    return np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(packed), np.int32)


@dataclass
class Ends:
    """Tokens of both sides over the same bytes, cut at every place where a token ends."""

    a_end: np.ndarray  # place behind each token
    b_end: np.ndarray
    both: np.ndarray  # for each place, whether tokens of both sides end there
    a_of: np.ndarray  # tokens of the two sides that meet in each piece between neighbouring ends: the links
    b_of: np.ndarray


def ends_of(a_size: np.ndarray, b_size: np.ndarray) -> Ends:
    """Two runs of tokens that spell the same bytes, by the sizes of their tokens.

    Tokens overlap in one piece of text or in none, so each piece is one link."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    total = int(a_end[-1]) if len(a_end) else 0
    in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    in_a[a_end], in_b[b_end] = True, True
    cut = np.flatnonzero(in_a | in_b)
    a_here, b_here = in_a[cut], in_b[cut]
    return Ends(a_end, b_end, in_a & in_b, np.cumsum(a_here) - a_here, np.cumsum(b_here) - b_here)


@dataclass
class Windows:
    """Windows of a run of documents; what depends on ids alone is held once for each distinct window."""

    starts: np.ndarray  # first window of each document, and the end
    code: np.ndarray
    groups: np.ndarray  # number of groups of a distinct window
    text: list[bytes]
    link_starts: np.ndarray
    links: np.ndarray  # id of A << 32 | id of B

    def per_document(self, of_distinct: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_distinct[self.code], dtype=np.int64)])
        return np.diff(total[self.starts])


class Aligner:
    """Both tokenizers and the memo of a worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.marked = [np.array([x[:1] == b" " for x in t.bytes]) for t in (self.a, self.b)]
        self.narrow = [np.dtype("<u2" if len(t.bytes) <= 1 << 16 else "<u4") for t in (self.a, self.b)]
        # Written ids with what may follow them: another of the group, or the end of the group's side.
        self.written = [b"%d%c" % (i, mark) for t, marks in ((self.a, b",|"), (self.b, b",;"))
                        for mark in marks for i in range(len(t.bytes))]

    def tokens(self, column: pa.Array):
        """(starts, ids) of A and of B; documents that either does not spell back are left without tokens."""
        column = column.cast(pa.large_binary())
        wanted = [b" " + x if x else b"" for x in column.to_pylist()]
        out = []
        for tokens, sizes in zip((self.a, self.b), self.sizes):
            starts, ids = tokens.encode(column)
            size = np.diff(np.concatenate([[0], np.cumsum(sizes[ids])])[starts])
            spelled = b"".join(map(tokens.bytes.__getitem__, ids.tolist()))
            out.append((starts, ids, size, spelled))
        good = np.array([len(x) > 0 for x in wanted], bool)
        for _, _, size, spelled in out:
            ends = np.cumsum(size)
            good &= [spelled[e - s:e] == x for e, s, x in zip(ends.tolist(), size.tolist(), wanted)]
        kept = []
        for starts, ids, _, _ in out:
            n = np.diff(starts)
            kept.append((np.concatenate([[0], np.cumsum(np.where(good, n, 0))]), ids[np.repeat(good, n)]))
        return kept

    def windows(self, a_starts, a_ids, b_starts, b_ids) -> Windows:
        """Documents cut at their anchors, each distinct window aligned."""
        ends = ends_of(self.sizes[0][a_ids], self.sizes[1][b_ids])
        shared = np.flatnonzero(ends.both)
        after_a, after_b = (np.searchsorted(e, shared, side="right") for e in (ends.a_end, ends.b_end))
        last = np.zeros(len(ends.both), bool)
        last[np.append(ends.a_end, 0)[a_starts[1:] - 1]] = True  # ends of documents; those without tokens repeat one
        anchor = last[shared]
        inside = np.flatnonzero(~anchor)
        anchor[inside] = self.marked[0][a_ids[after_a[inside]]] & self.marked[1][b_ids[after_b[inside]]]
        a_hi, b_hi = after_a[anchor], after_b[anchor]
        a_lo, b_lo = (np.concatenate([[0], hi])[:-1].astype(np.int64) for hi in (a_hi, b_hi))
        # Each window's ids of A, then of B behind A's numbers, as one binary value.
        ids = np.empty(len(a_ids) + len(b_ids), np.uint32)
        ids[np.arange(len(a_ids)) + np.repeat(b_lo, a_hi - a_lo)] = a_ids
        ids[np.arange(len(b_ids)) + np.repeat(a_hi, b_hi - b_lo)] = b_ids + len(self.a.bytes)
        places = np.concatenate([[0], a_hi + b_hi]).astype(np.int64) * 4
        keys = pa.Array.from_buffers(pa.large_binary(), len(a_hi), [None, pa.py_buffer(places), pa.py_buffer(ids)])
        coded = keys.dictionary_encode()
        return Windows(np.concatenate([[0], np.searchsorted(a_hi, a_starts[1:], side="right")]),
                       coded.indices.to_numpy().astype(np.int64), *self.align(*_unpacked(coded.dictionary, np.dtype("<u4"))))

    def align(self, starts: np.ndarray, ids: np.ndarray):
        """Groups, their text and links of windows of ids, A's before B's: number of groups, texts, first link, links."""
        n, first_b = len(starts) - 1, len(self.a.bytes)
        window = np.repeat(np.arange(n), np.diff(starts))
        in_a = ids < first_b
        a, b = ids[in_a], ids[~in_a] - first_b
        ends = ends_of(self.sizes[0][a], self.sizes[1][b])
        links = a[ends.a_of] << 32 | b[ends.b_of]
        link_starts = np.searchsorted(window[in_a][ends.a_of], np.arange(n + 1))
        # A token closes its side of a group where it ends with a token of the other side.
        a_closes, b_closes = ends.both[ends.a_end], ends.both[ends.b_end]
        a_group, b_group = np.cumsum(a_closes) - a_closes, np.cumsum(b_closes) - b_closes
        entry = np.concatenate([a + first_b * a_closes, 2 * first_b + b + len(self.b.bytes) * b_closes])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        pieces = list(map(self.written.__getitem__, entry[order].tolist()))
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])[starts].tolist()
        whole = b"".join(pieces)
        groups = np.bincount(window[in_a][a_closes], minlength=n)
        return groups, [whole[x:y] for x, y in zip(at[:-1], at[1:])], link_starts, links


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner for the two vocabulary files."""
    key = (a_path, b_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_path, b_path)
    return _ALIGNERS[key]


_DOCUMENT = ["n_a", "n_b", "n_groups", "n_links", "groups", "a", "b"]
_ALIGNED = ["row_key", "id", *_DOCUMENT, "pair", "times"]
_TYPES = ["long", "long", "long", "long", "binary", "binary", "binary", "long", "long"]


def _packed(starts: np.ndarray, ids: np.ndarray, kind: np.dtype) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [
        None, pa.py_buffer((starts * kind.itemsize).astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())


def _aligned(both: Aligner, batch: pa.RecordBatch, pairs: Callable[[np.ndarray, np.ndarray], None]) -> pa.RecordBatch:
    (a_starts, a_ids), (b_starts, b_ids) = both.tokens(batch.column("text"))
    found = both.windows(a_starts, a_ids, b_starts, b_ids)
    pairs(found.links, np.repeat(np.bincount(found.code, minlength=len(found.text)), np.diff(found.link_starts)))
    at, told = found.starts.tolist(), list(map(found.text.__getitem__, found.code.tolist()))
    text = [b"".join(told[x:y])[:-1] for x, y in zip(at[:-1], at[1:])]
    n = batch.num_rows
    return pa.record_batch([
        batch.column("row_key"), batch.column("id"), pa.array(np.diff(a_starts)), pa.array(np.diff(b_starts)),
        pa.array(found.per_document(found.groups)), pa.array(found.per_document(np.diff(found.link_starts))),
        pa.array(text, pa.binary()), _packed(a_starts, a_ids, both.narrow[0]), _packed(b_starts, b_ids, both.narrow[1]),
        pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=_ALIGNED)


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(times), len(key)).astype(np.int64)


def tokens_and_pairs(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                     digest: bool = False) -> DataFrame:
    """Rows of documents (row_key, id, counts, groups as text, packed ids of A and B) and rows (pair, times) that add up
    to the links of the corpus, in one table.  With `digest`, `groups` holds the SHA-256 in hex instead."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("id"),
                       texts(text_col).alias("text"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in zip(_ALIGNED[2:], _TYPES)]
    schema = rows.select(F.lit(None).cast("long").alias("row_key"), F.nullif("id", "id").alias("id"), *empty).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, keys, times, id_type = aligner(a_path, b_path), [], [], None

        def note(pairs, n):
            keys.append(pairs), times.append(n)

        def out():
            pair, n = _summed(keys, times)
            keys.clear(), times.clear()
            return pa.record_batch([pa.nulls(len(pair), t) for t in id_type] + [pa.array(pair), pa.array(n)],
                                   names=_ALIGNED)

        for batch in each_step(batches, "text", lambda b: _aligned(both, b, note), STEP):
            id_type = id_type or [c.type for c in batch.columns[:-2]]
            if digest:
                hexed = [hashlib.sha256(x).hexdigest().encode() if x else b"" for x in batch.column("groups").to_pylist()]
                batch = batch.set_column(6, "groups", pa.array(hexed, pa.binary()))
            yield batch
            if sum(map(len, keys)) > OPEN_PAIRS:
                merged = _summed(keys, times)
                keys[:], times[:] = [merged[0]], [merged[1]]
                if len(merged[0]) > OPEN_PAIRS // 2:
                    yield out()
        if keys:
            yield out()

    return rows.mapInArrow(run, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, a, b, n): in how many links of the corpus the id pair is linked."""
    counts = made.where("pair is not null").groupBy("pair").agg(F.sum("times").alias("n"))
    return counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(_LOW)).alias("b"), "n")


def score_links(made: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents of `tokens_and_pairs` with n_best and count_sum over their links."""
    spark = made.sparkSession
    counts = materialize(pair_counts(made), "pairs")
    best_rows = counts.groupBy("b").agg(F.max("n").alias("n")).collect()  # one for each id of B at most
    best = np.zeros(1 + max((r.b for r in best_rows), default=0), np.int64)
    for r in best_rows:
        best[r.b] = r.n
    powers = counts.agg(*(F.count(F.when(F.col("n") >= (1 << k), 1)).alias(f"p{k}") for k in range(63))).first()
    least = next(1 << k for k in range(63) if powers[f"p{k}"] <= HEAD)
    head = counts.where(F.col("n") >= least).select("pair", "n").toArrow()  # HEAD at most
    keys, n = head.column("pair").to_numpy(), head.column("n").to_numpy()
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], n[order], best))
    documents = made.where("row_key is not null").select("row_key", "a", "b")

    def look_up(both: Aligner, batch: pa.RecordBatch) -> pa.RecordBatch:
        known, times, highest = sent.value
        (a_starts, a_ids), (b_starts, b_ids) = (_unpacked(batch.column(c), k) for c, k in zip("ab", both.narrow))
        ends = ends_of(both.sizes[0][a_ids], both.sizes[1][b_ids])
        links = a_ids[ends.a_of] << 32 | b_ids[ends.b_of]
        link_starts = np.searchsorted(ends.a_of, a_starts)
        place = np.minimum(np.searchsorted(known, links), max(len(known) - 1, 0))
        sure = known[place] == links if len(known) else np.zeros(len(place), bool)
        count = np.where(sure, times[place] if len(known) else 0, 0)
        is_best = sure & (count == highest[links & _LOW])
        keys = batch.column("row_key").to_numpy()
        # Links outside the broadcast counts go on as rows, with the times they occur in the document.
        rest = np.flatnonzero(~sure)
        owner = np.searchsorted(link_starts, rest, side="right") - 1
        distinct, code = np.unique(links[rest], return_inverse=True)
        cell, rest_times = np.unique(owner * max(len(distinct), 1) + code, return_counts=True)
        rest_key, rest_pair = keys[cell // max(len(distinct), 1)], distinct[cell % max(len(distinct), 1)]
        sums = [np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[link_starts]) for x in (is_best, count)]
        none = np.zeros(len(rest), np.int64)[:len(cell)]
        return pa.record_batch([
            pa.array(np.concatenate([keys, rest_key])), *(pa.array(np.concatenate([x, none])) for x in sums),
            pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(rest_pair)]),
            pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(rest_times.astype(np.int64))])],
            names=["row_key", "n_best", "count_sum", "pair", "times"])

    def run(batches):
        both = aligner(a_path, b_path)
        return each_step(batches, "a", lambda batch: look_up(both, batch), STEP)

    looked = documents.mapInArrow(run, "row_key long, n_best long, count_sum long, pair long, times long")
    looked = materialize(looked, "links")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    rare = counts.where(F.col("n") < least).join(highest, "b").select(
        "pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    rest = (looked.where("pair is not null").select("row_key", "pair", "times").join(rare, "pair")
            .groupBy("row_key").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"),
                                    F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    sums = (looked.where("pair is null").select("row_key", "n_best", "count_sum").unionByName(rest)
            .groupBy("row_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return made.where("row_key is not null").drop("a", "b", "pair", "times").join(sums, "row_key").drop("row_key")


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    ids = np.frombuffer(column.buffers()[2] or b"", kind, (at[-1] - at[0]) // kind.itemsize, int(at[0]))
    return (at - at[0]) // kind.itemsize, ids.astype(np.int64)


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                    digest: bool = False) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum."""
    made = materialize(tokens_and_pairs(docs, a_path, b_path, id_col, text_col, digest), "aligned")
    return score_links(made, a_path, b_path)
