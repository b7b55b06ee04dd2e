"""Spelling variants by finite-state composition (free style: Python inside tasks over sorted cells).

Words of a corpus are counted; two are near if one inserted, deleted or replaced code point makes them equal.  The
pairs are those that the composition (vocabulary acceptor, one-edit transducer, vocabulary acceptor) accepts.

The composed automaton is enumerated by partitions of its initial states.  For a pair whose shorter word has `size`
code points, a partition (cell) fixes where the edit lies, in [low, high) of the shorter word, and what both words
read outside it.  Each word is filed under the two halves of its own size and of the size below, since the edit leaves
one half untouched.  A cell with more than CELL words is cut into the cells of half the range, again and again; at a
range of one place a cell has no more words than the alphabet allows, so any vocabulary is cut small enough.  In a cell
the parts of the words inside the range become a minimal acceptor, whose states know how many words they accept (so a
path is the number of its word); composing it with the transducer and itself walks pairs of states only after the
edit, and equal states accept each other without a walk.  A pair is accepted at the first place where its words
differ, which one cell holds, so it is found once.

Defined cases: null and empty texts have no words; a null id is the empty text in the hash that picks the deletions;
repeated rows count each; ties for a word's form go to the smallest word in code-point order; an empty table gives an
empty result; other columns are ignored.  Words of any length are taken whole, and no walk recurses.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import each_step, fold_table, materialize, texts, word_table

#: Least code points and occurrences of a word; one in DELETE_ONE_IN (document, run) loses a code point.
LEAST_LENGTH, LEAST_COUNT, DELETE_ONE_IN = 5, 3, 97
#: Words in a cell beyond which it is cut; any value gives the same pairs.
CELL = 2000
LOWER = fold_table()


def letters_only(column: pa.Array) -> pa.Array:
    """Texts in which every byte outside runs of [A-Za-zÀ-ÿ] is a space, A-Z lower-cased."""
    column = column.cast(pa.large_binary())
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    lead = data == 0xC3  # first byte of U+00C0 to U+00FF
    letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) | lead
    letter[1:] |= lead[:-1]
    data = np.where(letter, LOWER[data], 32).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(ends - ends[0])),
                                                        pa.py_buffer(data)])


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(word, n) of a run of documents, after the deletions."""
    starts, codes, distinct = word_table(letters_only(batch.column("text")))
    long = pc.greater_equal(pc.utf8_length(distinct), LEAST_LENGTH).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(batch.num_rows), np.diff(starts))
    kept = long[codes] if len(codes) else np.zeros(0, bool)
    cell, times = np.unique(text[kept] * max(len(distinct), 1) + codes[kept], return_counts=True)
    text, code = np.divmod(cell, max(len(distinct), 1))
    words = distinct.cast(pa.large_binary()).to_pylist()
    seeds = [zlib.crc32(f"{i}:".encode()) for i in batch.column("id").fill_null("").to_pylist()]
    crc = zlib.crc32
    hashes = np.array([crc(words[c], seeds[t]) for t, c in zip(text.tolist(), code.tolist())], np.int64)
    cut = hashes % DELETE_ONE_IN == 0
    total = np.bincount(code[~cut], times[~cut], minlength=len(words)).astype(np.int64)
    used = np.flatnonzero(total)
    shorter = []
    for c, h in zip(code[cut].tolist(), hashes[cut].tolist()):
        word = words[c].decode()
        at = h % len(word)
        shorter.append(word[:at] + word[at + 1:])
    return pa.record_batch([
        pa.concat_arrays([distinct.take(pa.array(used)).cast(pa.string()), pa.array(shorter, pa.string())]),
        pa.array(np.concatenate([total[used], times[cut]]).astype(np.int64))], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points and LEAST_COUNT occurrences or more over all documents."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), texts(text_col).alias("text"))
    counted = rows.mapInArrow(lambda batches: each_step(batches, "text", _counted), "word string, n long")
    return (counted.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


class Acceptor:
    """Minimal acyclic acceptor of sorted strings; each state knows how many strings it accepts."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = [False]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]  # character: (state, strings accepted before this arc)
        self.count: list[int] = [0]
        same: dict = {}
        path, before = [0], ""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            self._close(path, before, shared, same)
            for c in word[shared:]:
                state = len(self.final)
                self.final.append(False), self.arcs.append({}), self.count.append(0)
                self.arcs[path[-1]][c] = (state, 0)
                path.append(state)
            self.final[path[-1]] = True
            before = word
        self._close(path, before, 0, same)
        self._number(0)

    def _number(self, state: int):
        total = int(self.final[state])
        for c, (target, _) in self.arcs[state].items():
            self.arcs[state][c] = (target, total)
            total += self.count[target]
        self.count[state] = total

    def _close(self, path: list[int], word: str, depth: int, same: dict):
        """Leave states below `depth`: each becomes the earlier state that accepts the same, where there is one."""
        while len(path) - 1 > depth:
            state = path.pop()
            self._number(state)
            key = (self.final[state], tuple((c, t) for c, (t, _) in self.arcs[state].items()))
            self.arcs[path[-1]][word[len(path) - 1]] = (same.setdefault(key, state), 0)

    def common(self, p: int, q: int) -> list[tuple[int, int]]:
        """Numbers below p and below q of the strings that both accept."""
        out, stack = [], [(p, q, 0, 0)]
        while stack:
            p, q, i, j = stack.pop()
            if p == q:
                out.extend((i + k, j + k) for k in range(self.count[p]))
                continue
            if self.final[p] and self.final[q]:
                out.append((i, j))
            other = self.arcs[q]
            for c, (target, skip) in self.arcs[p].items():
                if c in other:
                    stack.append((target, other[c][0], i + skip, j + other[c][1]))
        return out


def composed(acceptor: Acceptor, at_end: bool) -> Iterator[tuple[int, int]]:
    """Numbers of the pairs of strings that one edit turns into each other, the longer first.

    The one-edit transducer has two states.  Before the edit both tapes have read the same, so both acceptors are in one
    state; there the edit replaces a character by a larger one or deletes one that the other tape does not read next;
    after it only equal characters follow.  `at_end`: the deleted character may be the last one.
    """
    edits: dict[int, list[tuple[int, int]]] = {}
    stack = [(0, 0)]
    while stack:
        state, base = stack.pop()
        arcs = acceptor.arcs[state]
        if state not in edits:
            found = edits[state] = []
            for c, (p, skip) in arcs.items():
                for d, (q, other) in arcs.items():
                    if c < d:
                        found += [(skip + i, other + j) for i, j in acceptor.common(p, q)]
                    if c != d and d in acceptor.arcs[p]:
                        target, further = acceptor.arcs[p][d]
                        found += [(skip + further + i, other + j) for i, j in acceptor.common(target, q)]
                if at_end and acceptor.final[state] and acceptor.final[p]:
                    found.append((skip, 0))
        for i, j in edits[state]:
            yield base + i, base + j
        stack.extend((p, base + skip) for p, skip in arcs.values())


def _cells(words: DataFrame, size: Column, low: Column, high: Column) -> DataFrame:
    """Rows (key, word, n): the cell of each word, with what it reads outside [low, high)."""
    tail = size - high
    return words.select(F.concat_ws(":", size, low, high, F.substring(F.col("word"), F.lit(1), low),
                                    F.substring(F.col("word"), F.length("word") - tail + 1, tail)).alias("key"),
                        "word", "n")


def filed(vocabulary: DataFrame, cell: int = 0) -> DataFrame:
    """Words under their cells, none with over CELL words that can be cut further."""
    cell = cell or CELL
    sizes = vocabulary.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    halves = (sizes.where(F.col("size") >= LEAST_LENGTH).withColumn("middle", F.floor(F.col("size") / 2).cast("int"))
              .withColumn("range", F.explode(F.array(F.array(F.lit(0), F.col("middle")), F.array("middle", "size")))))
    rows, done = _cells(halves, F.col("size"), F.col("range")[0], F.col("range")[1]), []
    while True:
        part = F.split("key", ":")
        size, low, high = (part[k].cast("int") for k in range(3))
        hot = materialize(rows.groupBy("key").count().where((F.col("count") > cell) & (high - low > 1)).select("key"), "hot")
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, "key", "left_anti"))
        middle = F.floor((low + high) / 2).cast("int")
        cut = (rows.join(hot, "key").withColumn("size", size)
               .withColumn("range", F.explode(F.array(F.array(low, middle), F.array(middle, high)))))
        rows = materialize(_cells(cut, F.col("size"), F.col("range")[0], F.col("range")[1]), "cells")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


_PAIR = ["longer", "longer_n", "shorter", "shorter_n"]


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of cell after cell in rows sorted by cell and word; only the open cell's words are held."""
    found: list[tuple] = []
    key, words, counts = None, [], []

    def close():
        if len(words) > 1:
            size, low, high = map(int, key.split(":", 3)[:3])
            tail = size - high
            parts = [w[low:len(w) - tail] for w in words]
            if len(parts[0]) == high - low or any(len(p) == high - low for p in parts):  # else all are the longer words
                order = sorted(range(len(parts)), key=parts.__getitem__)
                for i, j in composed(Acceptor([parts[k] for k in order]), high == size):
                    i, j = order[i], order[j]
                    if len(parts[i]) == high - low or len(parts[j]) == high - low:
                        found.append((words[i], counts[i], words[j], counts[j]))

    def out():
        columns = list(zip(*found))
        found.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], names=_PAIR)

    for batch in batches:
        for k, word, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if k != key:
                close()
                key, words, counts = k, [], []
                if len(found) > 10_000:
                    yield out()
            words.append(word)
            counts.append(n)
    close()
    if found:
        yield out()


def near_pairs(vocabulary: DataFrame, cell: int = 0) -> DataFrame:
    """Each pair of near words of (word, n) once: longer, longer_n, shorter, shorter_n (equal lengths in either order)."""
    cells = filed(vocabulary, cell).repartition("key").sortWithinPartitions("key")
    return cells.mapInArrow(_accepted, "longer string, longer_n long, shorter string, shorter_n long")


def variants(vocabulary: DataFrame, cell: int = 0) -> DataFrame:
    """Per word of (word, n): form (its near word of largest n where that is at least twice its own), root (the last
    form of forms), n, n_near, form_n."""
    vocabulary = materialize(vocabulary, "vocabulary")
    pairs = materialize(near_pairs(vocabulary, cell), "pairs")
    ways = [pairs.select(F.col(f"{a}er").alias("word"), F.col(f"{b}er").alias("near"), F.col(f"{b}er_n").alias("near_n"))
            for a, b in (("long", "short"), ("short", "long"))]
    best = (ways[0].unionByName(ways[1]).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best")))
    known = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"),
        (-F.col("best.col1")).alias("form_n"))
    holds = F.col("form_n") >= 2 * F.col("n")
    known = materialize(known.withColumn("form", F.when(holds, F.col("form")))
                        .withColumn("form_n", F.when(holds, F.col("form_n"))), "forms")
    roots = last_forms(known.where("form is not null").select("word", F.col("form").alias("root")))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                    "n_near", "form_n")


def last_forms(steps: DataFrame) -> DataFrame:
    """(word, root) with each root followed to the end.  A form has twice the count of its word, so a chain has at most
    as many links as the largest count has bits, and each round halves what is left of it."""
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(steps.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not steps.where("moved").isEmpty()
        steps = steps.select("word", "root")
        if not moved:
            return steps


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants of the words of whole texts."""
    return variants(vocabulary(docs, id_col, text_col))
