"""Benchmark decontamination: word windows of test items searched in training texts (free style).

The items' normalised windows are counted first.  Up to MAX_WINDOWS of them form
one broadcast hash set; more are searched block after block, each block a set of
that size against all rows, so the result is the same at every size.

Defined cases: null and empty texts have no words and hit nothing; items without
a word have no window; null item ids count as no item but their windows still
hit; repeated rows are searched each on its own; an empty benchmark hits
nothing; extra columns are kept by `clean` and ignored by `scan`; a very long text
is searched whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import WORD_BYTES, each_step, materialize, texts, word_table

#: Consecutive words of a window.
WINDOW = 10
#: Windows broadcast at a time; at about 1 KB each, 100 MB in each Python worker.
MAX_WINDOWS = 100_000

_WINDOWS = "item string, words array<string>"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item, words): the windows of each item, a short item being one window."""
    def cut(batch):
        starts, codes, distinct = word_table(batch.column("text"), WORD_BYTES)
        names = np.array(distinct.to_pylist(), object)
        items, found = [], []
        for i, item in enumerate(batch.column("item").to_pylist()):
            words = names[codes[starts[i]:starts[i + 1]]].tolist() if len(names) else []
            for k in range(max(1, len(words) - window + 1) if words else 0):
                items.append(item)
                found.append(words[k:k + window])
        return pa.record_batch([pa.array(items, pa.string()), pa.array(found, pa.list_(pa.string()))],
                               names=["item", "words"])

    narrow = benchmark.select(F.col("item_id").cast("string").alias("item"), texts().alias("text"))
    return narrow.mapInArrow(lambda it: each_step(it, "text", cut), _WINDOWS).distinct()


class WindowSet:
    """Hash set of windows for one block: word numbers, rolling keys, exact words for the check."""

    def __init__(self, rows):
        self.number: dict[str, int] = {}
        self.by_length: dict[int, tuple[np.ndarray, dict]] = {}
        exact: dict[int, dict[int, dict[tuple, set]]] = {}
        for item, words in rows:
            codes = tuple(self.number.setdefault(w, len(self.number)) for w in words)
            key = int(_keys(np.array(codes, np.int64), len(codes))[0])
            exact.setdefault(len(codes), {}).setdefault(key, {}).setdefault(codes, set()).add(item)
        for length, found in exact.items():
            self.by_length[length] = (np.sort(np.array(list(found), np.uint64)), found)

    def search(self, starts: np.ndarray, codes: np.ndarray, distinct: pa.Array):
        """(place of the first word, length, items) of every window that occurs inside one text."""
        get = self.number.get
        known = np.fromiter((get(w, -1) for w in distinct.to_pylist()), np.int64, len(distinct))[codes]
        unknown = np.concatenate([[0], np.cumsum(known < 0)])
        text_end = np.repeat(starts[1:], np.diff(starts))
        for length, (keys, exact) in self.by_length.items():
            n = len(known) - length + 1
            if n < 1:
                continue
            first = np.flatnonzero((unknown[length:] == unknown[:n]) & (np.arange(n) + length <= text_end[:n]))
            key = _keys(known, length, first)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            for at, k in zip(first[keys[place] == key].tolist(), key[keys[place] == key].tolist()):
                items = exact[k].get(tuple(known[at:at + length].tolist()))
                if items is not None:
                    yield at, length, items


def _keys(codes: np.ndarray, length: int, first: np.ndarray | None = None) -> np.ndarray:
    """64-bit key of the `length` words from each place in `first`."""
    first = np.arange(len(codes) - length + 1) if first is None else first
    key = np.zeros(len(first), np.uint64)
    for k in range(length):
        key = (key ^ codes[first + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _blocks(spark, benchmark: DataFrame, window: int, max_windows: int):
    """Broadcast lists of windows of about `max_windows` each, cut by the hash of the words so that equal windows meet."""
    found = item_windows(benchmark, window)
    n = found.count()
    if n > max_windows:
        found = materialize(found, "windows")
    parts = -(-n // max_windows)
    for k in range(parts):
        part = found if parts == 1 else found.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == k)
        yield spark.sparkContext.broadcast([(r.item, r.words) for r in part.toLocalIterator()])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(docs: DataFrame, benchmark: DataFrame, keep, window: int, max_windows: int) -> DataFrame:
    """The columns `keep` with `text` as bytes, n_words, spans and items, after all blocks.

    A block is one narrow pass that adds its hits to the spans, always over the
    words of the whole input text; no shuffle joins the blocks.
    """
    spark = docs.sparkSession
    out = docs.select(*keep, texts().alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr(
        "cast(array() as array<struct<start:int,end:int>>) as spans"), F.expr("cast(array() as array<string>) as items"))
    blocks = list(_blocks(spark, benchmark, window, max_windows)) or [spark.sparkContext.broadcast([])]
    for sent in blocks:
        out = out.mapInArrow(_adder(sent), out.schema)
    return out


def _adder(sent):
    def add(windows, batch):
        starts, codes, distinct = word_table(batch.column("text"), WORD_BYTES)
        edge = np.zeros(len(codes) + 1, np.int64)
        before = batch.column("spans").to_pylist()
        for i, spans in enumerate(before):
            for span in spans:
                edge[starts[i] + span["start"]] += 1
                edge[starts[i] + span["end"]] -= 1
        items = [set(x) for x in batch.column("items").to_pylist()]
        for at, length, found in windows.search(starts, codes, distinct):
            edge[at] += 1
            edge[at + length] -= 1
            items[int(np.searchsorted(starts, at, side="right")) - 1].update(x for x in found if x is not None)
        hit = np.cumsum(edge[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        spans = [[{"start": int(a), "end": int(b)} for a, b in _runs(hit[s:e])] if total[e] > total[s] else []
                 for s, e in zip(starts[:-1], starts[1:])]
        values = {"n_words": pa.array(np.diff(starts).astype(np.int64)), "spans": pa.array(spans, _SPANS),
                  "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
        return pa.record_batch([values.get(name, batch.column(name)) for name in batch.schema.names],
                               names=batch.schema.names)

    def run(batches):
        windows = WindowSet(sent.value)
        return each_step(batches, "text", lambda batch: add(windows, batch))

    return run


def _runs(hit: np.ndarray) -> np.ndarray:
    """(start, end) of each run of hit words."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW,
         max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: id, n_words, n_hit, the spans of hit words (start, end) and the items found, sorted."""
    found = _search(docs, benchmark, [F.col(id_col).alias("id")], window, max_windows)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    return found.select("id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "document", window: int = WINDOW,
          max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` without contaminated documents (mode "document") or without their hit words (mode "span").

    All other columns stay as they are; in span mode the text from the first to
    the last hit word of a run is cut out.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    found = _search(docs, benchmark, [F.struct("*").alias("row")], window, max_windows)
    if mode == "document":
        return found.where(F.size("spans") == 0).select("row.*")
    cut = found.mapInArrow(lambda it: each_step(it, "text", _cut_batch), found.schema)
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.col("text").cast("string"))
    return cut.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def _cut_batch(batch):
    texts_out = [_cut(raw, spans) for raw, spans in zip(batch.column("text").to_pylist(),
                                                        batch.column("spans").to_pylist())]
    k = batch.schema.get_field_index("text")
    return batch.set_column(k, batch.schema.field(k), pa.array(texts_out, batch.schema.field(k).type))


def _cut(raw: bytes, spans: list[dict]) -> bytes:
    inside = np.diff(np.concatenate([[0], (WORD_BYTES[np.frombuffer(raw, np.uint8)] != 32).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    kept, at = [], 0
    for span in spans:
        kept.append(raw[at:starts[span["start"]]])
        at = ends[span["end"] - 1]
    return b"".join([*kept, raw[at:]])
