"""Removal of byte strings that occur twice, by sorting suffixes in range partitions (free style: numpy inside tasks).

Every byte that lies in a LENGTH-byte string which also starts elsewhere goes.
A suffix row for each byte would be LENGTH times the corpus, so suffixes start at
anchors: of the GRAM-byte grams inside a LENGTH-byte window the one with the least
hash is the window's anchor (the left one of equals).  Equal windows have their
anchor at the same place, so they are found among equal suffixes.

Suffixes are sorted by several keys in turn: their first eight bytes, a digest of
the part all windows of the row share, a digest of all bytes its windows cover.
Spark's sampled splitters cut that order into ranges, each range is sorted by
itself, neighbours are compared, and the first and last row of each range are
compared across the boundaries, so a hot string may fill any number of ranges.
A row equal to a neighbour has only windows that occur twice.  A row that shares
just the common part with other rows is looked at again in finer rows: blocks of
BLOCK windows, then single windows, one row for each distinct string.  Digests
have 128 bits where they settle that strings are equal.

Defined cases: null and empty texts and those under LENGTH bytes lose nothing;
repeated rows repeat each other; a null id is an id like any other; an empty table gives an empty
result; extra columns are kept by `remove` and ignored by `measure`.  Cut texts
may end inside a character; `remove` then drops the torn character's bytes.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import each_step, materialize, texts

#: Length of the repeated strings, of the grams whose hashes choose the anchors, windows in a block.
LENGTH, GRAM, BLOCK = 400, 128, 16
#: Bytes of text for which anchors are chosen in one numpy step.
PIECE = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE_BITS = 28
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)

_KEYS = ["lead", "core", "whole"]
_ROW = ["lead", "core", "whole", "u1", "u2", "anchor", "low", "high"]
_ROW_TYPE = "lead long, core long, whole long, u1 long, u2 long, anchor int, low int, high int"
_FOUND = [*_ROW, "twice", "finer", "part", "edge"]
_FOUND_TYPE = f"{_ROW_TYPE}, twice boolean, finer boolean, part int, edge int"


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each place, by differences of one running polynomial sum."""
    n = len(data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(_BASE, n), dtype=np.uint64)])
    out = (total[k:] - total[:-k]) * powers(_BASE_INVERSE, n - k + 1)
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, from prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, ends: np.ndarray):
    """Anchor, first and last window start, and common gram hash, for all windows of the texts in `data`.

    Texts lie behind one another and end at `ends`; long data are gone through in pieces.
    """
    found = []
    for begin in range(0, len(data) - LENGTH + 1, PIECE):
        part = data[begin:begin + PIECE + LENGTH - 1]
        gram = gram_hashes(part, GRAM)
        place = window_minimum((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), LENGTH - GRAM + 1) & _PLACE
        start = begin + np.arange(len(place))
        end_of_text = ends[np.searchsorted(ends, start, side="right")]
        inside = np.flatnonzero(start + LENGTH <= end_of_text)
        if not len(inside):
            continue
        anchor, text_end, start = place[inside].astype(np.int64) + begin, end_of_text[inside], start[inside]
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text_end[1:] != text_end[:-1])]))
        found.append((anchor[cut], start[cut], start[np.append(cut[1:], len(start)) - 1], gram[anchor[cut] - begin]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def _long(raw: bytes) -> int:
    """Eight bytes as a long that sorts as the bytes do."""
    return int.from_bytes(raw, "big") - (1 << 63)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _suffix_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of the first comparison: one for each anchor of the texts."""
    raw = b"".join(batch.column("text").to_pylist())
    sizes = np.array([len(x) for x in batch.column("text").to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    anchor, low, high, gram = anchors(np.frombuffer(raw, np.uint8), ends)
    text = np.searchsorted(ends, low, side="right")
    first = (ends - sizes)[text]
    lead = [_long(raw[a:a + 8]) for a in anchor.tolist()]
    digest = xxhash.xxh3_64_intdigest
    whole = np.fromiter((digest(raw[a:b + LENGTH], x - a) for x, a, b in zip(anchor.tolist(), low.tolist(), high.tolist())),
                        np.uint64, len(anchor))
    u1, u2 = (batch.column(k).to_numpy()[text] for k in ("u1", "u2"))
    places = [pa.array((x - first).astype(np.int32)) for x in (anchor, low, high)]
    return pa.record_batch([pa.array(lead, pa.int64()), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)),
                            pa.array(u1), pa.array(u2), *places], names=_ROW)


def _compare(batches):
    """Neighbour comparison of a sorted range, batch by batch; a batch's last row waits for the next batch.

    Emits rows equal to a neighbour (`twice`), the last row of each distinct
    string that shares its common part with another one (`finer`), and the
    range's first and last row (`edge` 1 and 2).  What lies beyond the range is
    unknown here, so the strings at its ends count as shared.
    """
    part = TaskContext.get().partitionId()
    before = None  # the row before the waiting one, the waiting one, whether its string is the first with its common part
    waiting, first_string = None, False
    seen = False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy() for k in range(8)]
        if not seen:
            yield _emit([x[:1] for x in rows], [False], [False], part, 1)
            seen = True
        if waiting is not None:
            rows = [np.concatenate([w, x]) for w, x in zip(waiting, rows)]
        same_core = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        same = same_core & (rows[2][1:] == rows[2][:-1])
        if before is None:  # start of the range
            core_before, same_before = True, False
        else:
            core_before = all(before[k] == rows[k][0] for k in range(2))
            same_before = core_before and before[2] == rows[2][0]
        core_before, same_before = (np.concatenate([[x], y]) for x, y in ((core_before, same_core), (same_before, same)))
        n = len(rows[0]) - 1  # the last row waits
        start = np.maximum.accumulate(np.where(same_before, 0, np.arange(n + 1) + 1)) - 1
        alone = np.where(start >= 0, ~core_before[np.maximum(start, 0)], first_string)
        twice = same_before[:n] | same
        finer = ~same & (~alone[:n] | same_core)
        keep = twice | finer
        yield _emit([x[:n][keep] for x in rows], twice[keep], finer[keep], part, 0)
        before = [x[n - 1] for x in rows] if n else before
        waiting, first_string = [x[n:] for x in rows], bool(alone[n])
    if waiting is not None:
        same_before = before is not None and all(before[k] == waiting[k][0] for k in range(3))
        yield _emit(waiting, [same_before], [True], part, 0)
        yield _emit(waiting, [False], [False], part, 2)


def _emit(rows, twice, finer, part, edge):
    n = len(rows[0])
    return pa.record_batch([*map(pa.array, rows), pa.array(np.asarray(twice, bool)), pa.array(np.asarray(finer, bool)),
                            pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge, np.int32))], names=_FOUND)


def compare(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sort the suffix rows in ranges and compare neighbours: (rows that occur twice, rows to look at more finely).

    Two rows from each range come to the driver for the comparison across the boundaries.
    """
    order = [*_KEYS, "u1", "u2", "low"]
    found = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare, _FOUND_TYPE),
                        "suffixes")
    edges = found.where("edge > 0").orderBy("part", "edge").collect()
    across = [x for last, first in zip(edges[1::2], edges[2::2]) if [last[k] for k in _KEYS] == [first[k] for k in _KEYS]
              for x in (last, first)]
    twice = found.where("twice").select(*_ROW)
    if across:
        twice = twice.union(rows.sparkSession.createDataFrame([tuple(x[k] for k in _ROW) for x in across], _ROW_TYPE))
    return twice, found.where("finer").select(*_ROW)


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep) -> DataFrame:
    """Texts with a 128-bit key of id and text; rows that repeat both share it and lose the same bytes."""
    rows = docs.select(*keep, F.col(id_col).alias("key_id"), texts(text_col).alias("text"))
    return rows.select(*(c for c in rows.columns if c != "key_id"), F.xxhash64("key_id", "text").alias("u1"),
                       F.xxhash64(F.lit(1), "text", "key_id").alias("u2"))


_CONTEXT = "u1 long, u2 long, anchor int, low int, high int, bytes binary"


def _contexts(keyed: DataFrame, finer: DataFrame) -> DataFrame:
    """The bytes all windows of each row cover."""
    wanted = finer.groupBy("u1", "u2").agg(F.collect_set(F.struct("anchor", "low", "high")).alias("rows"))

    def cut(batch):
        out = []
        for u1, u2, text, rows in zip(*(batch.column(k).to_pylist() for k in ("u1", "u2", "text", "rows"))):
            out += [(u1, u2, r["anchor"], r["low"], r["high"], text[r["low"]:r["high"] + LENGTH]) for r in rows]
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(
            (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
            names=["u1", "u2", "anchor", "low", "high", "bytes"])

    joined = keyed.dropDuplicates(["u1", "u2"]).join(wanted, ["u1", "u2"]).select("u1", "u2", "text", "rows")
    return materialize(joined.mapInArrow(lambda it: each_step(it, "text", cut), _CONTEXT), "contexts")


def _finer_rows(batches):
    """From contexts with the window ranges to look at: blocks of windows, or single windows of a block."""
    for batch in batches:
        out = []
        for u1, u2, anchor, base, raw, low, high, single in zip(*(batch.column(k).to_pylist() for k in (
                "u1", "u2", "anchor", "base", "bytes", "low", "high", "single"))):
            if single:
                for p in range(low, high + 1):
                    window = raw[p - base:p - base + LENGTH]
                    digest = xxhash.xxh3_128_intdigest(window)
                    out.append((_long(window[:8]), _signed(digest >> 64), _signed(digest & (1 << 64) - 1), u1, u2,
                                anchor, p, p))
                continue
            for block in range((anchor - high) // BLOCK, (anchor - low) // BLOCK + 1):
                near, far = block * BLOCK, block * BLOCK + BLOCK - 1  # distances of the block's windows to the anchor
                first, last = max(low, anchor - far), min(high, anchor - near)
                core = raw[anchor - near - base:anchor - far - base + LENGTH]
                covered = raw[first - base:last - base + LENGTH]
                out.append((_long(core[:8]), _signed(xxhash.xxh3_64_intdigest(core, block)),
                            _signed(xxhash.xxh3_64_intdigest(covered, (anchor - first) << 20 | (anchor - last))),
                            u1, u2, anchor, first, last))
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(
            [pa.int64()] * 5 + [pa.int32()] * 3)], names=_ROW)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u1, u2, spans): for each text with repeated strings, their (start, end), unordered and overlapping."""
    keyed = _keyed(docs, id_col, text_col, [])
    twice, finer = compare(keyed.mapInArrow(lambda it: each_step(it, "text", _suffix_rows), _ROW_TYPE))
    parts = [twice]
    contexts = _contexts(keyed, finer)
    blocks = contexts.select("*", F.col("low").alias("base"), F.lit(False).alias("single"))
    twice, finer = compare(blocks.mapInArrow(_finer_rows, _ROW_TYPE))
    parts.append(twice)
    # A step's border may have cut an anchor's windows in two contexts: a block lies in one of them.
    held = contexts.withColumnsRenamed({"low": "base", "high": "top"})
    windows = (held.join(finer.select("u1", "u2", "anchor", "low", "high"), ["u1", "u2", "anchor"])
               .where("low between base and top").withColumn("single", F.lit(True)))
    parts.append(compare(windows.mapInArrow(_finer_rows, _ROW_TYPE))[0])
    spans = [p.select("u1", "u2", F.struct(F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end")).alias("s"))
             for p in parts]
    return (spans[0].union(spans[1]).union(spans[2]).groupBy("u1", "u2")
            .agg(F.collect_set("s").alias("spans")))


def _kept(raw: bytes, spans) -> tuple[bytes, int, int]:
    """Bytes outside the spans, number removed, number of maximal runs."""
    if not spans:
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(np.count_nonzero(gone)), runs


def _with_spans(docs, id_col, text_col, keep):
    spans = repeated_spans(docs, id_col, text_col)
    return _keyed(docs, id_col, text_col, keep).join(spans, ["u1", "u2"], "left").drop("u1", "u2")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    rows = _with_spans(docs, id_col, text_col, [F.col(id_col).alias("id")])

    def sums(batch):
        out = []
        for raw, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            kept, removed, runs = _kept(raw, spans)
            out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
        return pa.record_batch([batch.column("id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = rows.select("id", *(F.lit(0).cast(t).alias(c) for c, t in (
        ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")))).schema
    return rows.mapInArrow(lambda it: each_step(it, "text", sums), schema)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated bytes cut out of `text_col`; null texts stay null."""
    rows = _with_spans(docs, id_col, text_col, [F.struct("*").alias("row")])

    def cut(batch):
        kept = [_kept(raw, spans)[0].decode("utf-8", "ignore")
                for raw, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        return pa.record_batch([batch.column("row"), pa.array(kept, pa.string())], names=["row", "kept"])

    schema = rows.select("row", F.lit("").alias("kept")).schema
    cut_rows = rows.mapInArrow(lambda it: each_step(it, "text", cut), schema)
    text = F.when(F.col(f"row.{text_col}").isNotNull(), F.col("kept"))
    return cut_rows.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
