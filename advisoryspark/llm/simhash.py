"""SimHash near-duplicates over a hierarchical index in Gray order (free style: numpy inside tasks).

Fingerprints: 64 bits by majority over the XXH64 values of word shingles.

Index.  The 64 bits are cut into four blocks.  Two fingerprints that differ in at
most two bits agree in at least two blocks, so each fingerprint is filed under
the six masked patterns of two blocks: these patterns are the upper nodes.  A
node with many fingerprints is split into further nodes whose patterns also fix
a third of the remaining bits (again one third must agree).  Below a node the
fingerprints are sorted by Gray rank and every run of 16 shares a node that holds
their common bits as mask and pattern, and so on upwards.  A search goes down
pairs of nodes and drops a pair as soon as the differences in the bits both fix
exceed the limit.  Nothing is capped: all pairs of nodes that may hold a link are
followed, and a node's members have at most 22 free bits.

Links inside an index node are reduced to a spanning forest before they leave
the task; components are then joined by `components`.

Defined cases: a text without words, empty or null, has fingerprint zero and
links like any other; a null id never is a representative unless its component
has no other; repeated rows share fingerprint and component; an empty table
gives an empty result; extra columns are kept by `deduplicate`; a bit set in exactly
half of the hashes is zero; a very long text is hashed whole, in pieces of 4 MB of bits.
"""

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import each_step, materialize, text_of
from advisoryspark.llm.components import components

SEED = 42
#: Fingerprints under one upper node beyond which it is split; any value gives the same links.
SPLIT_OVER = 2000
#: Children of an index node.
FAN_OUT = 16


def fingerprint_text(raw: bytes, shingle: int) -> int:
    """SimHash of the lower-cased words of `raw`, shingle by shingle with repeats."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED)
                  for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):  # unpacked bits stay below 4 MB
        ones += np.unpackbits(values[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Columns `row` (all of `docs` as a struct) and `fp` (the 64 bits as a signed long); no shuffle."""
    path = f"row.{text_col}"

    def fill(batch):
        found = np.array([fingerprint_text(x, shingle) for x in text_of(batch, path).to_pylist()], np.uint64)
        return pa.record_batch([batch.column("row"), pa.array(found.view(np.int64))], names=["row", "fp"])

    rows = docs.select(F.struct("*").alias("row"))
    schema = rows.select("row", F.lit(0).cast("long").alias("fp")).schema
    return rows.mapInArrow(lambda it: each_step(it, path, fill), schema)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(sorted_values: np.ndarray, free: np.uint64):
    """From the root down: (mask, pattern) of each node; the last level is the fingerprints."""
    levels = [(np.full(len(sorted_values), free, np.uint64), sorted_values)]
    while len(levels[0][0]) > 1:
        mask, pattern = levels[0]
        first = np.arange(0, len(mask), FAN_OUT)
        low, high = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
        shared = np.bitwise_and.reduceat(mask, first) & ~(low ^ high)
        levels.insert(0, (shared, low & shared))
    return levels


def linked_pairs(values: np.ndarray, distance: int, free: int):
    """Batches of index pairs (i < j) of distinct `values` that differ in at most `distance` bits.

    Descends pairs of nodes level by level, in pieces of bounded size.
    """
    order = np.argsort(gray_rank(values & np.uint64(free)), kind="stable")
    values = values[order] & np.uint64(free)
    levels = _levels(values, np.uint64(free))
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, left, right = stack.pop()
        mask, pattern = levels[depth]
        apart = (pattern[left] ^ pattern[right]) & mask[left] & mask[right]
        near = np.bitwise_count(apart) <= distance
        left, right = left[near], right[near]
        if depth == len(levels) - 1:
            yield order[left[left < right]], order[right[left < right]]
            continue
        n = len(levels[depth + 1][0])
        for at in range(0, len(left), 4096):
            a = left[at:at + 4096, None] * FAN_OUT + np.arange(FAN_OUT)
            b = right[at:at + 4096, None] * FAN_OUT + np.arange(FAN_OUT)
            a, b = np.repeat(a, FAN_OUT, axis=1).ravel(), np.tile(b, (1, FAN_OUT)).ravel()
            real = (a < n) & (b < n) & (a <= b)
            stack.append((depth + 1, a[real], b[real]))


class Forest:
    """Union by smallest member over 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        """The root of every member."""
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent

    def join(self, i: int, j: int):
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def spanning_links(values: np.ndarray, distance: int, free: int) -> list[tuple[int, int]]:
    """Pairs of fingerprints that connect what is linked among `values`."""
    if len(values) == 2:
        return [(int(values[0]), int(values[1]))] if int(values[0] ^ values[1]).bit_count() <= distance else []
    forest = Forest(len(values))
    for left, right in linked_pairs(values, distance, free):
        for i, j in zip(left.tolist(), right.tolist()):
            forest.join(i, j)
    roots = [forest.root(i) for i in range(len(values))]
    return [(int(values[i]), int(values[r])) for i, r in enumerate(roots) if i != r]


def _thirds(bits: list[int]) -> list[list[int]]:
    return [bits[k::3] for k in range(3)]


def _mask(bits) -> int:
    return reduce(lambda m, b: m | 1 << b, bits, 0)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


BLOCKS = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
#: Six masks of two blocks, and under each the three masks that also fix a third of the other bits.
UPPER = [_mask(a + b) for a, b in combinations(BLOCKS, 2)]
SPLIT = [[m | _mask(t) for t in _thirds([b for b in range(64) if not m >> b & 1])] for m in UPPER]


def _filed(masks: list[int]) -> Column:
    """Array of (node mask, masked pattern) of a fingerprint."""
    return F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern"))
                     for m in masks))


def near_links(fingerprints: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct `fp` within `distance` (2 at most) of one another.

    The sizes of the upper nodes are counted first; members of a large one are
    filed under its three narrower nodes instead, in the same shuffle.
    """
    if distance > 2:
        raise ValueError("the four blocks are made for distances up to 2")
    distinct = materialize(fingerprints.select("fp").distinct(), "fingerprints")
    filed = distinct.select("fp", F.explode(_filed(UPPER)).alias("node")).select("fp", "node.*")
    sizes = filed.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = filed.join(sizes, ["mask", "pattern"])
    deeper = F.create_map(*(x for m, narrow in zip(UPPER, SPLIT)
                            for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(k)) for k in narrow)))))
    masks = F.when(F.col("n") > SPLIT_OVER, deeper[F.col("mask")]).otherwise(F.array("mask"))
    nodes = (shared.select("fp", F.explode(masks).alias("mask"))
             .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp"))
    return nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern").mapInArrow(
        lambda batches: _search(batches, distance), "a long, b long")


def _search(batches, distance: int):
    """Search node after node in rows sorted by node; only the open node's members are held."""
    tail = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(3)]
        columns = columns if tail is None else [np.concatenate(x) for x in zip(tail, columns)]
        mask, pattern, fp = columns
        if not len(fp):
            continue
        cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(pattern) != 0)) + 1
        last = cuts[-1] if len(cuts) else 0
        yield from _links(mask, fp, [0, *cuts.tolist()], distance)
        tail = [x[last:] for x in columns]
    if tail is not None:
        yield from _links(tail[0], tail[2], [0, len(tail[2])], distance)


def _links(mask, fp, cuts, distance):
    found = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            members = np.sort(fp[a:b].view(np.uint64))
            found += spanning_links(members, distance, ~int(mask[a]) & (1 << 64) - 1)
    if found:
        pairs = np.array(found, np.uint64).view(np.int64)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def groups(fingerprinted: DataFrame, distance: int = 2) -> DataFrame:
    """Linked fingerprints with the smallest fingerprint of their component: (fp, root).

    Fingerprints without a link are left out: they are components of their own.
    """
    return components(near_links(fingerprinted, distance)).select(F.col("node").alias("fp"), "root")


def assign(fingerprinted: DataFrame, distance: int = 2) -> DataFrame:
    """Rows (id, fp) with `component_id`, the smallest id of their component.

    Ids are reduced per fingerprint first, so a hot fingerprint is one row from
    each task; the last join's document side is split where it is skewed.
    """
    per_fp = fingerprinted.groupBy("fp").agg(F.min("id").alias("id"))
    roots = groups(fingerprinted, distance)
    rooted = per_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return fingerprinted.join(named, "fp")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                distance: int = 2) -> DataFrame:
    """`docs` with one document of each component: that with the smallest id.

    Repeated rows of that id become one row.  A component without any id keeps
    the row with its smallest fingerprint.
    """
    marked = materialize(with_fingerprint(docs, text_col, shingle), "simhash")
    narrow = marked.select(F.col(f"row.{id_col}").alias("id"), "fp")
    roots = groups(narrow, distance)
    per_fp = narrow.groupBy("fp").agg(F.min("id").alias("id"))
    best = (per_fp.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("fp"))).alias("best"))
            .select(F.col("best.id").alias("best_id"), F.col("best.fp").alias("best_fp")))
    kept = marked.join(best, F.col("fp").eqNullSafe(F.col("best_fp")) & F.col(f"row.{id_col}").eqNullSafe(F.col("best_id")),
                       "left_semi")
    return kept.withColumn("key", F.col(f"row.{id_col}")).dropDuplicates(["fp", "key"]).select("row.*")
