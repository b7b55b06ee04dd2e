"""Exact Jaccard join of documents as sets of word shingles, in metric space (free style: numpy inside tasks).

Jaccard distance is a metric, but nearly all documents lie at distance 1 of one another, so a fixed choice of pivots
would put every document into the window of every region.  Pivots are therefore found where documents are near: each
set is filed under its rarest shingles, so many that two sets within the limit share a stated number of them (rarity
by a sketch of all shingles of the corpus, 2^20 counters, whatever the input).  Sets that meet others of a fitting size
less often leave; so do, under a shingle, sets that cannot link with any other there by their sizes and places in the
order, and a gap in the sizes divides the rest.  The first set is the pivot of the others there, and the sets of one
pivot are a region: any two linked sets meet in one.

A region joins recursively.  Some of its sets become pivots; each set goes to its nearest pivot, and by the triangle
inequality also into each region whose pivot is no more than 2 r farther (r: the greatest distance of a link).  Sets
near no pivot are a region of their own, joined in the same way, and enter regions whose pivot is nearer than 1 - r.
Regions whose sets are all connected already, or which a division does not make smaller, end the recursion.  Regions
too large for a task (REGION sets or REGION_BYTES) first lose what their pivot settles: sets within r of it are linked
to it, and leave unless a set beyond r may still be near them; the rest is joined block against block.  A region's
links leave a task as a spanning forest.

Defined cases: null and empty texts and texts without words have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle; copies are one set; repeated rows share their component; a null id is the component of its set
only if that has no other id; sets exactly at the limit link; an empty table gives an empty result; other columns are ignored.  Shingles are held as 64-bit
hashes: two different ones agree with a chance of 2^-64 a pair.  A task holds the sets of one region, REGION_BYTES
and one set more at most.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from advisoryspark.llm.common import each_step, fold_table, materialize, mixed, texts, word_hashes, word_table
from advisoryspark.llm.components import components
from advisoryspark.llm.simhash import Forest

SHINGLE, LIMIT = 4, 85
#: Counters of the sketch, and counters in a row that leaves a task.
SLOTS, BLOCK = 1 << 20, 1 << 14
#: Sets whose list of regions is sent to every task at most.
MAX_SENT = 1 << 18
#: Sets and bytes of sets in a region beyond which it is joined block against block; sets compared without pivots.
REGION, REGION_BYTES, FEW = 1024, 32 << 20, 24
#: Two linked sets of n shingles share 1 + n / SHARE of the rarest ones that they are filed under.
SHARE = 32
#: Sets that share a shingle beyond which it is a column of a matrix; matches held at a time.
DENSE, MATCHES = 64, 4 << 20
LOWER = fold_table()
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TWIST = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of every text, with repeats, and the text each belongs to."""
    starts, codes, distinct = word_table(column, LOWER)
    n_words = np.diff(starts)
    hashes = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(codes)) - starts[:-1][text]
    made = np.zeros(len(codes), np.uint64)
    for k in range(size):  # words behind the end of a text leave the hash as it is
        there = place + k < n_words[text]
        here = np.flatnonzero(there)
        made[here] = mixed((made[here] + hashes[here + k]) * _FACTOR + np.uint64(k))
    whole = np.flatnonzero((place + size <= n_words[text]) | ((place == 0) & (n_words[text] < size)))
    return made[whole], text[whole]


def distinct_shingles(column: pa.Array, size: int, rank: np.ndarray | None = None):
    """Where each text's set starts (and the end), and the sets, ordered by `rank` of their slot and value."""
    made, text = shingles(column, size)
    order = np.lexsort((made, text) if rank is None else (made, rank[_slot(made)], text))
    made, text = made[order], text[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (text[1:] != text[:-1])
    made, text = made[new], text[new]
    return np.searchsorted(text, np.arange(len(column) + 1)), made


def _slot(made: np.ndarray) -> np.ndarray:
    return (made >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[starts[1:]] - total[starts[:-1]]


def rarity(docs: DataFrame, text_col: str = "text", size: int = SHINGLE) -> np.ndarray:
    """Power of two of the occurrences in each slot of the sketch, over all documents (SLOTS bytes)."""
    kinds = "block int, part int, counts binary"

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for made in each_step(batches, text_col, lambda b: pa.record_batch(
                [pa.array(_slot(shingles(b.column(0), size)[0]))], names=["slot"])):
            total += np.bincount(made.column(0).to_numpy(), minlength=SLOTS)
        if total.any():
            part = TaskContext.get().partitionId() % 32
            for k in range(SLOTS // BLOCK):
                yield _counters(k, part, total[k * BLOCK:(k + 1) * BLOCK])

    def add(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, part, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
                key = (k, part)
                held[key] = held.get(key, 0) + np.frombuffer(raw, np.int64)
        for (k, part), total in held.items():
            yield _counters(k, part, total)

    def _counters(k, part, total):
        return pa.record_batch([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()])],
                               names=["block", "part", "counts"])

    parts = docs.select(texts(text_col).alias(text_col)).mapInArrow(count, kinds)
    summed = parts.repartition("block", "part").mapInArrow(add, kinds)
    whole = summed.withColumn("part", F.lit(0)).repartition("block").mapInArrow(add, kinds)
    counts = np.zeros(SLOTS, np.int64)
    for row in whole.collect():  # SLOTS counters
        counts[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.int64)
    return np.ceil(np.log2(counts + 1)).astype(np.uint8)


def describe(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
             limit: int = LIMIT) -> DataFrame:
    """(row_key, id, n, d1, d2, prefix): size and digest of each document's set, and its rarest shingles: one more than
    a linked set may lack, and n / SHARE more."""
    sent = docs.sparkSession.sparkContext.broadcast(rank)
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("id"),
                       texts(text_col).alias("text"))

    def fill(batch):
        starts, made = distinct_shingles(batch.column("text"), size, sent.value)
        n = np.diff(starts)
        taken = np.minimum(n, n - (limit * n + 99) // 100 + 1 + n // SHARE)
        ends = np.concatenate([[0], np.cumsum(taken)])
        first = made[np.repeat(starts[:-1] - ends[:-1], taken) + np.arange(ends[-1])].view(np.int64)
        return pa.record_batch([
            batch.column("row_key"), batch.column("id"), pa.array(n), *(pa.array(d.view(np.int64)) for d in _digest(made, starts)),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(first))],
            names=["row_key", "id", "n", "d1", "d2", "prefix"])

    schema = rows.select("row_key", "id", *(F.lit(0).cast("long").alias(c) for c in ("n", "d1", "d2")),
                         F.array(F.lit(0).cast("long")).alias("prefix")).schema
    return rows.mapInArrow(lambda batches: each_step(batches, "text", fill), schema)


def _digest(made: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(mixed(made), starts), _sums(mixed(made ^ _TWIST), starts)


def regions(sets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(region, sid, n): the sets of (sid, n, prefix) around each pivot.

    Take two linked sets, the common shingle that is first in the order, and the one that is k-th.  What they share
    comes from the first on, so the smaller set has it among a few of its first shingles (`early`), the larger one
    before those it may lack (`first`); all but k - 1 of it comes from the k-th on, so both are filed under k of them,
    with k for the smaller size that may link.  Sizes are compared as logarithms, in whole millionths.
    """
    n, at = F.col("n"), F.col("at")
    filed = sets.select("sid", "n", F.posexplode("prefix").alias("at", "shingle")).select(
        "sid", "n", "shingle", (at <= n - F.ceil(n * (2 * limit) / (100 + limit))).alias("early"),
        (at <= n - F.ceil(n * limit / 100)).alias("first"), F.round(F.log("n") * 1_000_000).cast("long").alias("size"))
    width = int(-np.log(limit / 100) * 1_000_000) + 3
    by_size = Window.partitionBy("shingle").orderBy("size")
    early, one = F.col("early").cast("int"), F.lit(1)
    kept = filed.select(
        "*", (F.sum(early).over(by_size.rangeBetween(-width, 0)) - early).alias("smaller"),
        (F.count(one).over(by_size.rangeBetween(0, width)) - 1).alias("larger"),
        (F.count(one).over(by_size.rangeBetween(-width, 0)) - 1).alias("below")).where("larger > 0 or below > 0")
    kept = materialize(kept.withColumn("meets", F.expr("first and (smaller > 0 or early and larger > 0)"))
                       .select("sid", "n", "shingle", "size", "meets"), "filed")
    often = kept.groupBy("sid", "n").count().where(F.col("count") > F.floor(F.floor(n * limit / 100) / SHARE))
    met = kept.where("meets").join(often.select("sid"), "sid", "left_semi")
    gap = F.when(F.col("size") - F.lag("size").over(by_size) > width, 1).otherwise(0)
    runs = met.withColumn("gap", gap).withColumn("run", F.sum("gap").over(by_size))
    pivot = F.min("sid").over(Window.partitionBy("shingle", "run"))
    stars = runs.withColumn("region", pivot).where("region <> sid").select("region", "sid", "n").distinct()
    pivots = stars.select(F.col("region").alias("sid")).distinct().join(sets.select("sid", "n"), "sid")
    return stars.unionByName(pivots.select(F.col("sid").alias("region"), "sid", "n"))


def shared(members: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of `members` with each of `pivots`."""
    value = np.concatenate(pivots)
    owner = np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    probe = np.concatenate(members)
    member = np.repeat(np.arange(len(members)), [len(m) for m in members])
    low = np.searchsorted(value, probe, side="left")
    many = np.searchsorted(value, probe, side="right") - low
    at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    cells = np.repeat(member, many) * len(pivots) + owner[at]
    return np.bincount(cells, minlength=len(members) * len(pivots)).reshape(len(members), len(pivots))


def _in_common(sets: list[np.ndarray], rest: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each of `rest` with each of `every`, where many share most of what they hold.

    Shingles that DENSE sets or more hold are columns of a 0/1 matrix, multiplied with itself; the others are matched
    one by one."""
    size = np.array([len(sets[i]) for i in every])
    value, code, times = np.unique(np.concatenate([sets[i] for i in every]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), size)
    where = np.full(every.max() + 1, -1)
    where[every] = np.arange(len(every))
    common = np.zeros((len(rest), len(every)), np.float32)
    dense = np.cumsum(times >= DENSE) - 1
    for at in range(0, int(dense[-1]) + 1 if len(dense) else 0, 2048):
        here = (times[code] >= DENSE) & (dense[code] >= at) & (dense[code] < at + 2048)
        matrix = np.zeros((len(every), 2048), np.float32)
        matrix[row[here], dense[code[here]] - at] = 1
        common += matrix[where[rest]] @ matrix.T
    sparse = (times[code] < DENSE) & (times[code] > 1)
    row, code = row[sparse], code[sparse]
    thin = np.split(code, np.searchsorted(row, np.arange(1, len(every))))
    step = max(1, MATCHES * len(every) // max(1, int(times[times < DENSE].astype(np.int64) @ times[times < DENSE])))
    for at in range(0, len(rest), step):
        common[at:at + step] += shared([thin[i] for i in where[rest[at:at + step]]], thin)
    return common


def join_region(sets: list[np.ndarray], limit: int = LIMIT) -> Forest:
    """Which of the sets are connected by links, by recursive division around pivots."""
    forest = Forest(len(sets))
    sizes = np.array([len(s) for s in sets])
    r = 1 - limit / 100

    def distances(left: np.ndarray, right: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Distances; links on the way are joined."""
        union = sizes[left][:, None] + sizes[right][None, :] - common
        for i, j in zip(*np.nonzero(100 * common >= limit * union)):
            if left[i] != right[j]:
                forest.join(int(left[i]), int(right[j]))
        return 1 - common / union

    def compare(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        step = max(1, MATCHES // int(sizes[left].sum()))
        members = [sets[i] for i in left]
        return np.concatenate([
            distances(left, part, shared(members, [sets[i] for i in part]))
            for part in (right[at:at + step] for at in range(0, len(right), step))], axis=1)

    def unsettled(some: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Those outside the largest component among them."""
        own, times = np.unique(roots[some], return_counts=True)
        return some[roots[some] != own[times.argmax()]]

    stack = [np.arange(len(sets))]
    while stack:
        some = stack.pop()
        if len(some) < 2 or not len(unsettled(some, forest.roots())):
            continue
        if len(some) <= FEW:
            compare(some, some)
            continue
        compare(some, some[:1])
        rest = unsettled(some, forest.roots())
        if len(rest) <= FEW:
            if len(rest):
                compare(some, rest)
            continue
        pivots = some[::max(1, int(len(some) ** 0.5))]
        distance = compare(some, pivots)
        roots = forest.roots()
        home = distance.argmin(axis=1)
        least = distance[np.arange(len(some)), home]
        near = least < 1 - 2 * r
        reach = np.where(near, least + 2 * r, 1 - r) + 1e-9
        parts = [some[(near & (home == k)) | (distance[:, k] <= reach)] for k in range(len(pivots))]
        parts = [p for p in (*parts, some[~near]) if len(p) > 1 and len(unsettled(p, roots))]
        if 2 * sum(len(p) ** 2 for p in parts) <= len(some) ** 2:
            stack.extend(parts)
            continue
        # No division helps: all that are not connected yet, against all.
        rest = unsettled(some, roots)
        for at in range(0, len(rest), 1024):
            distances(rest[at:at + 1024], some, _in_common(sets, rest[at:at + 1024], some))
    return forest


_SET = ["region", "sid", "raw"]


def _region_links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links of region after region in rows sorted by region and set; only the open region's sets are held."""
    found: list[tuple[int, int]] = []
    open_region, ids, sets = None, [], []

    def close():
        if len(sets) == 2:
            common = len(np.intersect1d(*sets, assume_unique=True))
            if 100 * common >= limit * (len(sets[0]) + len(sets[1]) - common):
                found.append((ids[0], ids[1]))
        elif len(sets) > 2:
            forest = join_region(sets, limit)
            found.extend((ids[i], ids[root]) for i in range(len(ids)) if (root := forest.root(i)) != i)

    def out():
        pairs = np.array(found, np.int64)
        found.clear()
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for region, sid, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if region != open_region:
                close()
                open_region, ids, sets = region, [], []
                if len(found) > 10_000:
                    yield out()
            if not ids or ids[-1] != sid:  # documents with one id may bring a set twice
                ids.append(sid)
                sets.append(np.frombuffer(raw, np.uint64))
    close()
    if found:
        yield out()


def _settled(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Links of the sets of large regions with their pivot, and what then remains of these regions.

    A row's task is chosen by region and set, and each such task is sent the pivot's set, so a large region is spread."""
    salts = 64
    pivots = rows.where("region = sid").dropDuplicates(["region"])
    pivots = pivots.select("region", F.col("raw").alias("pivot"),
                           F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    sized = "region long, sid long, n long, common long, pivot_n long"

    def measure(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("region", "sid", "raw", "pivot")))
            found = [(region, sid, np.frombuffer(raw, np.uint64), np.frombuffer(pivot, np.uint64))
                     for region, sid, raw, pivot in rows]
            common = [len(np.intersect1d(x[2], x[3], assume_unique=True)) for x in found]
            columns = [x[0] for x in found], [x[1] for x in found], [len(x[2]) for x in found], common, [len(x[3]) for x in found]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["region", "sid", "n", "common", "pivot_n"])

    spread = rows.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(salts)).cast("int"))
    joined = spread.join(pivots, ["region", "salt"]).select("region", "sid", "raw", "pivot")
    measured = materialize(joined.mapInArrow(measure, sized), "measured")
    union = F.col("n") + F.col("pivot_n") - F.col("common")
    measured = measured.distinct().select("region", "sid", (F.col("common") * 100 >= union * limit).alias("linked"),
                                          (1 - F.col("common") / union).alias("distance"))
    links = measured.where("linked and region <> sid").select(F.col("region").alias("a"), F.col("sid").alias("b"))
    r = 1 - limit / 100
    outer = measured.where("not linked").groupBy("region").agg(F.min("distance").alias("least"))
    rest = (measured.join(outer, "region")
            .where(~F.col("linked") | (F.col("least") <= F.col("distance") + r + 1e-9))
            .select("region", "sid"))
    return links, rest


def _in_blocks(rest: DataFrame, rows: DataFrame) -> DataFrame:
    """What remains of large regions as regions of two blocks each, any two blocks of a region together."""
    rest = rest.join(rows.dropDuplicates(["region", "sid"]), ["region", "sid"])
    whole = rest.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("raw")).alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") * 2 / REGION), F.ceil(F.col("total") * 2 / REGION_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    pairs = (rest.join(whole.select("region", blocks.alias("blocks")), "region").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    key = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
    return pairs.select(key.alias("region"), "sid", "raw")


def _with_sets(docs: DataFrame, described: DataFrame, around: DataFrame, id_col: str, text_col: str,
               size: int) -> DataFrame:
    """(region, sid, raw): the members of the regions with their sets, made anew from the texts.

    Texts meet the list of a set's regions by their id; the set's digest then tells the right text from others with
    that id.  Where few sets are in regions the list is sent to the texts, else both are shuffled."""
    listed = around.groupBy("sid").agg(F.collect_list("region").alias("regions"))  # as many as shingles in a prefix
    wanted = materialize(described.join(listed, described["row_key"] == listed["sid"])
                         .select(F.col("id").alias("wanted"), "sid", "d1", "d2", "regions"), "wanted")
    few = wanted.count() <= MAX_SENT and (wanted.agg(F.sum(F.size("regions"))).first()[0] or 0) <= 4 * MAX_SENT
    told = docs.select(F.col(id_col).alias("id"), texts(text_col).alias("text"))
    told = told.join(F.broadcast(wanted) if few else wanted, told["id"].eqNullSafe(F.col("wanted"))).drop("id", "wanted")

    def pack(batch):
        starts, made = distinct_shingles(batch.column("text"), size)
        made = np.ascontiguousarray(made)
        right = np.ones(batch.num_rows, bool)
        for name, digest in zip(("d1", "d2"), _digest(made, starts)):
            right &= digest.view(np.int64) == batch.column(name).to_numpy()
        raw = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [
            None, pa.py_buffer((starts * 8).astype(np.int64)), pa.py_buffer(made)])
        regions = batch.column("regions")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(regions).to_numpy(zero_copy_only=False))
        kept = pa.array(np.flatnonzero(right[row]))
        row = pa.array(row).take(kept)
        return pa.record_batch([regions.flatten().take(kept), batch.column("sid").take(row),
                                raw.take(row).cast(pa.binary())], names=_SET)

    return told.mapInArrow(lambda batches: each_step(batches, "text", pack), "region long, sid long, raw binary")


def near_links(docs: DataFrame, described: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               size: int = SHINGLE, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all sets within the limit, and the sets (sid, d1, d2, n)."""
    # One set stands for all documents that equal it.
    named = materialize(described.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row_key").alias("sid")), "sets")
    first = described.join(named.select(F.col("sid").alias("row_key")), "row_key", "left_semi")
    around = materialize(regions(first.select(F.col("row_key").alias("sid"), "n", "prefix"), limit), "regions")
    counted = around.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    large = materialize(counted.where((F.col("m") > REGION) | (F.col("total") * 8 > REGION_BYTES)).select("region"), "large")

    def joined(rows):
        return rows.repartition("region").sortWithinPartitions("region", "sid").mapInArrow(
            lambda batches: _region_links(batches, limit), "a long, b long")

    if large.isEmpty():
        return joined(_with_sets(docs, described, around, id_col, text_col, size)), named
    small = around.join(large, "region", "left_anti")
    rows = materialize(_with_sets(docs, described, around.join(large, "region", "left_semi"), id_col, text_col, size), "raw")
    settled, rest = _settled(rows, limit)
    links = joined(_with_sets(docs, described, small, id_col, text_col, size)).unionByName(settled)
    return links.unionByName(joined(_in_blocks(rest, rows))), named


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
           limit: int = LIMIT) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id that links reach)."""
    described = materialize(describe(docs, rarity(docs, text_col, size), id_col, text_col, size, limit), "shingled")
    links, named = near_links(docs, described, id_col, text_col, size, limit)
    roots = components(materialize(links, "near")).select(F.col("node").alias("sid"), "root")
    key = ["d1", "d2", "n"]
    rooted = materialize(
        described.where("n > 0").groupBy(*key).agg(F.min("id").alias("id")).join(named, key)
        .join(roots, "sid", "left").select(*key, "id", F.coalesce("root", "sid").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    placed = rooted.join(smallest, "root").select(*key, "component_id")
    return described.join(placed, key, "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
