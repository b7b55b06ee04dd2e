"""Language model: hashed maximum entropy with a class-factored softmax (free style: numpy inside tasks).

log P(text) = sum over tokens of log P(class | history) + log P(token | class).
The class probability is a softmax over CLASSES scores, each the sum of a bias
and of weights hashed from the previous word, the previous two words, and the
word before the previous one (skip).  Inside its class a token has its smoothed
share of the class's training tokens, unseen words together counting as one type.

Training covers every training document.  One pass counts words and pairs of
neighbouring word endings; the most frequent words are classes of their own,
other words fall into classes by their ending, endings with like neighbours in
one class.  Then in each round every task takes its documents of the round,
makes gradient steps from the common weights, and its change goes out in blocks
of rows that are summed per block; the mean change of a row over the tasks that
touched it is added.  Per round and task as many bytes as the weights have move.

Counts of the most frequent words (HEAD at most) are broadcast as hash and count;
all other words of a text are joined with their counts, so no count is lost.

Defined cases: null and empty texts are the end token alone; a null id counts as
held out; repeated rows are scored each on its own and all are learned from;
without training documents every token has the base share of an unseen one;
an empty table gives an empty result; other columns are ignored; of equally frequent
words the first in order becomes a class; a very long text is read whole.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisoryspark.llm.common import each_step, fold_table, materialize, mixed, texts, word_hashes, word_table

CLASSES = 64
#: Frequent words that are classes of their own; the last class is the end of the text.
SINGLE = 23
ENDINGS = 512
#: Hashed rows of weights; they are sorted as 16-bit numbers.
ROWS = 1 << 15
BLOCK = 1 << 10
#: Words whose counts are broadcast at most (16 bytes each).
HEAD = 1 << 20
ROUNDS, STEP, RATE = 2, 4096, 0.3
#: Rows that occur up to so often in a step are summed place by place. reduceat adds so few in the same order.
FEW = 8
SMOOTH = 0.1
LOWER = fold_table()
_START = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xC2B2AE3D27D4EB4F)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Vocabulary:
    """Counts of frequent words by hash, classes, and the totals of the classes."""

    hashes: np.ndarray
    counts: np.ndarray
    least: int  # every word with this count or more is among the hashes
    single: dict
    ending_class: np.ndarray
    tokens: int
    types: int
    documents: int
    class_tokens: np.ndarray | None = None
    class_types: np.ndarray | None = None

    def classes(self, distinct: pa.Array, hashes: np.ndarray) -> np.ndarray:
        found = self.ending_class[endings(distinct)]
        for h, k in self.single.items():
            found[hashes == np.uint64(h)] = k
        return found

    def in_class(self, count, kind):
        """log10 of the smoothed share of tokens with `count` in their class."""
        return np.log10((count + SMOOTH) / (self.class_tokens[kind] + SMOOTH * (self.class_types[kind] + 1)))

    def base(self, count):
        return np.log10((count + SMOOTH) / (self.tokens + SMOOTH * (self.types + 1)))


def endings(distinct: pa.Array) -> np.ndarray:
    """Bucket of each word by its last three characters."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    tails = pc.utf8_slice_codeunits(distinct, -3).dictionary_encode()
    bucket = np.array([zlib.crc32(t.encode()) % ENDINGS for t in tails.dictionary.to_pylist()], np.int64)
    return bucket[tails.indices.to_numpy()]


@dataclass
class Sequence:
    """Tokens of a run of texts: the words and the end of each text."""

    starts: np.ndarray  # first token of each text, and the end
    token: np.ndarray  # number of the distinct word; len(distinct) for the end
    text: np.ndarray
    distinct: pa.Array
    hashes: np.ndarray


def sequence(column: pa.Array) -> Sequence:
    starts, codes, distinct = word_table(column, LOWER)
    n = len(starts) - 1
    token = np.full(len(codes) + n, len(distinct), np.int64)
    text = np.repeat(np.arange(n), np.diff(starts))
    token[np.arange(len(codes)) + text] = codes
    starts = starts + np.arange(n + 1)
    return Sequence(starts, token, np.repeat(np.arange(n), np.diff(starts)), distinct,
                    np.append(word_hashes(distinct), _END))


def history_rows(seq: Sequence, rows: int) -> np.ndarray:
    """The three hashed rows of each token's history."""
    own = seq.hashes[seq.token]
    first = seq.starts[:-1]
    back1, back2 = np.roll(own, 1), np.roll(own, 2)
    back1[first] = back2[first] = _START
    second = first[np.diff(seq.starts) > 1] + 1
    back2[second] = _START
    keys = (back1, back2 * _FACTOR + back1, back2 + np.uint64(1))
    return np.stack([(mixed(k * np.uint64(2 * i + 3)) & np.uint64(rows - 1)).astype(np.int64)
                     for i, k in enumerate(keys)], axis=1)


def class_scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the classes, the largest of a token zero, and the log of the sum of their exponentials."""
    scores = np.take(weights, rows[:, 0], axis=0)
    scores += np.take(weights, rows[:, 1], axis=0)
    scores += np.take(weights, rows[:, 2], axis=0)
    scores += bias
    scores -= scores.max(axis=1, keepdims=True)
    return scores, np.log(np.exp(scores).sum(axis=1))


def sums_by_row(off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers among `rows`, and for each the sum of its lines of `off`."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    row = rows[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(first, append=len(row))
    total = np.take(off, order[first], axis=0)
    few = np.flatnonzero((size > 1) & (size <= FEW))
    few = few[np.argsort(-size[few], kind="stable")]
    rest = np.take(off, order[first[few] + 1], axis=0)
    for k in range(2, FEW):
        left = few[:np.count_nonzero(size[few] > k)]
        rest[:len(left)] += np.take(off, order[first[left] + k], axis=0)
    total[few] += rest
    many = size > FEW
    if many.any():
        cuts = np.cumsum(size[many]) - size[many]
        total[many] = np.add.reduceat(np.take(off, order[np.repeat(many, size)], axis=0), cuts, axis=0)
    return row[first], total


def gradient_steps(weights: np.ndarray, bias: np.ndarray, power: np.ndarray, rows: np.ndarray, kinds: np.ndarray):
    """Steps over consecutive pieces of tokens; weights, bias and `power` (sums of squares per row) change in place."""
    for at in range(0, len(kinds), STEP):
        piece, kind = rows[at:at + STEP], kinds[at:at + STEP]
        off, log_sum = class_scores(weights, bias, piece)
        off -= log_sum[:, None]
        np.exp(off, out=off)
        off[np.arange(len(kind)), kind] -= 1
        bias -= RATE * off.mean(axis=0)
        for column in range(piece.shape[1]):
            row, total = sums_by_row(off, piece[:, column])
            power[row] += np.square(total).mean(axis=1)
            total *= RATE
            total /= np.sqrt(power[row] + 1)[:, None]
            weights[row] = np.take(weights, row, axis=0) - total


def count_corpus(train: DataFrame) -> DataFrame:
    """(kind, word, n): counts of words (kind 0) and of neighbouring ending pairs (kind 1), summed in each step first."""
    def count(batch):
        seq = sequence(batch.column("text"))
        n = np.bincount(seq.token, minlength=len(seq.distinct) + 1)
        kind = np.append(endings(seq.distinct), 0)
        inside = (seq.text[1:] == seq.text[:-1]) & (seq.token[1:] < len(seq.distinct))
        pairs = np.bincount((kind[seq.token[:-1]] * ENDINGS + kind[seq.token[1:]])[inside], minlength=1)
        used = np.flatnonzero(pairs)
        return pa.record_batch([
            pa.array(np.repeat([0, 1], [len(seq.distinct), len(used)]).astype(np.int32)),
            pa.concat_arrays([seq.distinct.cast(pa.string()), pa.array([*map(str, used.tolist())], pa.string())]),
            pa.array(np.concatenate([n[:-1], pairs[used]]).astype(np.int64))], names=["kind", "word", "n"])

    return (train.select("text").mapInArrow(lambda it: each_step(it, "text", count), "kind int, word string, n long")
            .groupBy("kind", "word").agg(F.sum("n").alias("n")))


def cluster_endings(pairs: np.ndarray, classes: int) -> np.ndarray:
    """Class of each ending: k-means over the square roots of its neighbours' shares, from the largest endings."""
    both = pairs + pairs.T
    profile = np.sqrt(both / np.maximum(both.sum(axis=1, keepdims=True), 1))
    weight = both.sum(axis=1)
    centers = profile[np.argsort(-weight, kind="stable")[:classes]].copy()
    for _ in range(20):
        near = (profile @ centers.T).argmax(axis=1)
        for k in range(classes):
            total = (profile[near == k] * weight[near == k, None]).sum(axis=0)
            norm = np.linalg.norm(total)
            if norm > 0:
                centers[k] = total / norm
    return near


def learn_vocabulary(train: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Vocabulary and the table (word, n) of all training words."""
    counted = materialize(count_corpus(train), "counts")
    words = counted.where("kind = 0").select("word", "n")
    powers = [F.count(F.when(F.col("n") >= (1 << k), 1)).alias(f"p{k}") for k in range(63)]
    row = words.agg(F.sum("n").alias("tokens"), F.count("n").alias("types"), *powers).first()
    least = next(1 << k for k in range(63) if row[f"p{k}"] <= HEAD)
    documents = train.count()
    head = words.where(F.col("n") >= least).toArrow()  # HEAD words at most
    hashes, counts = word_hashes(head.column("word").combine_chunks()), head.column("n").to_numpy()
    order = np.argsort(hashes)
    top = words.orderBy(F.desc("n"), "word").limit(SINGLE).collect()
    single = {int(word_hashes(pa.array([r.word]))[0]): k for k, r in enumerate(top)}
    cells = np.zeros(ENDINGS * ENDINGS)
    for r in counted.where("kind = 1").collect():  # ENDINGS squared at most
        cells[int(r.word)] = r.n
    ending_class = SINGLE + cluster_endings(cells.reshape(ENDINGS, ENDINGS), CLASSES - SINGLE - 1)
    vocabulary = Vocabulary(hashes[order], counts[order], least, single, ending_class, (row.tokens or 0) + documents,
                            row.types + (documents > 0), documents)
    sent = train.sparkSession.sparkContext.broadcast(dict(vars(vocabulary)))

    def total(batches):
        known = Vocabulary(**sent.value)
        tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            distinct = batch.column("word")
            kind = known.classes(distinct, word_hashes(distinct))
            tokens += np.bincount(kind, batch.column("n").to_numpy(), minlength=CLASSES).astype(np.int64)
            types += np.bincount(kind, minlength=CLASSES)
        yield pa.record_batch([pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(types)],
                              names=["kind", "tokens", "types"])

    vocabulary.class_tokens, vocabulary.class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    summed = words.mapInArrow(total, "kind long, tokens long, types long").groupBy("kind").sum("tokens", "types")
    for kind, tokens, types in summed.collect():
        vocabulary.class_tokens[kind], vocabulary.class_types[kind] = tokens, types
    vocabulary.class_tokens[-1], vocabulary.class_types[-1] = documents, int(documents > 0)
    return vocabulary, words


def kinds(vocabulary: Vocabulary, seq: Sequence) -> np.ndarray:
    return np.append(vocabulary.classes(seq.distinct, seq.hashes[:-1]), CLASSES - 1)


def learn_weights(train: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after `rounds` rounds that together read each training document once."""
    spark = train.sparkSession
    share = (vocabulary.class_tokens + 1) / (vocabulary.class_tokens + 1).sum()
    weights, bias = np.zeros((ROWS, CLASSES), np.float32), np.log(share).astype(np.float32)
    known = spark.sparkContext.broadcast(dict(vars(vocabulary)))
    for r in range(rounds):
        common = spark.sparkContext.broadcast((weights, bias))

        def steps(batches):
            start, start_bias = common.value
            own, own_bias, power = start.copy(), start_bias.copy(), np.zeros(ROWS, np.float32)
            seen, words = False, Vocabulary(**known.value)
            for batch in each_step(batches, "text", lambda b: b):
                seq = sequence(batch.column("text"))
                gradient_steps(own, own_bias, power, history_rows(seq, ROWS), kinds(words, seq)[seq.token])
                seen = True
            if not seen:
                return
            own -= start
            for block in range(ROWS // BLOCK):
                at = slice(block * BLOCK, (block + 1) * BLOCK)
                yield pa.record_batch([
                    pa.array([block], pa.int32()), pa.array([own[at].tobytes()], pa.binary()),
                    pa.array([(power[at] > 0).astype(np.float32).tobytes()], pa.binary())], names=_CHANGE)
            yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([(own_bias - start_bias).tobytes()], pa.binary()),
                                   pa.array([np.ones(1, np.float32).tobytes()], pa.binary())], names=_CHANGE)

        mine = train.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text")
        summed = (mine.mapInArrow(steps, _CHANGE_TYPE).repartition("block").mapInArrow(_sum_changes, _CHANGE_TYPE))
        for row in summed.collect():  # the size of the weights
            change, tasks = np.frombuffer(row.change, np.float32), np.frombuffer(row.tasks, np.float32)
            mean = change.reshape(len(tasks), -1) / np.maximum(tasks, 1)[:, None]
            if row.block < 0:
                bias = bias + mean[0]
            else:
                weights[row.block * BLOCK:(row.block + 1) * BLOCK] += mean
        common.unpersist()
    return weights, bias


_CHANGE = ["block", "change", "tasks"]
_CHANGE_TYPE = "block int, change binary, tasks binary"


def _sum_changes(batches):
    """Sums per block; a task holds at most the size of all weights."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, *parts in zip(*(batch.column(k).to_pylist() for k in _CHANGE)):
            parts = [np.frombuffer(p, np.float32) for p in parts]
            total[block] = [a + b for a, b in zip(total[block], parts)] if block in total else parts
    for block, (change, tasks) in total.items():
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([change.tobytes()], pa.binary()),
                               pa.array([tasks.tobytes()], pa.binary())], names=_CHANGE)


_SCORED = ["row_key", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "times", "kind"]


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows outside `held_out` and score all: id, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed unigrams) and score, both log10 probabilities of the whole text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("id"),
                       held_out.alias("held_out"), texts(text_col).alias("text"))
    train = rows.where(~F.col("held_out"))
    vocabulary, words = learn_vocabulary(train)
    weights, bias = learn_weights(train, vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((dict(vars(vocabulary)), weights, bias))

    def measure(known, table, offset, batch):
        seq = sequence(batch.column("text"))
        kind = kinds(known, seq)
        place = np.minimum(np.searchsorted(known.hashes, seq.hashes[:-1]), max(len(known.hashes) - 1, 0))
        found = known.hashes[place] == seq.hashes[:-1] if len(known.hashes) else np.zeros(len(place), bool)
        count = np.append(np.where(found, known.counts[place], 0) if len(known.counts) else np.zeros(len(place)),
                          known.documents)
        sure = np.append(found, True)
        history = history_rows(seq, ROWS)
        token_kind = kind[seq.token]
        model = np.empty(len(seq.token))
        for at in range(0, len(model), STEP):
            piece = slice(at, at + STEP)
            scores, log_sum = class_scores(table, offset, history[piece])
            model[piece] = scores[np.arange(len(scores)), token_kind[piece]] - log_sum
        model *= np.log10(np.e)
        settled = sure[seq.token]
        model += np.where(settled, known.in_class(count, kind)[seq.token], 0)
        base = np.where(settled, known.base(count)[seq.token], 0)
        n = batch.num_rows
        total = [np.bincount(seq.text, x, minlength=n) for x in (
            settled & (count > 0)[seq.token], base, model)]
        # Words outside the broadcast counts go on, once per text with the times they occur.
        open_pairs = (seq.text[~settled] * (len(seq.distinct) + 1)) + seq.token[~settled]
        pair, times = np.unique(open_pairs, return_counts=True)
        text, token = pair // (len(seq.distinct) + 1), pair % (len(seq.distinct) + 1)
        keys = batch.column("row_key").to_numpy()
        rest = len(pair)
        padded = lambda x, fill, kind: pa.array(np.concatenate([x, np.full(rest, fill)]).astype(kind))
        return pa.record_batch([
            pa.array(np.concatenate([keys, keys[text]])),
            pa.concat_arrays([batch.column("id"), pa.nulls(rest, batch.column("id").type)]),
            pa.concat_arrays([batch.column("held_out"), pa.nulls(rest, pa.bool_())]),
            padded(np.diff(seq.starts), 0, np.int64), padded(total[0], 0, np.int64), padded(total[1], 0, np.float64),
            padded(total[2], 0, np.float64),
            pa.concat_arrays([pa.nulls(n, pa.string()), seq.distinct.take(pa.array(token)).cast(pa.string())]),
            pa.array(np.concatenate([np.zeros(n), times]).astype(np.int64)),
            pa.array(np.concatenate([np.zeros(n), kind[token]]).astype(np.int32))], names=_SCORED)

    # The rows of single words have no id and no side.
    kinds_of = ("boolean", "long", "long", "double", "double", "string", "long", "int")
    schema = rows.select("row_key", "id", *(F.lit(None).cast(t).alias(c) for c, t in zip(_SCORED[2:], kinds_of))).schema

    def run(batches):
        held, table, offset = sent.value
        known = Vocabulary(**held)
        return each_step(batches, "text", lambda batch: measure(known, table, offset, batch))

    made = materialize(rows.mapInArrow(run, schema), "scored")
    whole = made.where("word is null").drop("word", "times", "kind")
    rare = words.where(F.col("n") < vocabulary.least)
    count = F.coalesce(F.col("n"), F.lit(0)) + SMOOTH
    per_class = F.array(*(F.lit(float(t + SMOOTH * (v + 1)))
                          for t, v in zip(vocabulary.class_tokens, vocabulary.class_types)))
    denominator = float(vocabulary.tokens + SMOOTH * (vocabulary.types + 1))
    times = F.col("times")
    rest = (made.where("word is not null").select("row_key", "word", "times", "kind").join(rare, "word", "left")
            .select("row_key", F.lit(None).cast(whole.schema["id"].dataType).alias("id"),
                    F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
                    F.when(F.col("n") > 0, times).otherwise(0).alias("n_known"),
                    (times * F.log10(count / denominator)).alias("base_score"),
                    (times * F.log10(count / per_class[F.col("kind")])).alias("score")))
    return (whole.unionByName(rest).groupBy("row_key")
            .agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
                 F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"),
                 F.sum("score").alias("score"))
            .withColumn("train_tokens", F.lit(int(vocabulary.tokens)).cast("long")).drop("row_key"))
