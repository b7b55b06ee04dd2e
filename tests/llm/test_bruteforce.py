"""Queries without SQL against plain sequential versions over whole small tables."""

import binascii
import collections
import hashlib
import math
import re
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from advisoryspark.llm import lm, packing, pii, queries, simhash, suffix

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(small):
    return pq.read_table(f"{small}/documents.parquet").to_pylist()


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def plain_fingerprint(text):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, small, docs):
    got = rows(queries.op2_simhash(spark, small))
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    ids = sorted(prints)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {
        i: (f"{prints[i]:016x}", root[i]) for i in ids}


def test_gray_index_finds_every_link():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = set(int(x) for x in seeds)
    for s in seeds:
        for _ in range(30):
            bits = rng.integers(0, 64, rng.integers(1, 5))
            values.add(int(s) ^ sum(1 << int(b) for b in set(bits.tolist())))
    values = np.array(sorted(values), np.uint64)
    found = {(min(i, j), max(i, j)) for a, b in simhash.linked_pairs(values, 2, (1 << 64) - 1)
             for i, j in zip(a.tolist(), b.tolist())}
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    assert found == {(i, j) for i, j in zip(*np.nonzero(apart <= 2)) if i < j}


def test_split_nodes_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (120, 3))})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, fp long")

    def classes():
        return {r.id: r.component_id for r in simhash.assign(df).collect()}

    whole = classes()
    monkeypatch.setattr(simhash, "SPLIT_OVER", 3)
    assert classes() == whole
    root = list(range(len(values)))
    for _ in values:
        for i in range(len(values)):
            for j in range(i):
                if (values[i] ^ values[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    assert whole == dict(enumerate(root))


def luhn(d):
    return sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate((
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or
                    kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or
                    kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            found.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_base_personal_data(spark, small, docs):
    got = rows(queries.op7_pii(spark, small))
    for d in docs:
        want = plain_spans(d["text"] or "")
        row = got[d["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in row["spans"].split(",") if s and not s.startswith("term")] == want
        assert [row[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(w.startswith(k) for w in want) for k in pii.KINDS[:4]]


def plain_removed(texts, length):
    seen = collections.Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_repeated_strings(spark, small, docs):
    got = rows(queries.op8_suffix(spark, small))
    want = plain_removed([(d["text"] or "").encode() for d in docs], 400)
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [tuple(got[d["doc_id"]][n] for n in names) for d in docs] == want


def test_repeated_strings_at_every_border(spark, table):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, other = word(900), word(410)
    texts = [word(50) + shared + word(30), word(7) + shared[:401], shared[100:550] + word(90), shared[499:899],
             shared[500:899] + "x", other + word(20) + other, "a" * 1500, "a" * 400, word(399), "", None, "é" * 300,
             shared + other[:399] + word(5), word(3) + other[5:405] + shared[3:403] + word(2)]
    df = table(texts)
    got = {r.id: r for r in suffix.measure(df).collect()}
    want = plain_removed([(t or "").encode() for t in texts], 400)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want


def test_packing(spark, small, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d["doc_id"]: tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0] for d in docs}
    pieces = queries.op9_packing(spark, small).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for doc, found in by_doc.items():
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[doc])
            ids = np.array(want[doc][at:at + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(ids.tobytes())
            at += p.length
        assert at == len(want[doc])
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    tokens = sum(p.length for p in pieces)
    assert tokens >= 0.97 * 1024 * (len(by_sequence) - 1)


def test_word_encoder_equals_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["", " ", "a b", "a  b", "a   b ", "it's  we'll\n\n x", " lead", "tab\t x", "a \n b\n ", "a  b   c",
             "<|endoftext|> x", "é è 12 34.5!", "a \n  b", "x ", "\n", "日本 語", "a\x1c b \x85 c", "x½y ²3 ªb µ· ßÆ\u0180ǂ 'll 's's don't «là»",
             "\x00\x01 \x7f a", " ".join(map(chr, range(1, 0x260))), "".join(map(chr, range(1, 0x260)))]
    starts, ids = encoder.encode(pa.array([t.encode() for t in texts]))
    got = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_plain_texts_are_encoded_as_by_the_tokenizer():
    """Texts of all characters for which ranked merges stand in for the tokenizer."""
    encoder = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.ranked is not None
    rng = np.random.default_rng(8)
    every = ["\n", *map(chr, range(0x20, 0x7F)), *map(chr, range(0xA1, 0x250))]
    common = [*" \n\n  ''''sSdDtTreREveVEmMllLL0129.,-!?_éßªº²½×÷", "'s", "'re", "'LL", " 'd"]
    texts = ["".join(rng.choice(pool, rng.integers(0, 60))) for pool in (every, common, every[:96]) for _ in range(700)]
    texts += ["a" * 30_000, " " * 5000, "\n" * 999 + "x", "é" * 20_000, "<|endoftext|> <|endoftext", "".join(every)]
    starts, ids = encoder.encode(pa.array(texts))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text, x, y in zip(texts, starts[:-1].tolist(), starts[1:].tolist()):
        assert ids[x:y].tolist() == whole.encode(text, add_special_tokens=False).ids + [0], text


@pytest.mark.parametrize("head", [1 << 20, 64])
def test_language_model_base(spark, small, docs, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    got = rows(queries.op6_maxent(spark, small))
    words = {d["doc_id"]: SPACE.findall((d["text"] or "").translate(LOWER)) + [None] for d in docs}
    held = {i: binascii.crc32(str(i).encode()) % 10 == 0 for i in words}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(ws), n)
        assert r["n_known"] == sum(count[w] > 0 for w in ws)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    unseen = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def plain_gradient_steps(weights, bias, power, rows, kinds):
    for at in range(0, len(kinds), lm.STEP):
        piece, kind = rows[at:at + lm.STEP], kinds[at:at + lm.STEP]
        scores = weights[piece[:, 0]] + weights[piece[:, 1]] + weights[piece[:, 2]] + bias
        scores -= scores.max(axis=1, keepdims=True)
        off = np.exp(scores - np.log(np.exp(scores).sum(axis=1, keepdims=True)))
        off[np.arange(len(kind)), kind] -= 1
        bias -= lm.RATE * off.mean(axis=0)
        for column in piece.T:
            order = np.argsort(column.astype(np.uint16), kind="stable")
            cuts = np.flatnonzero(np.diff(column[order], prepend=-1))
            row, total = column[order][cuts], np.add.reduceat(np.take(off, order, axis=0), cuts, axis=0)
            power[row] += (total * total).mean(axis=1)
            weights[row] -= lm.RATE * total / np.sqrt(power[row] + 1)[:, None]


def test_gradient_steps_are_plain_and_cheap(monkeypatch):
    """The same bits as plain sums, rows once, a few times and often in a step; reduceat, slow for short runs, gets
    only rows that occur more than eight times."""
    rng, handed = np.random.default_rng(3), []

    class Add:
        @staticmethod
        def reduceat(lines, cuts, axis):
            handed.append(np.diff(cuts, append=len(lines)).min())
            return np.add.reduceat(lines, cuts, axis=axis)

    often, few = rng.integers(0, 40, (20_000, 3)), rng.integers(0, 6000, (20_000, 3))
    mixed = np.where(rng.random((20_000, 3)) < 0.3, often, few)
    for rows in (mixed, mixed[:1], mixed[:0], np.arange(300).reshape(100, 3), np.zeros((4097, 3), np.int64)):
        kinds = rng.integers(0, lm.CLASSES, len(rows))
        want, got = ([np.zeros((lm.ROWS, lm.CLASSES), np.float32), np.zeros(lm.CLASSES, np.float32),
                      np.zeros(lm.ROWS, np.float32)] for _ in range(2))
        plain_gradient_steps(*want, rows, kinds)
        with monkeypatch.context() as patch:
            patch.setattr(lm, "np", types.SimpleNamespace(**{**vars(np), "add": Add}))
            lm.gradient_steps(*got, rows, kinds)
        assert all((x == y).all() for x, y in zip(want, got))
    assert handed and min(handed) > 8


def test_language_model_classes(spark, table):
    """The 23 most frequent words are classes of their own, and 64 classes are told apart."""
    texts = [" ".join(f"word{k}" for k in range(40) for _ in range(1 + (40 - k) // (1 + i % 2))) for i in range(4)]
    vocabulary, _ = lm.learn_vocabulary(table(texts).select(lm.texts("text").alias("text")))
    assert len(vocabulary.class_tokens) == 64 and sorted(vocabulary.single.values()) == list(range(23))
    assert set(vocabulary.single) == {xxhash.xxh64_intdigest(f"word{k}") for k in range(23)}
    assert (vocabulary.class_types[:23] == 1).all() and vocabulary.ending_class.min() >= 23
