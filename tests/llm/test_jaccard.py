"""The Jaccard join against a plain version that compares every pair of sets."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from advisoryspark.llm import jaccard, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_classes(docs):
    """[(id, set size, smallest id reachable)] with repeated and null ids."""
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    smallest = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted(((d, len(s), smallest.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def got(df, name="id"):
    return sorted(((r[name], r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_classes_of_documents(spark, small):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    want = plain_classes(docs)
    assert any(c != d for d, _, c in want)
    assert got(queries.op13_jaccard(spark, small), "doc_id") == want


def variants(rng, words, n, changes):
    for _ in range(n):
        out = list(words)
        for _ in range(rng.randint(0, changes)):
            k = rng.randrange(len(out))
            out[k:k + 1] = rng.choice([[], [f"n{rng.random()}"], [out[k], f"m{rng.random()}"]])
        yield " ".join(out)


@pytest.fixture(scope="module")
def planted():
    """Chains of near copies, copies, a passage most documents share, and texts about the limit."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = []
    for c in range(6):
        base = [f"c{c}w{k}" for k in range(rng.choice([6, 20, 60, 120]))]
        texts += list(variants(rng, base, 25, max(1, len(base) // 12)))
    texts += [f"{passage} " + " ".join(f"u{i}x{k}" for k in range(rng.randint(1, 30))) for i in range(40)]
    line = [f"s{k}" for k in range(103)]
    texts += [" ".join(line[k:k + 100]) for k in range(4)] + [" ".join(line[:k]) for k in range(1, 103, 3)]
    texts += texts[:20] + ["one two", "One  TWO", "one two three", "", None, " \n"]
    rng.shuffle(texts)
    return [(k * 7 % 1000, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("region, few", [(4096, 24), (4096, 2), (10, 24), (3, 2)])
def test_planted_classes(spark, planted, monkeypatch, region, few):
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "FEW", few)
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(4)
    assert got(jaccard.assign(docs)) == plain_classes(planted)


@pytest.mark.parametrize("few", [2, 24])
def test_region_is_joined_exactly(monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = np.random.default_rng(few)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 62, rng.integers(5, 80)).astype(np.uint64)
        for _ in range(rng.integers(1, 25)):
            kept = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.4])]
            fresh = rng.integers(0, 1 << 62, rng.integers(1, 4)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([kept, fresh])))
    forest = jaccard.join_region(sets)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert [forest.root(i) for i in range(len(sets))] == root


def test_cases(spark):
    long = "lorem ipsum dolor sit amet " * 20_000 + " ".join(f"w{k}" for k in range(3000))
    rows = [(1, "plain words here"), (1, "plain words here"), (2, ""), (3, None), (None, "no id here"), (None, "no id here"),
            (None, None), (4, long), (5, long + " end"), (6, "plain words here")]
    docs = spark.createDataFrame([(*r, 3, 4, "p") for r in rows], "doc_id long, text string, id long, n long, prefix string")
    assert got(jaccard.assign(docs)) == plain_classes(rows)
    assert jaccard.assign(docs.limit(0)).count() == 0
