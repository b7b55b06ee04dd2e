"""Spelling variants against a plain version that looks for every pair of words."""

import collections
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from advisoryspark.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_vocabulary(docs):
    total = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def plain_variants(words):
    """All pairs, found among words that share what is left after leaving one code point out."""
    left = collections.defaultdict(set)
    for w in words:
        left[w].add(w)
        for k in range(len(w)):
            left[w[:k] + w[k + 1:]].add(w)
    near = collections.defaultdict(set)
    for some in left.values():
        for a in some:
            near[a] |= {b for b in some if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("folder", ["small", "sf"])
def test_variants_of_documents(spark, folder, request):
    path = request.getfixturevalue(folder)
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{path}/documents.parquet").to_pylist()]
    want = plain_variants(plain_vocabulary(docs))
    assert len(want) > 100 and any(v[0] for v in want.values())
    assert got(queries.op12_spelling(spark, path)) == want


@pytest.mark.parametrize("cell", [1, 3, 2000])
def test_cut_cells_lose_and_repeat_no_pair(spark, cell):
    rng = random.Random(cell)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))): rng.randint(3, 40) for _ in range(700)}
    words |= {"commonstart" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 5))): 3 + k for k in range(300)}
    words |= {"a" * k: 3 * k for k in range(5, 30)} | {"ÿ" * 5: 4, "ÿ" * 6: 9}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert got(spelling.variants(table, cell)) == plain_variants(words)


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted(["tap", "taps", "top", "tops", "a", "tape", ""])
    acceptor = spelling.Acceptor(words)
    assert acceptor.count[0] == len(words)
    reached, stack = set(), [0]
    while stack:
        state = stack.pop()
        reached.add(state)
        stack += [t for t, _ in acceptor.arcs[state].values()]
    right = {}

    def accepted(state):
        return ({""} if acceptor.final[state] else set()) | {
            c + x for c, (t, _) in acceptor.arcs[state].items() for x in accepted(t)}
    for state in reached:
        right.setdefault(frozenset(accepted(state)), []).append(state)
    assert all(len(states) == 1 for states in right.values())
    for number, word in enumerate(words):
        state, at = 0, 0
        for c in word:
            state, skip = acceptor.arcs[state][c]
            at += skip
        assert at == number and acceptor.final[state]
    pairs = {tuple(sorted((words[i], words[j]))) for i, j in spelling.composed(acceptor, True)}
    assert pairs == {tuple(sorted((a, b))) for a in words for b in words if one_edit(a, b)}


def test_cases(spark):
    schema = "doc_id long, text string, word string, n long, key string"
    long = "q" * 40_000
    rows = [(1, None), (2, ""), (None, "Naïve naïve NAÏVE naive naive naive naive naive naive"), (3, "1234 _ 日本語 Ωmega"),
            (4, f"{long} {long}x {long} {long}x {long} {long}x"), (5, "color color color color color color colour"),
            (5, "colour"), (5, "colour"), (6, "×÷×÷×"), (6, "×÷×÷×"), (6, "×÷×÷×")]
    docs = spark.createDataFrame([(*r, "w", 1, "k") for r in rows], schema).repartition(3)
    words = plain_vocabulary(rows)
    assert got(spelling.group(docs)) == plain_variants(words) and long in words
    assert spelling.group(docs.limit(0)).count() == 0
    assert got(spelling.group(docs.where(F.col("doc_id") <= 2))) == {}


def test_roots_of_long_chains(spark):
    steps = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(45)], "word string, root string")
    assert {r.word: r.root for r in spelling.last_forms(steps).collect()} == {f"w{k}": "w45" for k in range(45)}
