"""Cross-tokenizer alignment against a plain version that overlaps byte ranges pair by pair."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from tokenizers import Tokenizer

from advisoryspark.llm import alignment, queries

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte, extra = {}, 0
        for value in range(256):
            self.byte[chr(value) if value in keep else chr(256 + extra)] = value
            extra += value not in keep

    def tokens(self, text):
        """Tokens of A and B as (id, start, end), or two empty lists."""
        if not text:
            return [], []
        ids = [self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)]
        spelled = [[bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in ids[0]],
                   [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                    for i in ids[1] for p in [self.b.id_to_piece(i)]]]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            return [], []
        out = []
        for side, parts in zip(ids, spelled):
            at, rows = 0, []
            for i, part in zip(side, parts):
                rows.append((i, at, at + len(part)))
                at += len(part)
            out.append(rows)
        return out

    def documents(self, texts):
        told = [self.tokens(t) for t in texts]
        links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else
                 self.sweep(a, b) for a, b in told]
        count = collections.Counter(x for rows in links for x in rows)
        best = collections.Counter()
        for (_, y), n in count.items():
            best[y] = max(best[y], n)
        for (a, b), rows in zip(told, links):
            cuts = sorted({x[2] for x in a} & {y[2] for y in b})
            groups, low = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(t[0]) for t in side if low < t[2] <= cut) for side in (a, b))
                              if len(a) < 3000 else None)
                low = cut
            if len(a) >= 3000:
                groups = self.swept_groups(a, b, set(cuts))
            yield (len(a), len(b), len(groups), len(rows), sum(count[x] == best[x[1]] for x in rows),
                   sum(count[x] for x in rows), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")

    @staticmethod
    def sweep(a, b):
        rows, k = [], 0
        for x in a:
            while b[k][2] <= x[1]:
                k += 1
            j = k
            while j < len(b) and b[j][1] < x[2]:
                rows.append((x[0], b[j][0]))
                j += 1
        return rows

    @staticmethod
    def swept_groups(a, b, cuts):
        sides = []
        for side in (a, b):
            parts = [[]]
            for t in side:
                parts[-1].append(str(t[0]))
                if t[2] in cuts:
                    parts.append([])
            sides.append([",".join(p) for p in parts[:-1]])
        return ["|".join(x) for x in zip(*sides)]


def digests(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum,
                                                       r.groups_sha256)) for r in df.collect())


def test_alignment_of_documents(spark, small):
    docs = pq.read_table(f"{small}/documents.parquet").to_pylist()
    want = sorted(((False, d["doc_id"]), row) for d, row in zip(docs, Plain().documents([d["text"] for d in docs])))
    assert digests(queries.op11_alignment(spark, small)) == want


HARD = ["", None, " ", "a", " a", "a ", "a  b", "  a", "x\n y\t z", "<|endoftext|> <s> </s> <unk> <0x41>", "café naïve", "▁x",
        "x▁y z", "日本語 テキスト", "\U0001f600 smile \U0001f600\U0001f600", "it's we'll I'd 's", "1234 56,7", "\x00 nul \x7f",
        "word " * 300, "a" * 5000, "\r\n\r\n  indented", " nbsp   x", "é combining", "it's we'll I'd 's", "﻿bom"]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 7, "x", "p") for i, t in enumerate(texts)],
                                 "doc_id long, text string, id long, groups string, pair string").repartition(3)


def test_alignment_of_hard_texts(spark, monkeypatch):
    plain = list(Plain().documents(HARD))
    assert plain[0] == plain[1] == (0, 0, 0, 0, 0, 0, "") and plain[11][0] == 0 and plain[9][0] > 0

    def aligned():
        return {r.id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups.decode())
                for r in alignment.align_documents(rows(spark, HARD), A, B, digest=True).collect()}
    assert aligned() == dict(enumerate(plain))
    for head in (0, 40):  # with no or few counts broadcast, the rest is joined
        monkeypatch.setattr(alignment, "HEAD", head)
        assert aligned() == dict(enumerate(plain))


def test_alignment_groups_and_cases(spark):
    both = rows(spark, ["tokenizers differ", None])
    got = {r.id: r for r in alignment.align_documents(both, A, B).collect()}
    assert set(got[0].asDict()) == {"id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"}
    assert got[0].groups.decode().count("|") == got[0].n_groups and got[1].groups == b""
    assert alignment.align_documents(both.limit(0), A, B).count() == 0
    odd = spark.createDataFrame([(None, "same text"), (None, "same text"), (3, "same text")], "doc_id long, text string")
    assert [r.n_a for r in alignment.align_documents(odd, A, B).collect()] == [2, 2, 2]


def test_each_distinct_window_is_aligned_once():
    both = alignment.Aligner(A, B)
    (a_starts, a_ids), (b_starts, b_ids) = both.tokens(pa.array(["the cat the cat", "", "the cat"]))
    found = both.windows(a_starts, a_ids, b_starts, b_ids)
    assert len(found.code) == 6 and len(found.text) == len(found.groups) == 2 and found.starts.tolist() == [0, 4, 4, 6]


def test_pieces_between_ends_are_the_links():
    rng = np.random.default_rng(3)
    for _ in range(50):
        cuts = [np.unique(np.append(rng.integers(1, 40, rng.integers(0, 12)), 40)) for _ in range(2)]
        sizes = [np.diff(np.append(0, c)) for c in cuts]
        ends = alignment.ends_of(*sizes)
        low = [c - s for c, s in zip(cuts, sizes)]
        want = [(i, j) for i in range(len(cuts[0])) for j in range(len(cuts[1]))
                if low[0][i] < cuts[1][j] and low[1][j] < cuts[0][i]]
        assert list(zip(ends.a_of.tolist(), ends.b_of.tolist())) == want
        assert set(np.flatnonzero(ends.both).tolist()) == set(cuts[0].tolist()) & set(cuts[1].tolist())
