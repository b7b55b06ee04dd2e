"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import glob
import gzip
import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from advisoryspark.llm import chat, decontaminate, lm, packing, pii, quality, simhash, suffix, toxicity, warc
from advisoryspark.session import fresh_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor sit amet consectetur " * 8000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, fp long, spans string, " \
         "score double, items string, u1 long, `key` string, turn long"


@pytest.fixture()
def odd(spark):
    """Rows of every awkward kind, with extra columns named as the operators' own."""
    rows = [(1, "plain words here", "en", "a"), (1, "plain words here", "en", "a"), (2, "", "en", "a"),
            (3, None, None, None), (None, "no id here", "en", None), (None, None, None, None), (4, "  \n\t ", "en", "b"),
            (5, LONG, "en", "b"), (6, "x", "en", "b")]
    return spark.createDataFrame([(*r, None, 9, "row", 7, "spans", 0.5, "items", 3, "key", 2) for r in rows], SCHEMA)


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (99, 1, 1), (5, 0, 1), (5, 0, 0)],
                                 "doc_id long, quality int, toxic int")


def same_rows(a, b):
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_toxicity(odd, labels):
    weights = toxicity.fit(odd, labels)
    scored = toxicity.score(odd, weights).collect()
    assert len(scored) == 9 and all(0 <= r.score <= 1 for r in scored)
    assert same_rows(toxicity.reject(odd, weights, 1.1), odd)
    unlabelled = toxicity.fit(odd, labels.limit(0))
    assert toxicity.reject(odd, unlabelled).count() == 9
    assert toxicity.score(odd.limit(0), weights).count() == 0 and toxicity.fit(odd.limit(0), labels).bias < 0


def test_toxicity_learns(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(i, " ".join(rng.choice(words, 30).tolist() + (["vile"] if i % 4 == 0 else []))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    weights = toxicity.fit(docs, marks)
    got = {r.id: r.score >= 0.5 for r in toxicity.score(docs, weights).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(400, 800))
    assert len(weights.places) < 200
    assert {r.doc_id for r in toxicity.reject(docs, weights).collect()} == {i for i in range(800) if i % 4}
    sample = toxicity.fit(docs, marks, max_rows=100)
    assert len(sample.places) < len(weights.places) + 50


def test_simhash(odd):
    narrow = simhash.with_fingerprint(odd).select(F.col("row.doc_id").alias("id"), "fp")
    got = simhash.assign(narrow)
    assert got.count() == 9
    zero = got.filter("fp = 0").select("component_id").distinct().collect()
    assert [r.component_id for r in zero] == [2]
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 5, 6]
    assert kept.filter("doc_id IS NULL").count() == 1  # "no id here" has no other representative
    assert simhash.deduplicate(odd.limit(0)).count() == 0 and simhash.assign(narrow.limit(0)).count() == 0


def test_simhash_shingle_and_distance(table):
    base = " ".join(f"w{i}" for i in range(400))
    df = table([base, base, base + " tail", "other " * 3, "one two", "One  TWO"])
    assert [r.doc_id for r in simhash.deduplicate(df, distance=0).orderBy("doc_id").collect()][:1] == [0]
    with pytest.raises(ValueError):
        simhash.near_links(simhash.with_fingerprint(df).select("fp"), distance=3)


def test_components_of_long_chains(spark):
    from advisoryspark.llm.components import components
    falling = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    rng = np.random.default_rng(5)
    mixed = [(int(a) + 5000, int(b) + 5000) for a, b in rng.integers(0, 300, (250, 2))]
    df = spark.createDataFrame(falling + star + mixed + [(7000, 7000)], "a long, b long").repartition(3)
    got = {r.node: r.root for r in components(df).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in falling + star + mixed:
        ra, rb = sorted((find(a), find(b)))
        root[rb] = ra
    assert got == {x: find(x) for x in list(root) if any(x in p and p[0] != p[1] for p in falling + star + mixed)}


def test_warc(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/ b\r\nX: y", ""),
            (None, "http://a/n", "alone"), (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nline\n\r\n\r\n" * 3),
            (6, "u", "é" * 5000), (7, "u", "\n"), (8, "u", "x" * 4096)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, id long, digest string")
    path = fresh_path(spark, "warc")
    warc.write(warc.plan_records(pages), path, chunk_bytes=1024)
    chunks = warc.read(spark, path, chunk_bytes=700).orderBy("record_id", "chunk_no").collect()
    assert max(len(c.data) for c in chunks) < 1400 + 1024
    whole = {}
    for c in chunks:
        whole[c.record_id] = whole.get(c.record_id, b"") + bytes(c.data)
        done = hashlib.sha1(whole[c.record_id]).digest()
        if c.record_type == "response":
            assert c.payload_digest == warc.base32_sha1(done) and c.payload_bytes == len(whole[c.record_id])
            assert c.intact is (True if c.last else None)
    last = {c.record_id: c for c in chunks if c.last}
    assert len(last) == len(rows)
    for page, _, html in rows:
        record = last[warc.record_id(page)]
        payload = (html or "").encode()
        assert record.payload_bytes == len(payload) and record.payload_digest == warc.base32_sha1(hashlib.sha1(payload).digest())
        twin = {1: 2, 3: 4}.get(page)
        assert record.record_type == ("revisit" if twin else "response")
        assert record.refers_to == (warc.record_id(twin) if twin else None)
        if not twin:
            assert whole[warc.record_id(page)] == payload
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: continuation") == 9 + 3
    responses = warc.plan_records(pages, revisits_from=1)
    assert {r.id for r in responses.filter("refers_to IS NOT NULL").collect()} == {1}
    empty = fresh_path(spark, "warc")
    warc.write(warc.plan_records(pages.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_rolls_over_between_pages(spark):
    rows = [(k, f"http://a/{k}", f"page {k} " * (700 if k % 3 == 1 else 1)) for k in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = fresh_path(spark, "warc")
    planned = warc.plan_records(pages).coalesce(1)
    warc.write(planned, path, chunk_bytes=1024, max_records=2)
    files = [gzip.open(f).read() for f in glob.glob(f"{path}/*.gz")]
    assert len(files) == 4 and max(f.count(b"WARC-Type: continuation") for f in files) >= 4
    chunks = warc.read(spark, path, chunk_bytes=1024).collect()
    last = {c.record_id: c for c in chunks if c.last}
    assert len(last) == sum(c.last for c in chunks) == len(rows)
    for page, _, html in rows:
        record = last[warc.record_id(page)]
        assert (record.record_type, record.payload_bytes, record.intact) == ("response", len(html), True)
        assert record.payload_digest == warc.base32_sha1(hashlib.sha1(html.encode()).digest())


def test_chat(spark):
    hard = [r"<|end|>", r"<\|end|>", r"<\\|x", "</s>[INST] ok [/INST]", r"[\INST] <s> <</s>", "", None, "<|body|>", "a\\", "<", "|>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "<|turn|>", None] * 3, hard))]
    rows += [(None, 0, "user", "x"), (2, 0, "assistant", None), (3, 0, "assistant", LONG), (4, None, "user", "a"),
             (4, None, "user", "a"), (4, None, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = df.withColumn("parts", F.array(chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in chat.render(chat.visit(turns)).select(
        "conv_id", "formatted", chat.parse(F.col("formatted")).alias("read"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].read] == [(r or "", t or "") for _, _, r, t in rows[:11]]
    assert got[1].loss == "".join(t or "" for _, _, r, t in rows[:11] if r == "assistant")
    assert got[2].loss == "" and got[3].loss == LONG and got[None].read[0].text == "x"
    assert [(t.role, t.text) for t in got[4].read] == [("assistant", "b"), ("user", "a"), ("user", "a")]
    assert chat.render(chat.visit(turns.limit(0))).count() == 0


def test_chat_parts(spark):
    part = lambda t, **k: (t, *(k.get(x) for x in ("text", "ref", "width", "height", "seconds", "pages")))
    rows = [(1, 0, "user", [part("text", text="see "), part("image", ref="i.png", width=57, height=28), None,
                            part("text", text=" <|image|> and "), part("audio", ref="a.wav", seconds=2.5)]),
            (1, 1, "assistant", [part("document", ref="d.pdf", pages=3), part("odd", text="ok")]),
            (1, 2, "user", []), (1, 3, "user", None), (1, 4, "user", [part("image", ref="none")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.render(chat.visit(df)).first()
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [
        ("image", "i.png", 3), ("audio", "a.wav", 63), ("document", "d.pdf", 768), ("image", "none", 0)]
    marks = {"image": chat.IMAGE, "audio": chat.AUDIO, "document": chat.DOCUMENT}
    assert all(row.formatted[a["at"]:].startswith(marks[a.type]) for a in row.attachments)
    assert row.attachment_tokens == 834 and row.formatted.count(chat.IMAGE) == 2
    assert [row.formatted[s.start:s.start + s.length] for s in row.loss_spans] == [chat.DOCUMENT + "ok"]


def test_chat_control_strings_across_parts(spark):
    part = lambda t, text, ref=None: (t, text, ref, None, None, None, None)
    rows = [(1, 0, "user", [part("text", "a <"), part("text", "|end|>"), part("odd", "<"), part(None, "/s>"), None,
                            part("image", None, "i.png"), part("text", "<|im"), part("text", None), part("text", "age|>"),
                            part("text", "["), part("text", "INST] <\\"), part("text", "|x")]),
            (1, 1, "assistant", [part("text", "<|"), part("text", "body|>")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.render(chat.visit(df)).withColumn("read", chat.parse(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert [(t.role, t.text) for t in row.read] == [
        ("user", "a <|end|></s>" + chat.IMAGE + "<|image|>[INST] <\\|x"), ("assistant", "<|body|>")]
    assert row.loss == "<|body|>" and row.formatted.count(chat.END) == 2 and row.formatted.count(chat.IMAGE) == 1
    assert [(a.type, a.ref) for a in row.attachments] == [("image", "i.png")]
    assert row.formatted[row.attachments[0]["at"]:].startswith(chat.IMAGE)


def test_quality(spark, odd):
    rows = {(r.id, r.n_words): r for r in quality.judge(odd).collect()}
    assert quality.judge(odd).count() == 9
    assert rows[(5, 48000)].base_failed and rows[(5, 48000)].n_repeat_words == 48000
    assert all(r.base_failed and not r.kept for r in rows.values())
    assert quality.judge(odd.limit(0)).count() == 0
    good = " ".join(f"word{i}" for i in range(40))
    hosts = [(i, good + str(i), "ok") for i in range(60)] + [(100 + i, "bad " * 40, "bad") for i in range(50)]
    hosts += [(200, good, "bad"), (300, good, "rare"), (301, "bad " * 40, "rare")]
    judged = {r.id: r for r in quality.judge(spark.createDataFrame(hosts, "doc_id long, text string, source string")).collect()}
    assert all(judged[i].kept for i in range(60))
    assert judged[200].host_rejected and not judged[200].kept and not judged[200].base_failed


def test_repeat_words_by_windows():
    rng = np.random.default_rng(6)
    for _ in range(200):
        codes = rng.integers(0, 3, rng.integers(0, 40))
        windows = [tuple(codes[i:i + 5]) for i in range(len(codes) - 4)]
        hit = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
        assert quality.repeat_words(codes) == len(hit)


def test_language_model(odd):
    held = F.col("doc_id").isNull()
    rows = lm.score(odd, held).collect()
    assert len(rows) == 9 and sum(r.held_out for r in rows) == 2
    assert {r.n_tokens for r in rows if r.id in (2, 3, 4)} == {1}
    assert all(r.score <= 0 and r.n_known >= 1 for r in rows)
    assert lm.score(odd.limit(0), held).count() == 0
    unseen = lm.score(odd, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.base_score == pytest.approx(0) and r.n_known == 0 for r in unseen)


def test_personal_data(odd, spark):
    text = "write to Ann Quilby at ann@x.org or +1 (555) 123-4567, ip 10.0.0.256 1.2.3.4 card 4111-1111-1111-1111."
    found = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [pii.KINDS[s["rank"]] for s in found.spans] == ["email", "phone", "ip", "card"]
    clean = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == "write to Ann Quilby at [EMAIL] or [PHONE], ip 10.0.0.256 [IP] card [CARD]."
    assert same_rows(pii.sanitise(odd), odd)
    assert pii.detect(odd).count() == 9 and pii.detect(odd.limit(0)).count() == 0


def test_disclosing_terms(spark):
    filler = [f"common words number {w * 4} are here today" for w in "abcdefghijklmnopqrst"]
    rows = [(i, f"{filler[i]} contact Zorblax via zb@x.org please {filler[i + 1]}") for i in range(6)]
    rows += [(10 + i, f"{filler[i]} contact someone via m{i}@y.org please") for i in range(8)]
    rows += [(30 + i, f"{t} contact via please someone") for i, t in enumerate(filler)]
    rows += [(60 + i, "copies mention Qwerty near q@z.org always") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.id: [(s.value, pii.KINDS[s["rank"]]) for s in r.spans] for r in pii.detect(docs).collect()}
    assert all(("zorblax", "term") in found[i] for i in range(6))
    assert not any(k == "term" for i in found if i >= 10 for _, k in found[i])  # copies are one context
    assert {v for i in range(6) for v, k in found[i] if k == "term"} == {"zorblax"}
    cleaned = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zorblax" not in cleaned[0] and "[EMAIL]" in cleaned[0] and "Qwerty" in cleaned[60]


def test_disclosing_terms_far_from_the_entity(spark):
    """A term of every document of an entity is found and cut wherever it stands there, and only there."""
    far = " ".join(f"plain{c} text of some length" for c in "abcdefghijkl") * 2
    rows = [(i, f"Zorblax opens item {'qrstuvwx'[i] * 5}. {far} write to zb@x.org now. {far} ZORBLAX ends it, Zorblaxian not.")
            for i in range(6)]
    rows += [(10 + i, f"{far} write to m{i}@y.org now. opens item ends not") for i in range(8)]
    rows += [(30 + i, f"{far} opens item ends write now not Zorblaxian") for i in range(20)]
    rows += [(60 + i, f"Qwerty was here. {far} copies q@z.org") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.id: [s for s in r.spans if pii.KINDS[s["rank"]] == "term"] for r in pii.detect(docs).collect()}
    for i, text in rows:
        assert [text[s.start:s.end] for s in found[i]] == (["Zorblax", "ZORBLAX"] if i < 6 else [])
        assert all(s.value == "zorblax" for s in found[i])
    cleaned = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert cleaned[0].startswith(" opens item qqqqq.") and cleaned[0].endswith(f"[EMAIL] now. {far}  ends it, Zorblaxian not.")
    assert cleaned[60] == rows[-6][1].replace("q@z.org", "[EMAIL]")


def test_suffix(odd, spark):
    rows = suffix.measure(odd).collect()
    assert len(rows) == 9 and {r.n_bytes for r in rows if r.id == 3} == {0}
    long = next(r for r in rows if r.id == 5)
    assert long.n_removed == len(LONG.encode()) and long.n_spans == 1
    cut = suffix.remove(odd)
    assert cut.columns == odd.columns and cut.filter("doc_id = 5").first().text == ""
    assert cut.filter("text IS NULL").count() == 2 and suffix.measure(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "q" + "abc" * 200), (1, "q" + "abc" * 200)], "doc_id long, text string")
    assert {r.n_removed for r in suffix.measure(twice).collect()} == {601}


def test_packing(odd):
    pieces = packing.pack(packing.tokenized(odd, TOKENIZER)).collect()
    assert sum(p.length for p in pieces if p.id == 3) == 1 and sum(p.id == 2 for p in pieces) == 1
    assert sum(p.length for p in pieces if p.id == 5) == max(p.doc_tokens for p in pieces if p.id == 5)
    assert packing.pack(packing.tokenized(odd.limit(0), TOKENIZER)).count() == 0


def test_packing_limits(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(0, 50000, n).astype("<u4").tobytes(), int(rng.integers(0, n + 1)))
            for i, n in enumerate(rng.integers(1, 300, 500).tolist())]
    examples = spark.createDataFrame([(i, bytearray(b), n) for i, b, n in rows], "id long, ids binary, n_loss long").coalesce(1)
    pieces = packing.pack(examples, max_tokens=256, max_segments=6, max_loss=100).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for found in by_sequence.values():
        loss = 0
        for p in found:
            bare = p.doc_tokens - rows[p.id][2]
            loss += max(0, p.start + p.length - max(p.start, bare))
            assert bytes(p.ids) == rows[p.id][1][4 * p.start:4 * (p.start + p.length)]
        assert sum(p.length for p in found) <= 256 and len(found) <= 6 and loss <= 100
    assert sum(p.length for p in pieces) == sum(len(b) // 4 for _, b, _ in rows)


def test_decontaminate(odd, spark):
    words = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, words), (1, words), (2, "Two Words"), (3, None), (4, "..."), (None, "no id here"),
                                   (5, " ".join(f"w{i}" for i in range(5, 16)))], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "a b " + words.upper().replace(" ", "--") + " c"), (2, "x two,words y"), (3, "two x words"),
        (4, " ".join(f"w{i}" for i in range(9))), (5, None), (6, "no id here"),
        (7, "é " + " ".join(f"w{i}" for i in range(4, 15)) + " z")], "doc_id long, text string")
    for most in (100_000, 3):
        got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.scan(docs, items, max_windows=most).collect()}
        assert got == {1: (33, 30, ["1", "5"]), 2: (4, 2, ["2"]), 3: (3, 0, []), 4: (9, 0, []), 5: (0, 0, []),
                       6: (3, 3, []), 7: (13, 11, ["1", "5"])}
        cut = {r.doc_id: r.text for r in decontaminate.clean(docs, items, "span", max_windows=most).collect()}
        assert cut[1] == "a b  c" and cut[2] == "x  y" and cut[3] == "two x words" and cut[7] == "é  z" and cut[5] is None
        kept = decontaminate.clean(docs, items, max_windows=most)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert same_rows(decontaminate.clean(odd, items.filter("item_id < 3")), odd)
    assert decontaminate.scan(odd, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.scan(odd.limit(0), items).count() == 0


def test_pipeline_stages_take_any_documents(spark, small, odd):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, small)
            assert out.count() <= 50 + 9 * 60
            if name != "packing":
                assert out.columns == corpus_pipeline.COLUMNS


def test_pipeline_against_plain_rules(spark, small):
    """Each stage keeps exactly what its operator's rule keeps of the stage before."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    first = corpus_pipeline.drop_toxic(spark, docs, small).persist()
    scores = {r.id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert ids(first) == {i for i, s in scores.items() if s < 0.5}
    second = corpus_pipeline.drop_near_duplicates(spark, first, small).persist()
    narrow = simhash.with_fingerprint(first).select(F.col("row.doc_id").alias("id"), "fp")
    assert ids(second) == {r.component_id for r in simhash.assign(narrow).collect()} and second.count() == len(ids(second))
    third = corpus_pipeline.drop_leaks(spark, second, small).persist()
    assert ids(third) == {r.id for r in decontaminate.scan(second, benchmark).filter("n_hit = 0").collect()}
    fourth = corpus_pipeline.sanitise(spark, third, small).persist()
    assert ids(fourth) == ids(third) and pii.detect(fourth).filter("size(spans) > 0").count() == 0
    packed = corpus_pipeline.pack(spark, fourth, small)
    assert ids(packed) == ids(third)
    tokens = lambda df: sorted((r.doc_id, r.n) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect())
    assert tokens(corpus_pipeline.run(spark, small)) == tokens(packed)
