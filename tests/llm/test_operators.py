"""The training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm.ann import nearest
from tessera.llm.chat_format import chat_digest
from tessera.llm.license_scan import license_digest
from tessera.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality_classifier import classify_quality
from tessera.llm.quality_rules import quality_rules
from tessera.llm.sentencepiece import decode, encode
from tessera.llm.sharding import shard_digest, shuffle_into_shards
from tessera.llm.suffix_dedup import STRETCH, cut_repeats, repeated_windows, suffix_digest
from tessera.llm.tables import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def small_texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Éa", "naïve", "GPL", "License", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    out = [None, "", " \n\t ", "one", "One", "a b c d", "x" * 300, "x" * 300 + "y", "x" * 99]
    for _ in range(40):
        base = text(rng.randint(3, 200))
        out.append(base)
        if rng.random() < 0.5:
            parts = base.split()
            for _ in range(rng.randint(0, 3)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            out.append(" ".join(parts))
        if rng.random() < 0.3:
            out.append(text(10) + "\n" + passage + " " + text(10))
        if rng.random() < 0.2:
            out += [base, base.upper()]
    return out + [text(20_000), "Licensed under the Apache License, Version 2.0. All rights reserved. CC BY", "general public license " * 3]


@pytest.fixture(scope="module")
def texts():
    return small_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "hot", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sets_of(texts, size=5):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def test_near_duplicates(docs, texts):
    sets = sets_of(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {k: (len(s), root(k), root(k) == k) for k, s in enumerate(sets)}


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    got = pack(docs, path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for held, whole in ((by_doc, {k: len(v) for k, v in want.items()}), (by_sequence, None)):
        for key, pieces in held.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at
                at += length
            assert at == whole[key] if whole else at <= 2048
    total = sum(map(len, want.values()))
    assert set(by_doc) == set(want) and len(by_sequence) <= -(-total // 2048) + 1


def test_sentencepiece(docs, texts):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, again = ({r.doc_id: list(r.pieces) for r in encode(x, path).collect()} for x in (docs, docs.repartition(2)))
    assert first == again
    assert {r.doc_id: r.text for r in decode(encode(docs, path), path).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert all(model.decode(first[k]) == t for k, t in enumerate(texts) if t and t == t.strip() and "\n" not in t)


def brute_repeats(rows):
    seen, out = set(), {}
    for key, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[key] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_digest(docs).collect()}
    assert got == brute_repeats(enumerate(texts))


def test_repeats_real(spark):
    some = table(spark, SF, "documents")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_digest(some).collect()}
    assert got == brute_repeats(sorted((r.doc_id, r.text) for r in some.select("doc_id", "text").collect()))


def test_repeats_of_repeated_rows(spark):
    rng = random.Random(9)
    clean, odd, shared = (" ".join(str(rng.random()) for _ in range(30)) for _ in range(3))
    rows = [(1, clean), (1, clean), (None, odd), (None, odd), (2, shared), (3, shared), (3, shared)]
    want = brute_repeats([(1, clean), (None, odd), (2, shared)]) | {3: (len(shared), len(shared), 1, hashlib.sha256(b"").hexdigest())}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, len(rows)):  # repeated rows in one task, and each in its own
        got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_digest(docs.repartition(parts)).collect()]
        assert sorted(got, key=str) == sorted([(k, want[k]) for k, _ in rows], key=str)
    assert Counter(r.text for r in cut_repeats(docs).collect()) == {clean: 2, odd: 2, shared: 1, "": 2}


def test_repeats_of_a_frequent_line(spark):
    rng = random.Random(3)
    own = lambda: " ".join(str(rng.random()) for _ in range(12))
    line = own()[:98]
    texts = [own() + line + rng.choice("ab") + rng.choice("cd") + own() for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for frequent in (1 << 15, 10):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_digest(docs, frequent).collect()}
        assert got == brute_repeats(enumerate(texts))


def test_repeats_in_periodic_and_long_texts(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = ["x" * n for n in (99, 100, 101, 155, 156, 157, 300)] + [word(k) * 40 for k in (1, 3, 7, 56, 57, 58, 100)] + ["ab" * 200 + word(30) + "ab" * 200]
    shared = word(5000)
    texts += [word(n) + shared[a:b] + word(m) for n, m, a, b in ((0, 0, 0, 5000), (17, 3, 100, 400), (58, 0, 4000, 5000), (5, 5, 0, 99), (5, 5, 0, 100), (3, 4, 77, 178))]
    long = word(STRETCH + 5000)
    texts += [long, long[STRETCH - 300 : STRETCH + 300] + word(20), word(41) + long[STRETCH - 50 : STRETCH + 50]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    for frequent in (1 << 15, 3):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_digest(docs, frequent).collect()}
        want = brute_repeats(enumerate(texts))
        assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_strings_of_equal_hashes_are_compared():
    data = np.frombuffer(bytes(range(1, 131)) + bytes(range(1, 121)) + b"?" + bytes(range(122, 131)), np.uint8)
    name, size, place = np.array([5, 5], np.uint64), np.array([130, 130]), np.array([0, 1 << 32])
    row, first, last = repeated_windows(name, data, size, place)
    assert (row.tolist(), first.tolist(), last.tolist()) == ([1], [0], [20])


def test_nearest(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in table(spark, SF, "embeddings").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[k] for k in ids])
    found = defaultdict(list)
    for r in queries.op5_ann(spark, SF).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ rows[q]
        best = [k for k in ids[np.lexsort((ids, -s))] if k != q][:20]
        hits += len({r.vec_id for r in found[q]} & set(best))
        assert [r.rank for r in found[q]] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(rows[q] @ rows[r.vec_id]), abs=1e-12) for r in found[q])
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_nearest_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0]), (20, [0.5, None]), (None, [1.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0" and __import__("pyspark").sql.functions.expr("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 4), (0, 2, 5)]


def test_nearest_of_few_rows(spark):
    x = np.random.default_rng(4).normal(size=(12, 64))
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in nearest(docs, "vec_id >= 0").collect())
    assert got == {k: 11 for k in range(12)}


def test_nearest_with_a_third_of_copies(spark):
    x = np.random.default_rng(6).normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.concatenate([x, np.repeat(x[:1], 300, 0)])
    queries_ = np.argsort(-(x[1:600] @ x[0]))[:30] + 1  # those that visit the copies early
    docs = spark.createDataFrame([(k, v.tolist(), k in queries_) for k, v in enumerate(x)], "vec_id long, embedding array<double>, asks boolean")
    # the copies may be a query's best; what is asked here is how many of its best others are found
    found = defaultdict(set)
    for r in nearest(docs, "asks", k=370).collect():
        found[r.query_id].add(r.vec_id)
    best = {q: [k for k in np.argsort(-(x[:600] @ x[q])) if k not in (0, q)][:20] for q in queries_}
    share = sum(len(found[q] & set(best[q])) for q in queries_) / (20 * len(queries_))
    print("recall with a third of copies:", share)
    assert share >= 0.9


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = con.execute(queries.ORACLE_SQL["op6_chat_format"]).to_arrow_table()
    got = queries.op6_chat_format(spark, SF).toArrow()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    assert sorted(zip(*(got.column(n).to_pylist() for n in names))) == sorted(zip(*(want.column(n).to_pylist() for n in names)))


def test_shards(docs, texts):
    got = shard_digest(shuffle_into_shards(docs)).collect()
    slots = defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "rows")
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_classifier_on_held_out_rows(spark):
    sf = SF.replace("0.01", "0.1")
    got = classify_quality(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in got)
    good, bad = (np.array([r.score for r in got if r.quality == y]) for y in (1, 0))
    auc = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    assert auc > 0.85
    assert np.mean([r.predicted == r.quality for r in got]) > 0.8


def test_licenses(docs, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for r in license_digest(docs).collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if (texts[r.doc_id] or "").startswith("Licensed under the Apache"):
            assert "apache-2.0" in r.labels.split(",")


def test_quality_counts(docs, spark, texts):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(len(texts))], LABELS)
    for r in quality_rules(docs, labels).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (failed and r.kept)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], LABELS)
    bpe, piece = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    made = (near_duplicates(empty), pack(empty, bpe), decode(encode(empty, piece), piece), suffix_digest(empty), shard_digest(shuffle_into_shards(empty)), classify_quality(empty, labels), license_digest(empty), quality_rules(empty, labels))
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (*made, chat_digest(chats), nearest(vectors, __import__("pyspark").sql.functions.expr("vec_id % 20 = 0"))):
        assert df.count() == 0


def test_null_ids_and_repeated_rows(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12
    docs = spark.createDataFrame([(None, long, None, None, None), (None, None, None, None, None), (7, long, "a", "b", 1), (7, long, "a", "b", 1)], DOCS)
    labels = spark.createDataFrame([(None, 1, 0), (7, None, 1), (7, 1, None)], LABELS)
    bpe, piece = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    for df in (near_duplicates(docs), suffix_digest(docs), shard_digest(shuffle_into_shards(docs)), classify_quality(docs, labels), license_digest(docs), quality_rules(docs, labels), decode(encode(docs, piece), piece)):
        assert df.count() == 4
    assert pack(docs, bpe).count() >= 4


def test_filters_keep_columns(docs):
    for df in (drop_near_duplicates(docs), cut_repeats(docs)):
        assert df.columns == docs.columns
        assert df.count() <= docs.count()


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "repeated passages", "packing"]
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.toArrow())
        assert docs.count() > 0
    sets = sets_of([r.text for r in docs.collect()])
    assert len(sets) < table(spark, SF, "documents").count()
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
