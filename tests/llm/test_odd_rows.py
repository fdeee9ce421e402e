"""Nulls, repeated rows, clashing columns and long texts, in every stage of the pipeline and in single operators."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from tessera.llm.packing import Stretches, Whole, pack, splits_at_spaces
from tessera.llm.quality_classifier import fit_classifier, keep_predicted_good, score_classifier
from tessera.llm.quality_rules import fit_quality, reject_low_quality, score_quality
from tessera.llm.sentencepiece import decode, encode
from tessera.llm.sharding import shuffle_into_shards
from tessera.llm.suffix_dedup import cut_repeats, remove_repeats, suffix_digest
from tessera.llm.tables import table

SF = "/root/testdata/sf0.01"
OWN = {"Kept": "mine", "SCORE": 7.5, "n_words": 99, "Spans": [1], "row": {"a": 1}, "block": 3, "ord": None, "_hash": "h", "id": 4, "hash": 5, "node": "n", "quality": "q", "range": 0}


def with_own_columns(docs):
    values = [F.lit("mine").alias("Kept"), F.lit(7.5).alias("SCORE"), F.lit(99).alias("n_words"), F.array(F.lit(1)).alias("Spans"), F.struct(F.lit(1).alias("a")).alias("row"), F.lit(3).alias("block"), F.lit(None).cast("long").alias("ord")]
    values += [F.lit("h").alias("_hash"), F.lit(4).alias("id"), F.lit(5).alias("hash"), F.lit("n").alias("node"), F.lit("q").alias("quality"), F.lit(0).alias("range")]
    return docs.select("*", *values)


def odd_documents(spark):
    """The documents at hand, some of them twice, some without an id, and odd texts."""
    docs = table(spark, SF, "documents")
    more = docs.where("doc_id % 7 = 0")
    none = docs.where("doc_id % 11 = 0").withColumn("doc_id", F.lit(None).cast("long"))
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "x", 0), (2, None, None, None, None)], docs.schema)
    return docs.unionByName(more).unionByName(none).unionByName(none).unionByName(odd)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_groups(rows, per_cent):
    """The group of each row over shingles of five words; None for rows without words."""
    sets, holders = [], defaultdict(list)
    for k, (_, text) in enumerate(rows):
        w = words_of(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for k, s in enumerate(sets):
        if s and s in first:
            parent[root(k)] = root(first[s])
        first.setdefault(s, k)
        for shingle in s:
            holders[shingle].append(k)
    different = [k for s, k in first.items() if s]
    for k in different:
        shared = Counter(j for shingle in sets[k] for j in holders[shingle] if j < k and first[sets[j]] == j)
        for j, n in shared.items():
            if 100 * n >= per_cent * (len(sets[k]) + len(sets[j]) - n):
                parent[root(k)] = root(j)
    return [root(k) if s else None for k, s in enumerate(sets)]


def brute_cut(rows):
    """Texts without the bytes of 100-byte strings that start earlier; rows of one id and text are one document."""
    order = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, {}
    for n, (key, text) in enumerate(order):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if seen.setdefault(raw[i : i + 100], (n, i)) != (n, i):
                gone[i : i + 100] = True
        whole = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "replace")
        out[key, text] = whole if "�" in (text or "") else whole.replace("�", "")
    return out


def test_pipeline_on_odd_rows_equals_brute_force(spark, tmp_path):
    odd = with_own_columns(odd_documents(spark))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = table(spark, str(tmp_path), "labels")
    whole = lambda df: Counter(tuple(str(x) for x in r) for r in df.collect())

    def after(k, given):
        out = corpus_pipeline.STAGES[k][1](spark, given, str(tmp_path))
        assert out.columns == given.columns and out.schema.simpleString() == given.schema.simpleString()
        out.write.parquet(f"{tmp_path}/stage-{k}")
        return spark.read.parquet(f"{tmp_path}/stage-{k}")

    kept = after(0, docs)
    judged = score_quality(docs, fit_quality(docs, labels))
    assert kept.count() == judged.where("kept").count() and not whole(kept) - whole(docs)
    assert {r.Kept for r in kept.select("Kept").distinct().collect()} == {"mine"}
    good = after(1, kept)
    assert good.count() == score_classifier(kept, fit_classifier(kept, labels)).where("score >= 0.3").count() and not whole(good) - whole(kept)
    once = after(2, good)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    groups = brute_groups(rows, 80)
    best = defaultdict(list)
    for g, row in zip(groups, rows):
        best[g].append(row)
    left = Counter((r.doc_id, r.text) for r in once.collect())
    assert sum(left.values()) == len(best.pop(None, [])) + len(best)
    group_of = dict(zip(rows, groups))
    chosen = {group_of[row]: row for row in left if group_of[row] is not None}
    for g, members in best.items():
        ids = [i for i, _ in members if i is not None]
        assert chosen[g][0] == min(ids, default=None)
    cut = after(3, once)
    want = brute_cut(list(left))
    assert Counter((r.doc_id, r.text or "") for r in cut.collect()) == Counter((k[0], want[k]) for k in left.elements())
    packed = corpus_pipeline.STAGES[4][1](spark, cut, str(tmp_path)).collect()
    whole_ids = Whole(queries.tokenizer_path("word_bpe_49k.json"))
    texts = Counter((r.doc_id, (*whole_ids.encode(r.text or "").tolist(), 1)) for r in cut.collect())
    pieces, places = Counter(), defaultdict(list)
    for r in packed:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id, r.start, tuple(r.ids)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces == Counter({(k, s, ids[s : s + 2048]): sum(n for (k2, i2), n in texts.items() if (k2, i2[s : s + 2048]) == (k, ids[s : s + 2048]) and s < len(i2)) for k, ids in texts for s in range(0, len(ids), 2048)})
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_keep_clashing_columns(spark):
    long = " ".join(str(random.Random(1).random()) for _ in range(80))
    docs = with_own_columns(spark.createDataFrame([(1, long), (2, "x " * 60), (None, None)], "doc_id long, Text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for df in (reject_low_quality(docs, labels), keep_predicted_good(docs, labels), drop_near_duplicates(docs), cut_repeats(docs)):
        assert df.columns == docs.columns
        for r in df.collect():
            assert (r.Kept, r.SCORE, r.n_words, r.Spans, r.row.a, r["_hash"]) == ("mine", 7.5, 99, [1], 1, "h")
    for bad in (lambda: remove_repeats(docs), lambda: shuffle_into_shards(docs.withColumn("Slot", F.lit(1)))):
        with pytest.raises(ValueError, match="clash"):
            bad()


def test_pieces_of_all_documents_equal_the_tokenizer(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    assert splits_at_spaces(path) and not splits_at_spaces(queries.tokenizer_path("byte_bpe_50k.json"))
    import pyarrow as pa

    texts = [r.text or "" for r in table(spark, SF, "documents").select("text").collect()]
    texts += ["a<|endoftext|>b c<|startoftext|>", "Éa ÉA x\x85y z\xa0k ΣΑΣ ΑΣ, İx ǅ é K $$$ a's b'", "ȺȾ ⱥ", "   "]
    own, whole = Stretches(path), Whole(path)
    for k in range(0, len(texts), 200):
        some = pa.array(texts[k : k + 200], pa.large_string())
        (a, b), (c, d) = own.ids(some), whole.ids(some)
        assert np.array_equal(a, c) and np.array_equal(b, d)


def test_any_tokenizer_can_pack(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "Hello  World\n"), (2, None), (3, "x" * 10)], "doc_id long, text string")
    want = {k: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1] for k, t in ((1, "Hello  World\n"), (2, ""), (3, "x" * 10))}
    assert {r.doc_id: list(r.ids) for r in pack(docs, path, keep_ids=True).collect()} == want


def test_a_text_of_many_megabytes(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    text = " ".join(rng.choice(words) for _ in range(3_000_000))  # about 18 MB
    docs = spark.createDataFrame([(1, text), (2, text[5_000_000:5_000_500])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_digest(docs).collect()}
    assert got == {1: (len(text), 0), 2: (500, 500)}
    path = queries.tokenizer_path("piece_bpe_32k.model")
    back = decode(encode(docs, path), path).select("doc_id", F.sha2("text", 256).alias("sha")).collect()
    assert {r.doc_id: r.sha for r in back} == {r.doc_id: r.sha for r in docs.select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
    pieces = pack(docs, queries.tokenizer_path("word_bpe_49k.json")).where("doc_id = 1").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).first()
    assert pieces.n == pieces.m > 3_000_000
    assert {r.doc_id for r in near_duplicates(docs).collect()} == {1, 2}


def test_keys_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "one two"), (None, "three")], "doc_id string, text string")
    path = queries.tokenizer_path("piece_bpe_32k.model")
    assert sorted((str(r.doc_id), r.text) for r in decode(encode(docs, path), path).collect()) == [("None", "three"), ("a", "one two"), ("b", "one two")]
