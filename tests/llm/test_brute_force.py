"""The training-data operators against plain loops over small fixtures."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import license_scan, minhash_dedup, quality_classifier, quality_rules, queries
from tessera.llm.arrays import text_slices
from tessera.llm.chat_format import CONT, CONTROL, END, SEP, START, chat_digest, format_chats, with_masked_text
from tessera.llm.sentencepiece import BYTE_WEIGHT, Lattices
from tessera.llm.sharding import shard_digest, shuffle_into_shards, write_shards

CHATS = "conv_id long, turn long, role string, text string"


def escape(text):
    for raw, safe in (("&", "&amp;"), *CONTROL):
        text = text.replace(raw, safe)
    return text


def plain_chat(turns):
    """The formatted text and the texts under the mask, turn by turn."""
    out, spans, last = "", [], None
    for _, role, text in turns:
        out += CONT if role == last else (END if last is not None else "") + START + escape(role) + SEP
        if role == "assistant":
            spans.append((len(out), len(escape(text))))
        out += escape(text)
        last = role
    return out + END, spans


def chat_rows():
    rng = random.Random(4)
    parts = ["</s>", "[INST]", "<|end|>\n", "&lt;", "&", "é", "😀", "\n", "ok ", "<<SYS>>", "&amp;lt;", "[/INST]", "<|"]
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(("user", "assistant", "system", "a&b<|")), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))))
    rows += [(20, 1, "assistant", "b"), (20, 1, "assistant", "a"), (20, 1, "assistant", "a"), (20, None, None, None), (21, 0, "assistant", None)]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y")]
    rows += [(30, k, ("user", "assistant")[k % 3 > 0], f"turn {k} " + "z" * (k % 700)) for k in range(600)]  # over several chunks
    return rows


def expected_chats():
    by = defaultdict(list)
    for conv, turn, role, text in chat_rows():
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {conv: sorted(turns, key=lambda t: (t[0], escape(t[1]), escape(t[2]))) for conv, turns in by.items()}


def test_chat_spans(spark):
    df = spark.createDataFrame(chat_rows(), CHATS).repartition(3)
    want = {conv: plain_chat(turns) for conv, turns in expected_chats().items()}
    got = {r.conv_id: (r.formatted, [(s.start, s.length) for s in r.loss_spans]) for r in format_chats(df).collect()}
    assert got == want


def test_chat_digest(spark):
    df = spark.createDataFrame(chat_rows(), CHATS).repartition(3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in chat_digest(df).collect():
        turns = expected_chats()[r.conv_id]
        learnt = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(whole), len(learnt), sha(learnt))


def test_chat_digest_reads_the_mask(spark):
    chats = format_chats(spark.createDataFrame(chat_rows(), CHATS))
    moved = chats.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"])))
    true, false = ({r.conv_id: r.learnt for r in with_masked_text(x).collect()} for x in (chats, moved))
    assert any(true[k] != false[k] for k in true)


def all_segmentations(word, weights, longest=16):
    """(pieces, weight) of every way to spell a word; characters that no single piece spells may be spelt in bytes."""
    if not word:
        yield (), 0.0
        return
    for n in range(1, min(longest, len(word)) + 1):
        if word[:n] in weights:
            for rest, w in all_segmentations(word[n:], weights):
                yield (word[:n], *rest), w + weights[word[:n]]


def test_sampled_frequencies():
    model = queries.tokenizer_path("piece_bpe_32k.model")
    theta = 3e-4
    own = Lattices(model, theta)
    weights = {t: theta * s for t, s in zip(own.pieces.id, own.pieces.score)}
    name = {k: t for t, k in own.pieces.id.items()}
    word, n = "statin", 20_000
    want = dict(all_segmentations("▁" + word, weights))
    total = sum(map(math.exp, want.values()))
    pieces, ends = own.sample(pa.array([word] * n, pa.large_string()), np.arange(n), 7)
    seen = Counter(tuple(name[p] for p in pieces[a:b].tolist()) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))
    assert set(seen) <= set(want)
    for way, w in want.items():
        p = math.exp(w) / total
        assert abs(seen[way] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1, (way, seen[way], n * p)
    assert BYTE_WEIGHT < min(weights.values())


def test_samples_do_not_depend_on_what_is_remembered(monkeypatch):
    import tessera.llm.sentencepiece as sp

    rng = random.Random(1)
    texts = pa.array([" ".join("".join(rng.choice("abcdeé▁ ") for _ in range(rng.randint(1, 12))) for _ in range(60)) for _ in range(80)], pa.large_string())
    model = queries.tokenizer_path("piece_bpe_32k.model")
    large = Lattices(model, 1e-3)
    whole = large.sample(texts, np.arange(80), 1)
    monkeypatch.setattr(sp, "KNOWN_EDGES", 300)
    monkeypatch.setattr(sp, "LEARN_CHARS", 50)
    monkeypatch.setattr(sp, "SAMPLE_STRETCHES", 17)
    small = Lattices(model, 1e-3)
    parts = [small.sample(texts.slice(k, 8), np.arange(k, k + 8), 1) for k in range(0, 80, 8)]
    assert np.array_equal(np.concatenate([p for p, _ in parts]), whole[0])
    assert len(small.piece) < len(large.piece) / 2


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    texts = ["one two two THREE", "", "a! b? 33 \n a!", "x " * 30]
    bits = 1 << quality_classifier.BITS
    size = bits + quality_classifier.N_STATS
    m = quality_classifier.FactorModel(0.3, rng.normal(size=size), rng.normal(size=(size, quality_classifier.RANK)), rng.normal(size=quality_classifier.N_STATS), np.ones(quality_classifier.N_STATS), (1.0, 0.0))
    (t,) = text_slices(pa.array(texts))
    doc, bucket, share, stats = quality_classifier.describe(t, np.array([len(x) for x in texts], float))
    got = quality_classifier.raw_scores(doc, bucket, share, stats, m)
    for k in range(len(texts)):
        x = [(b, s) for d, b, s in zip(doc, bucket, share) if d == k] + [(bits + j, (stats[k, j] - m.centre[j]) / m.spread[j]) for j in range(quality_classifier.N_STATS)]
        z = m.bias + sum(m.linear[i] * v for i, v in x) + sum(m.factors[i] @ m.factors[j] * v * w for (i, v), (j, w) in itertools.combinations(x, 2))
        assert got[k] == pytest.approx(z, abs=1e-9)


def test_fit_sees_the_given_length(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(40)), 10 if k % 2 else 10_000) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.classify_quality(docs, labels).collect()}
    low, high = ([got[k] for k in range(120) if k % 2 == y] for y in (0, 1))
    assert np.mean(np.array(low)[:, None] < np.array(high)) > 0.9  # only n_chars tells them apart
    odd = docs.withColumn("n_chars", F.lit("mine"))
    assert quality_classifier.classify_quality(odd, labels).count() == 120


def test_quality_scores_equal_plain_sums():
    texts = ["the cat sat on the mat", "", "###", "naïve é", "a b a b a b"]
    rng = np.random.default_rng(5)
    weights = rng.normal(size=(quality_rules.KINDS, 1 << quality_rules.BITS)).astype(np.float32)
    (t,) = text_slices(pa.array(texts))
    counts, parts = quality_rules.counts(t)
    got = quality_rules.logits(t, parts, weights, 0.25)
    word_hash = dict(zip([w for x in texts for w in x.split()], parts["hashed"].tolist()))
    odd = 0x9E3779B97F4A7C15
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def gram(words):
        h = 0
        for w in words[:-1]:
            h = (h * odd + mixed(w)) & mask
        return mixed((h * odd + words[-1]) & mask) >> (64 - quality_rules.BITS)

    for k, text in enumerate(texts):
        words, raw = [word_hash[w] for w in text.split()], text.encode()
        kinds = [[gram(words[i : i + n]) for i in range(len(words) - n + 1)] for n in quality_rules.WORD_NGRAMS]
        kinds += [[(int.from_bytes(raw[i : i + n], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality_rules.BITS) for i in range(len(raw) - n + 1)] for n in quality_rules.CHAR_NGRAMS]
        want = 0.25 + sum(float(np.mean([weights[j][b] for b in own])) for j, own in enumerate(kinds) if own)
        assert got[k] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("parts", [4, 7])
def test_shards_are_reproducible_and_written(spark, tmp_path, parts, monkeypatch):
    import tessera.llm.sharding as sharding

    monkeypatch.setattr(sharding, "COPIES", 16)
    rng = random.Random(0)
    rows = [(k, " ".join(str(rng.random()) for _ in range(rng.randint(0, 40)))) for k in range(500)] + [(None, None)] * 3 + [(1000, "same " * 40)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    sharded = shuffle_into_shards(docs, shards=5, bucket_bytes=2000)
    back = write_shards(sharded, f"file://{tmp_path}/shards")
    got = [(r.doc_id, r.text, r.shard, r.slot) for r in back.collect()]
    assert Counter((d, t) for d, t, _, _ in got) == Counter(rows)
    slots = defaultdict(list)
    for _, _, shard, slot in got:
        slots[shard].append(slot)
    sizes = [len(slots[k]) for k in range(5)]
    assert all(sorted(slots[k]) == list(range(len(slots[k]))) for k in slots) and max(sizes) - min(sizes) <= 1
    hot = Counter(shard for d, _, shard, _ in got if d == 1000)
    assert len(hot) == 5 and max(hot.values()) < 120  # copies lie in all shards
    expected = test_shards_are_reproducible_and_written.__dict__.setdefault("seen", sorted(got, key=str))
    assert sorted(got, key=str) == expected
    for r in shard_digest(back).collect():
        raw = dict((d, t) for d, t in rows)[r.doc_id]
        assert r["size"] == len((raw or "").encode()) + 16 and r.text_crc32 == zlib.crc32((raw or "").encode())
    for k in range(5):  # files hold their rows in the order of their slots
        for f in (tmp_path / "shards" / f"shard={k}").glob("*.parquet"):
            import pyarrow.parquet as pq

            held = pq.read_table(f).column("slot").to_pylist()
            assert held == sorted(held)


LICENSE_TEXTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": {"mit"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted": {"bsd"},
    "// SPDX-License-Identifier: MIT": {"mit"},
    "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0-or-later"},
    "released as GPL-2.0-or-later": {"gpl-2.0-or-later"},
    "the public domain film was shown": set(),
    "This work is in the public domain.": {"public-domain"},
    "under the 3-Clause BSD License": {"bsd-3-clause"},
    "BSD 2-Clause License": {"bsd-2-clause"},
    "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software": {"bsd-3-clause"},
    "Licensed under the Apache License, Version 2.0 (the \"License\");": {"apache-2.0"},
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": {"isc"},
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.": {"zlib"},
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": {"gpl", "gpl-2.0-or-later"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2.0"},
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa-4.0"},
    "Copyright (c) 2004 Ann": {"copyright"},
    "GNU Lesser General Public License version 2.1": {"gpl", "lgpl-2.1"},
    "Do What The Fuck You Want To Public License": {"wtfpl"},
    "all rights reserved, cc by": {"reserved", "cc-by"},
    "a license to kill; the general public": set(),
    "MIT Licensed": {"mit"},
    "AGPLv3": {"agpl-3.0"},
    "LGPLv2.1 or later": {"lgpl-2.1-or-later"},
    "EPL-2.0": {"epl-2.0"},
    "License: Unlicense": {"unlicense"},
    "(c) 2020 Bob": {"copyright"},
    "https://opensource.org/licenses/MIT": {"mit"},
    "http://www.apache.org/licenses/LICENSE-2.0": {"apache-2.0"},
    "https://creativecommons.org/licenses/by-sa/4.0/": {"cc-by-sa"},
    "https://creativecommons.org/publicdomain/zero/1.0/": {"cc0-1.0"},
    "provided as is, without warranty of any kind": {"no-warranty"},
    "Apache-2.0 OR MIT": {"apache-2.0", "mit"},
    "MIT OR Apache-2.0": {"mit", "apache-2.0"},
    "not licensed under the MIT license": {"not-granted"},
    "This is not licensed under the GPL version 2": {"not-granted"},
    "vitamin c 2020": set(),
    "a licensed plumber; the unlicensed driver": set(),
    "apache helicopters, mit seiner Frau": set(),
}


def test_license_texts(spark):
    rows = list(enumerate(LICENSE_TEXTS))
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in license_scan.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[k] for k, t in rows} == LICENSE_TEXTS


def test_very_many_detections_in_one_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "mit license and x " * n)], "doc_id long, text string")
    r = license_scan.scan_licenses(docs).select(F.size("licenses").alias("n"), F.get("licenses", F.lit(n - 1))["start"].alias("last")).first()
    assert (r.n, r.last) == (n, 4 * (n - 1))


def test_license_rules_need_their_keywords():
    rules = license_scan.signature_rules()
    assert len(rules) > 250 and [r.number for r in rules] == list(range(len(rules)))
    for signatures, _, _ in license_scan.KINDS:
        for _, keyword, words in signatures:
            given, asked = words.split(), keyword.split()
            assert any(given[i : i + len(asked)] == asked for i in range(len(given))), words


def test_license_suppression_equals_brute_force(spark):
    rules = license_scan.signature_rules()
    rng = random.Random(6)
    pool = list(LICENSE_TEXTS) + ["x y z", "GPL v2", "MIT license", "GNU GPL version 3", "cc by sa 4.0"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    got = {r.doc_id: [(d.start, d.end, d.rule) for d in r.licenses] for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        spaced = "".join(f" {w} " for w in words)
        found = [(spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, r) for r in rules if r.keyword in spaced for m in re.finditer(r.regex, spaced)]
        better = lambda a, b: a[2].priority <= b[2].priority and a[0] <= b[0] and a[1] >= b[1] and ((a[0], a[1]) != (b[0], b[1]) or (a[2].priority, a[2].number) < (b[2].priority, b[2].number))
        kept = [d for d in found if d[2].base or not any(o is not d and not o[2].base and better(o, d) for o in found)]
        assert sorted(got[k]) == sorted((a, b, r.number) for a, b, r in kept), text


@pytest.mark.parametrize("large", [1 << 16, 20])
def test_near_duplicates_in_several_blocks(spark, monkeypatch, large):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "LARGE", large)
    monkeypatch.setattr(minhash_dedup, "PARTNERS", 5)
    rng = random.Random(12)
    base = [str(rng.random()) for _ in range(120)]
    texts = []
    for k in range(90):  # one bucket of many nodes: each is the base with its own few words
        own = base[:]
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(120)] = str(rng.random())
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    parent = list(range(90))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {k: root(k) for k in range(90)}


@pytest.mark.parametrize("threshold, bands", [(0.85, 24), (0.8, 37)])
def test_buckets_of_two_bands_keep_the_bound(threshold, bands):
    """Simulated: how often a pair at the threshold shares one band alone and none of the further ones, against the formula at fewer bands."""
    further = minhash_dedup.further_bands(bands)
    assert minhash_dedup.loss_of_two_bands(threshold, bands, further) <= 1e-6
    shared = np.random.default_rng(3).random((200_000, 9)) < threshold**minhash_dedup.BAND_ROWS
    lost = (shared[:, :6].sum(1) == 0) | ((shared[:, :6].sum(1) == 1) & ~shared[:, 6:].any(1))
    assert abs(lost.mean() - minhash_dedup.loss_of_two_bands(threshold, 6, 3)) < 2e-3


def test_posterior_limits():
    limits = minhash_dedup.least_matches(0.85, 1e-5, 192, 32)
    rng = np.random.default_rng(1)
    lost = 0
    n = 20_000
    p = 0.85 + 0.15 / 256
    matches = np.cumsum(rng.random((n, 192)) < p, 1)[:, 31::32]
    lost = (matches < np.array(limits)).any(1).mean()
    assert lost <= 1e-3  # pairs at the threshold itself; the bound is on the posterior
    far = np.cumsum(rng.random((n, 192)) < 0.4, 1)[:, 31::32]
    assert (far < np.array(limits)).any(1).mean() > 0.999


def test_shards_are_a_uniform_shuffle(spark):
    """Within one bucket: where rows come to lie depends neither on where they were nor on their neighbours."""
    n, parts = 6000, 6
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    place = {}
    for seed in (1, 2):
        rows = shuffle_into_shards(docs, shards=1, seed=seed, bucket_bytes=1 << 30).select("doc_id", "slot").collect()
        place[seed] = np.array([s for _, s in sorted((r.doc_id, r.slot) for r in rows)])
        assert sorted(place[seed].tolist()) == list(range(n))
        table = np.zeros((parts, parts))
        np.add.at(table, (np.arange(n) * parts // n, place[seed] * parts // n), 1)
        mean = n / parts**2
        assert ((table - mean) ** 2 / mean).sum() < 60  # 25 degrees of freedom: beyond 60 in one of 10,000
        rises = (np.diff(place[seed]) > 0).mean()
        assert abs(rises - 0.5) < 0.03 and abs(np.corrcoef(place[seed][:-1], place[seed][1:])[0, 1]) < 0.06
    assert abs(np.corrcoef(place[1], place[2])[0, 1]) < 0.06


def test_the_fit_of_quality_rules_holds_its_pairs_once():
    """It runs on the driver: pairs of text and bucket take 16 bytes each and are not copied as a whole."""
    import random
    import tracemalloc

    import numpy as np

    from tessera.llm import quality_rules

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)) for _ in range(600)]
    tracemalloc.start()
    try:
        model = quality_rules.fit(texts, np.arange(600) % 3 == 0, 0.3, rounds=3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    pairs = sum(sum(min(len(t.encode()) - n + 1, len({t[k : k + n] for k in range(len(t) - n + 1)})) for n in quality_rules.CHAR_NGRAMS) + len(t.split()) * 2 for t in texts)
    assert model is not None and peak < 48 * pairs
