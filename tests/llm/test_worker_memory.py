"""What a Python worker holds at once, as two of them stand beside an executor's heap."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing, quality_rules, suffix_dedup, tables
from tessera.llm.queries import tokenizer_path


def peak_of(call):
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture
def texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    return [" ".join(rng.choices(words, k=2000)) for _ in range(300)]  # about 4 MB


def test_names_of_a_block_take_small_slices(texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup.Rolling, "forth", [suffix_dedup.powers(1)] * 2)
    monkeypatch.setattr(suffix_dedup.Rolling, "back", [suffix_dedup.powers(1)] * 2)
    n = len(texts)
    row = pa.StructArray.from_arrays([pa.array(["".join(texts)] + texts[1:])], names=["text"])  # a text of 4 MB among them
    docs = pa.table({"ord": np.arange(n), "place": np.arange(n), "tag": np.arange(n), "more": np.arange(n), "row": row})
    block = suffix_dedup.Block(docs, suffix_dedup.rows_of([]), 0)
    peak = peak_of(lambda: block.names(40))
    samples = int(block.size.sum()) * len(suffix_dedup.COVER) // suffix_dedup.MODULUS
    assert peak < 2 * 8 * samples + (40 << 20)
    assert sum(x.nbytes for x in suffix_dedup.Rolling.forth + suffix_dedup.Rolling.back) < 16 << 20


def scored(df, docs):
    """What score_quality's workers do with batches."""
    frame = SimpleNamespace(select=lambda *_: df, schema={"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}, columns=["doc_id", "text"])
    model = quality_rules.QualityModel(np.ones((quality_rules.KINDS, 1 << quality_rules.BITS), np.float32), 0.0, (1.0, 0.0))
    return list(quality_rules.score_quality(frame, model)(iter([docs])))


class Frame:
    """Stands for a DataFrame: mapInArrow gives its function."""

    sparkSession = SimpleNamespace(conf=SimpleNamespace(set=lambda *_: None))

    def mapInArrow(self, f, _):
        return f


def test_scores_take_small_slices(texts):
    docs = pa.record_batch({"doc_id": np.arange(len(texts)), "text": texts})
    out = []
    assert peak_of(lambda: out.extend(scored(Frame(), docs))) < 32 << 20
    assert sum(len(b) for b in out) == len(texts)


def test_ids_take_small_slices(texts):
    own = packing.encoder(tokenizer_path("word_bpe_49k.json"))
    column = pa.array(texts)
    own.ids(column.slice(0, 20).cast(pa.large_string()))  # loads and learns
    frame = SimpleNamespace(select=lambda *_: Frame(), schema={"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    work = packing.token_pieces(frame, tokenizer_path("word_bpe_49k.json"), keep_ids=True)
    assert peak_of(lambda: [None for _ in work(iter([pa.record_batch({"doc_id": np.arange(len(texts)), "text": column})]))]) < 24 << 20


def test_workers_give_memory_back_with_every_few_mb(monkeypatch):
    given = []
    monkeypatch.setattr(tables, "give_back", lambda: given.append(1))
    batch = pa.record_batch({"x": np.zeros(1 << 17)})  # 1 MB
    out = list(tables.in_arrow(Frame(), lambda it: it, "x double")(iter([batch] * 16)))
    assert len(out) == 16 and len(given) == 5  # after every 4 MB, and at the end
