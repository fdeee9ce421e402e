"""One row of each near-duplicate group stays, also with repeated and null ids, and keeps its text afterwards."""

import random
from collections import Counter

from tessera.llm.minhash_dedup import drop_near_duplicates
from tessera.llm.suffix_dedup import cut_repeats


def test_one_row_of_each_group(spark):
    rng = random.Random(8)
    text = lambda: [str(rng.random()) for _ in range(200)]

    def near(words):
        return " ".join([*words[:-1], str(rng.random())])

    a, b, c, d = (text() for _ in range(4))
    whole = [" ".join(x) for x in (a, b, c, d)]
    rows = [(1, whole[0])] * 3 + [(2, near(a)), (None, near(a)), (None, near(a))]  # repeated smallest id, null copies
    rows += [(5, near(a)), (5, whole[1])]  # one id: a copy, and a clean text
    rows += [(None, whole[2])] * 2  # null ids only
    rows += [(7, None), (7, None), (None, ""), (9, whole[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = drop_near_duplicates(docs)
    want = Counter([(1, whole[0]), (5, whole[1]), (None, whole[2]), (7, None), (7, None), (None, ""), (9, whole[3])])
    assert left.columns == docs.columns
    assert Counter(map(tuple, left.collect())) == want
    assert Counter(r.text for r in cut_repeats(left).collect() if r.text) == Counter(whole)
    nulls = spark.createDataFrame([(None, near(d)) for _ in range(3)], "doc_id long, text string")
    assert drop_near_duplicates(nulls).count() == 1
