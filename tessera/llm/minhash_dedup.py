"""Near-duplicates by MinHash: banded candidates, sequential Bayesian pruning, exact verification.

Sets are the distinct 5-word shingles of lower-cased texts (64-bit hashes of whole word sequences); a shorter
text's whole word sequence is its one shingle. Texts of equal sets are one node from the start, whatever their
number. Nodes that share a band of MinHash values are candidates. Their signatures are compared batch by
batch: a pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls
under ``miss``. What survives is verified on the full sets. Bands are so many that a pair at the threshold
shares none with a probability under ``miss_bands``.

Links are only needed between nodes that aren't connected yet. So candidates are taken in three rounds: each
node's best partner in a bucket, its best six, then all that remain; between the rounds links are contracted to
components, and pairs inside a component aren't looked at any more. The last round leaves no surviving pair
between two components unverified. Buckets of over ``BLOCK`` nodes are dealt out in blocks, and in the last round
in pairs of blocks, so no bucket is brought to one task. In that round the nodes of a bucket of over ``LARGE`` nodes are
dealt by a second band as well, one bucket for each other band and for each further one that the stored low bytes hold, so that
copies grow with the bands and not with the bucket's size. There are so many of these that a threshold pair shares one band
alone, or none, with a probability under ``miss_bands`` in all (``loss_of_two_bands``), so this switch keeps the bound.

Rows of a node that holds over a ``HOT``-th of all rows (there are fewer than ``HOT`` of these) meet their component by a broadcast.

Defined cases: null or empty texts have an empty set and are linked with nothing; null ids are linked like
others, and count in component_id only if a group has no other id; repeated rows are equal sets; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import BYTE_VALUE, SPACE, hash_runs, lower_ascii, mix, one_array, runs, text_slices, windows
from tessera.llm.tables import in_arrow, stored, whole_row

SHINGLE = 5
BAND_ROWS = 5
HASHES = 224
BATCH = 32  #: signature values compared at a time
BLOCK = 2048
LARGE = 32 * BLOCK  #: nodes of a bucket beyond which its pairs are sought in buckets of two bands
HOT = 1000
PAIRS_AT_ONCE = 1 << 19
BITMAP = 1 << 22
PARTNERS = 512  #: nodes of a block whose sets a task holds, on average
_U32 = np.uint32


def bands_for(threshold: float, miss: float, rows: int = BAND_ROWS) -> int:
    """Bands so that a pair at the threshold shares none with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def further_bands(bands: int, rows: int = BAND_ROWS) -> int:
    """Bands of low bytes that no band uses."""
    return max(0, HASHES - bands * rows) // rows


def loss_of_two_bands(threshold: float, bands: int, further: int, rows: int = BAND_ROWS) -> float:
    """The probability that a pair at the threshold shares no band, or just one and none of the further ones."""
    p = threshold**rows
    return (1 - p) ** bands + bands * p * (1 - p) ** (bands - 1 + further)


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (values[:n] >> np.uint64(32)).astype(_U32), (values[n:] >> np.uint64(32)).astype(_U32) | _U32(1)


@lru_cache
def least_matches(threshold: float, miss: float, hashes: int, batch: int) -> tuple[int, ...]:
    """For each number of compared 8-bit values (one batch, two, ...): the fewest matches at which a pair goes on.

    The prior of the similarity is uniform; equal 8-bit values occur with probability s + (1 - s) / 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() >= miss * weight.sum():
                out.append(m)
                break
    return tuple(out)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: number of the first, the sorted distinct shingle hashes of all, and where each text's begin."""
    for t in text_slices(column):
        data = lower_ascii(t.data)
        words = runs(~SPACE[data], t.offsets)
        hashed = hash_runs(data, words.start, words.end)
        found, before = windows(hashed, words.first, size)
        doc = np.repeat(np.arange(t.n), np.diff(before))
        n_words = np.diff(words.first)
        for k in np.flatnonzero((n_words > 0) & (n_words < size)):  # the whole sequence, told apart from longer ones by its length
            whole = np.uint64(n_words[k])
            for h in hashed[words.first[k] : words.first[k + 1]]:
                whole = mix(np.array([whole ^ h], np.uint64))[0]
            found, doc = np.append(found, whole), np.append(doc, k)
        order = np.lexsort((found, doc))
        found, doc = found[order], doc[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
        found, doc = found[new], doc[new]
        yield t.lo, found, np.searchsorted(doc, np.arange(t.n + 1))


def fingerprints(sets: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes that tell a set from others; None for an empty set."""
    size = np.diff(first).astype(np.uint64)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ BYTE_VALUE[k]), dtype=np.uint64)]) for k in (0, 1)]
    both = np.stack([mix((x[first[1:]] - x[first[:-1]]) ^ mix(size)) for x in sums], 1)
    return [both[k].tobytes() if size[k] else None for k in range(len(size))]


def signatures(docs: DataFrame, bands: int, shingle: int) -> DataFrame:
    """Per row: doc_id, n_shingles, node (the set), low (low bytes of its MinHash values), bands (their hashes) and hash (of the text)."""
    xor, times = hash_family(max(HASHES, bands * BAND_ROWS))
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_shingles", "node", "low", "bands", "hash"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, sets, first in shingle_sets(batch.column(1), shingle):
                size = np.diff(first)
                full = size > 0
                least = np.full((len(size), len(xor)), 0, _U32)
                half = (sets >> np.uint64(32)).astype(_U32)
                for k in range(len(xor)):
                    if full.any():
                        least[full, k] = np.minimum.reduceat((half ^ xor[k]) * times[k], first[:-1][full])
                rows = least[:, : bands * BAND_ROWS].reshape(len(size), bands, BAND_ROWS).astype(np.uint64)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(size), bands))
                for k in range(BAND_ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
                low = np.ascontiguousarray(least[:, :HASHES].astype(np.uint8))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]), pa.int32()), pa.array(band[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(size)), pa.array(size, pa.int64()), pa.array(fingerprints(sets, first), pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), lists, batch.column(2).slice(lo, len(size))],
                    names=names,
                )

    return in_arrow(docs.select("doc_id", "text", "hash"), batches, f"doc_id {key}, n_shingles long, node binary, low binary, bands array<long>, hash long")


def candidate_pairs(members: DataFrame, threshold: float, miss: float, best: int | None) -> DataFrame:
    """Surviving pairs of members that share a bucket and aren't of one component: a and its others, all greater.

    members: bucket, block_a, block_b, block (the member's own), node, component, n_shingles, low. ``best``: pairs that
    are among so many best of one of their ends in the bucket; None: all.
    """
    limits = least_matches(threshold, miss, HASHES, BATCH)

    def compare(group: np.ndarray, component: np.ndarray, size: np.ndarray, own: np.ndarray, across: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of surviving pairs within groups, in a pair of blocks only those across; equal groups are adjacent."""
        n = np.arange(len(group))
        partners = np.searchsorted(group, group, "right") - 1 - n
        before = np.concatenate([[0], np.cumsum(partners)])
        left, right, score = [], [], []
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PAIRS_AT_ONCE, "right")) - 1)
            each = partners[lo:hi]
            a = np.repeat(n[lo:hi], each)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
            fine = (component[a] != component[b]) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) * (1 - 1e-12)) & (~across[a] | (own[a] != own[b]))
            a, b = a[fine], b[fine]
            matches = np.zeros(len(a), np.int64)
            for k, limit in enumerate(limits):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches += (low[a, part] == low[b, part]).sum(1)
                on = matches >= limit
                a, b, matches = a[on], b[on], matches[on]
            left.append(a)
            right.append(b)
            score.append(matches)
            lo = hi
        a, b, score = np.concatenate(left), np.concatenate(right), np.concatenate(score)
        if best is None or not len(a):
            return a, b
        keep = np.zeros(len(a), bool)
        for end in (a, b):
            order = np.lexsort((a + b, -score, end))
            new = np.ones(len(a), bool)
            new[1:] = end[order][1:] != end[order][:-1]
            nth = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            keep[order[nth < best]] = True
        return a[keep], b[keep]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in it:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            keys = group_keys(rest)
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on
            if cut:
                yield from found(rest.slice(0, cut), keys[:cut])
                rest = rest.slice(cut)
        if rest is not None and len(rest):
            yield from found(rest, group_keys(rest))

    def group_keys(table: pa.Table) -> np.ndarray:
        columns = [table.column(c).to_numpy() for c in ("bucket", "block_a", "block_b")]
        new = np.zeros(len(table), np.int64)
        if len(table):
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return np.cumsum(new)

    def found(table: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        component = pc.dictionary_encode(one_array(table.column("component"))).indices.to_numpy()
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(table), HASHES)
        own, block_a, block_b = (table.column(c).to_numpy() for c in ("block", "block_a", "block_b"))
        a, b = compare(keys, component, table.column("n_shingles").to_numpy(), own, block_a != block_b, low)
        node = one_array(table.column("node"))
        swap = pc.less(node.take(pa.array(a)), node.take(pa.array(b))).to_numpy(zero_copy_only=False)
        a, b = np.where(swap, a, b), np.where(swap, b, a)
        order = np.argsort(a, kind="stable")
        own, first = np.unique(a[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), node.take(pa.array(b[order])))
        yield pa.RecordBatch.from_arrays([node.take(pa.array(own)), lists], names=["a", "others"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = members.select("bucket", "block_a", "block_b", "block", "node", "component", "n_shingles", "low").repartition(parts, "bucket", "block_a", "block_b").sortWithinPartitions("bucket", "block_a", "block_b", "node")
    each = in_arrow(grouped, batches, "a binary, others array<binary>")
    return each.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))


def verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join all nodes of ``pairs`` (a, others) that their full sets link.

    A pair is linked if share[1] * intersection >= share[0] * union. Nodes are dealt into blocks, and a task has the
    sets (sets: node, items) of two blocks; it gives no link between nodes that its links join already.
    """
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(pairs.count() / PARTNERS))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for pairs of blocks: each node whose set is due there, and each node with its others there."""
        block, sent = None, set()
        for batch in it:
            rows = []
            for own, a, others in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if own != block:
                    block, sent = own, set()
                there: dict[int, list[bytes]] = {}
                for b in others:
                    there.setdefault(zlib.crc32(b) % blocks, []).append(b)
                for k, some in there.items():
                    rows.append((own, k, a, some))
                    for node in (a, *some):
                        if (k, node) not in sent:
                            sent.add((k, node))
                            rows.append((own, k, node, None))
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())))], names=["own", "block", "node", "others"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, parent = None, {}, {}

        def root(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                x = parent[x] = parent[parent[x]]
            return x

        for batch in it:
            links = []
            for own, k, node, others, items in zip(*(batch.column(n).to_pylist() for n in range(5))):
                if (own, k) != here:
                    here, held, parent = (own, k), {}, {}
                if others is None:
                    held[node] = np.frombuffer(items, np.uint64)
                    continue
                mine = held[node]
                for b in others:
                    if root(node) != root(b):
                        theirs = held[b]
                        both = np.sort(np.concatenate([mine, theirs]), kind="stable")
                        common = int((both[1:] == both[:-1]).sum())
                        if share[1] * common >= share[0] * (len(both) - common):
                            parent[root(b)] = root(node)
                            links.append((node, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    dealt = pairs.select(F.pmod(F.crc32("a"), F.lit(blocks)).alias("own"), "a", "others").repartition(parts, "own").sortWithinPartitions("own")
    due = in_arrow(dealt, deal, "own long, block long, node binary, others array<binary>")
    due = stored(due, "due")
    with_sets = due.where("others is null").join(sets, "node").select("own", "block", "node", "others", "items")
    both = with_sets.unionByName(due.where("others is not null").withColumn("items", F.lit(None).cast("binary")))
    return in_arrow(both.repartition(parts, "own", "block").sortWithinPartitions("own", "block", F.col("others").isNotNull()), compare, "a binary, b binary")


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after components that links (a, b) join are one, named by its smallest."""
    by = labels.withColumnRenamed("component", "_c")
    edges = links.join(by.withColumnRenamed("node", "a").withColumnRenamed("_c", "u"), "a").join(by.withColumnRenamed("node", "b").withColumnRenamed("_c", "v"), "b").where("u <> v").select("u", "v").distinct()
    edges = stored(edges, "edges")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        next_up = hooked.select(F.col("u").alias("to"), F.col("to").alias("up"))
        moved = stored(hooked.join(next_up, "to", "left").select("u", F.coalesce("up", "to").alias("to")), "moved")
        labels = stored(labels.join(moved.select(F.col("u").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        for end in ("u", "v"):
            edges = edges.join(moved.select(F.col("u").alias(end), F.col("to").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
        edges = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    return labels


def near_duplicates(docs: DataFrame, share: tuple[int, int] = (85, 100), miss: float = 1e-5, miss_bands: float = 1e-6, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two texts are linked if share[1] * |intersection| >= share[0] * |union| of their sets.
    """
    rows, nodes, labels = linked(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), share, miss, miss_bands, shingle)
    grouped = labels.join(nodes.select("node", "least_id"), "node")
    smallest = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    final = nodes.select("node", "least_id", "n").join(grouped.join(smallest, "component").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"), "n")
    out = by_node(rows.select("doc_id", "n_shingles", "node"), stored(final, "final")).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def by_node(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows left-joined to what is known of their node (node, n: its rows, and others); those of the largest nodes by a broadcast."""
    total = rows.count()
    hot = F.col("n") * HOT > total  # fewer than HOT nodes
    large = F.broadcast(known.where(hot).drop("n"))
    some = rows.join(large, "node")
    rest = rows.join(F.broadcast(known.where(hot).select("node")), "node", "left_anti").join(known.where(~hot).drop("n"), "node", "left")
    return some.unionByName(rest)


def linked(docs: DataFrame, share: tuple[int, int], miss: float = 1e-5, miss_bands: float = 1e-6, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of the rows (doc_id, text, hash: of the text), the nodes, and the component of each node that may have links."""
    threshold = share[0] / share[1]
    bands = bands_for(threshold, miss_bands)
    while loss_of_two_bands(threshold, bands, further_bands(bands)) > miss_bands:
        bands += 1
    rows = stored(signatures(docs, bands, shingle), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")  # whose text stands for the node's
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(row).alias("row"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("low").alias("low"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select("node", F.col("row.doc_id").alias("least_id"), "row.hash", "n", "n_shingles", "low", "bands"), "nodes")
    in_bands = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(in_bands.join(shared, "bucket"), "members")
    candidates = nodes.drop("bands", "n").join(members.select("node").distinct(), "node", "left_semi")
    candidates = stored(candidates, "candidates")
    sets = stored(node_sets(docs, candidates, shingle), "sets")
    labels = candidates.select("node", F.col("node").alias("component"))
    tested = None
    for turn, best in enumerate((1, 6, None)):
        # only buckets that hold two components or more
        labelled = (members if best is not None else by_two_bands(members, in_bands, candidates, bands)).join(labels, "node")
        split = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        known = labelled.join(split, "bucket").join(candidates, "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), blocks).cast("int"))
        if best is None:
            known = known.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other"))
        else:
            known = known.withColumn("block_a", F.col("block")).withColumn("block_b", F.col("block"))
        pairs = candidate_pairs(known, threshold, miss, best)
        if tested is not None:
            pairs = pairs.join(tested.withColumnRenamed("others", "past"), "a", "left").select("a", F.array_except("others", F.coalesce("past", F.array())).alias("others")).where(F.size("others") > 0)
        pairs = stored(pairs, "pairs")
        if not pairs.limit(1).count():
            continue
        tested = pairs if tested is None else stored(tested.unionByName(pairs).groupBy("a").agg(F.flatten(F.collect_list("others")).alias("others")), "tested")
        labels = contracted(labels, stored(verified(pairs, sets, share), "links"))
    return rows, nodes, labels


def by_two_bands(members: DataFrame, in_bands: DataFrame, candidates: DataFrame, bands: int) -> DataFrame:
    """members (bucket, node, n) with those of buckets of over ``LARGE`` nodes in buckets of two bands in their place."""
    large = members.where(F.col("n") > LARGE)
    if large.isEmpty():
        return members
    first = large.select("node", F.col("bucket").alias("first"))
    further = F.array(*[F.xxhash64(F.lit(k), F.substring("low", bands * BAND_ROWS + k * BAND_ROWS + 1, BAND_ROWS)) for k in range(further_bands(bands))])
    others = in_bands.unionByName(candidates.select("node", F.explode(further.cast("array<bigint>")).alias("bucket")))
    second = first.join(others, "node").where("bucket <> first").select("node", F.xxhash64("first", "bucket").alias("bucket"))
    shared = second.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return members.where(F.col("n") <= LARGE).unionByName(stored(second.join(shared, "bucket").select(*members.columns), "members-of-two"))


def node_sets(docs: DataFrame, candidates: DataFrame, shingle: int) -> DataFrame:
    """node and items (its sorted shingle hashes) of the candidates, each from a text of that hash.

    Rows that aren't in a bitmap of the candidates' rows (by id and hash) are left out before they are shuffled. The bitmap
    has ``BITMAP`` bits at every size of the input; a fuller one lets more texts through. Equal texts meet once.
    """
    bit = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(BITMAP))
    words = candidates.select(F.col("least_id").alias("doc_id"), "hash").select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).collect()
    marked = np.zeros(BITMAP >> 5, np.uint32)
    for r in words:  # at most BITMAP / 32 rows
        marked[r["word"]] = r["bits"]

    def possible(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.column(2).to_numpy()
            fine = (marked[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fine.astype(bool))) for c in batch.columns[:2]], names=["hash", "text"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            wanted = batch.column(0).to_pylist()
            for lo, sets, first in shingle_sets(batch.column(1), shingle):
                at = [k for k, node in enumerate(fingerprints(sets, first)) if node == wanted[lo + k]]
                yield pa.RecordBatch.from_arrays([pa.array([wanted[lo + k] for k in at], pa.binary()), pa.array([sets[first[k] : first[k + 1]].tobytes() for k in at], pa.binary())], names=["node", "items"])

    some = in_arrow(docs.select("hash", "text", bit.alias("bit")), possible, "hash long, text string")
    once = some.groupBy("hash").agg(F.first("text").alias("text"))
    return in_arrow(once.join(candidates.select("node", "hash"), "hash").select("node", "text"), batches, "node binary, items binary")


def drop_near_duplicates(docs: DataFrame, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id (nulls last), then hash of the text.

    Rows are told apart by id and text, so rows of equal ids are judged each by its own text. Of rows equal in both
    one stays, that with the smallest hash of all columns. Rows without words stay.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), whole_row(docs))
    rows, nodes, labels = linked(keyed.select("doc_id", "text", "hash"), share)
    component = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    component = stored(component.join(nodes.select("node", "n"), "node"), "components")
    placed = by_node(rows.select(F.col("doc_id").alias("id"), F.col("hash").alias("of"), "node").where("node is not null"), component)
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "of")).alias("first"))
    chosen = F.col("id").eqNullSafe(F.col("first")["id"]) & (F.col("of") == F.col("first")["of"])
    keys = placed.join(first, "component").groupBy("id", "of").agg(F.bool_or(chosen).alias("chosen"), F.count("*").alias("n"))
    keys = stored(keys.where("not chosen or n > 1"), "gone-or-repeated")
    repeated = stored(keys.where("chosen").select("id", "of"), "repeated")
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of"))
    once = keyed.join(keys, match, "left_anti").select("row")
    several = keyed.join(repeated, match, "left_semi").groupBy("doc_id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.unionByName(several.select("row")).select("row.*")
