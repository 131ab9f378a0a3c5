"""Near duplicates by MinHash bands, with sequential Bayesian verification of candidates.

1. Every text gets its shingle set's digest and signature in one pass; texts of
   equal sets are one set from here on.
2. Sets that agree in a whole band of the signature share a bucket. The leader of
   a bucket is the set that meets most others over all its buckets, usually what
   the others were copied from; all members of its buckets make its group, so
   that whatever shares a bucket meets in a group. Large groups go in chunks.
3. In a group, signatures are compared in batches of hashes. After each batch a
   pair goes if, given its matches so far, the posterior probability of the
   wanted similarity is below the chosen miss probability. Sets without any
   likely partner leave the group.
4. The rest bring their texts, and likely pairs are verified on the full shingle
   sets, but for sets that verified links connect already.
5. Sets of a large group that its chunks leave apart from the leader meet the
   other chunks in the same way.

A pair at the wanted similarity is missed with probability ``MISS`` at most in
the bands and again in the comparison, links are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import BLOCK_CHARS, row_slices
from opinion_spark.llm.components import connected_components
from opinion_spark.llm.wordhash import SPACED, hash_words, mix, shingle_sets
from opinion_spark.session import stage

SHINGLE_WORDS = 4
PERCENT = 80
#: Probability of missing a pair that is just similar enough.
MISS = 1e-8
#: Hashes of a signature, of which one byte each is kept, and hashes compared at a time.
HASHES, BATCH = 256, 32
#: Sets that one task compares with each other, and shingles of them all.
GROUP_SETS = 1024
GROUP_SHINGLES = 1 << 21

SET_SCHEMA = "row bigint, doc_id bigint, n_shingles bigint, high bigint, low bigint, signature binary, bands array<bigint>, text binary"


def band_rows(percent: int, miss: float = MISS, hashes: int = HASHES) -> int:
    """The most hashes a band can have so that all bands together miss a pair at ``percent`` with probability ``miss`` at most."""
    def missed(rows: int) -> float:
        return (1 - (percent / 100) ** rows) ** (hashes // rows)

    fitting = [rows for rows in range(1, hashes + 1) if missed(rows) <= miss]
    if not fitting:
        raise ValueError(f"{hashes} hashes cannot find pairs at {percent} % with a miss probability of {miss}")
    return max(fitting)


def least_matches(percent: int, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> np.ndarray:
    """After each batch, the matches below which a pair goes.

    With a uniform prior the posterior after m matches of n is Beta(m+1, n-m+1);
    its mass from t up is the chance of at most m successes in n+1 trials at t.
    The miss probability is shared out over the batches.
    """
    t = percent / 100
    out = []
    for n in range(batch, hashes + 1, batch):
        mass, m = 0.0, -1
        while mass < miss * batch / hashes:
            m += 1
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def multipliers(hashes: int = HASHES) -> np.ndarray:
    return mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """The least hash of each (not empty) set, for each hash function: a row per set."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), hashes), dtype=np.uint64)
    hashed = np.empty_like(joined)
    for i, a in enumerate(multipliers(hashes)):
        np.multiply(joined, a, out=hashed)
        out[:, i] = np.minimum.reduceat(hashed, starts)
    return out


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` hashes, different between bands."""
    bands = least.shape[1] // rows
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(least), 1))
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, k:bands * rows:rows])
    return keys


def signed_sets(docs: DataFrame, n: int, percent: int, text: str, key: str) -> DataFrame:
    """Every row with a number of its own, its set's size, digest, signature and bands, and its text; written."""
    rows_of = band_rows(percent)
    arrow = to_arrow_schema(StructType.fromDDL(SET_SCHEMA))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, 2, BLOCK_CHARS):
                sets = shingle_sets(hash_words(rows.column(2).to_pylist(), SPACED), n)
                full = np.flatnonzero([len(s) > 0 for s in sets])
                empty = np.array([len(s) == 0 for s in sets], dtype=bool)
                digests = np.zeros((len(sets), 2), dtype=np.int64)
                signatures: list[bytes | None] = [None] * len(sets)
                bands: list[np.ndarray | None] = [None] * len(sets)
                if len(full):
                    least = minima([sets[i] for i in full])
                    # The least hash of a large set has no high bits left: mixed before a byte of it is kept.
                    kept = (mix(least) & np.uint64(255)).astype(np.uint8)
                    keys = band_keys(least, rows_of).view(np.int64)
                    for at, i in enumerate(full.tolist()):
                        digests[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), dtype="<i8")
                        signatures[i], bands[i] = kept[at].tobytes(), keys[at]
                columns = [
                    rows.column(0), rows.column(1), [len(s) for s in sets], pa.array(digests[:, 0].copy(), mask=empty), pa.array(digests[:, 1].copy(), mask=empty),
                    signatures, bands, rows.column(2),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    source = docs.select(F.monotonically_increasing_id().alias("row"), named(key).cast("bigint").alias("doc_id"), named(text).cast("binary").alias("text"))
    return stage(source.mapInArrow(work, SET_SCHEMA), "signed-sets")


def still_possible(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places of the pairs of signatures (rows of ``left`` and ``right``; one row is paired with all) that pass every batch."""
    alive = np.arange(max(len(left), len(right)))
    matches = np.zeros(len(alive), dtype=np.int64)
    for k, need in enumerate(least.tolist()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        a = left[:, part] if len(left) == 1 else left[alive, part]
        b = right[:, part] if len(right) == 1 else right[alive, part]
        matches = matches + (a == b).sum(axis=1)
        on = matches >= need
        alive, matches = alive[on], matches[on]
        if not len(alive):
            break
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    """A row of bytes for each signature of a column without nulls."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)
    start = int(bounds[column.offset])
    return np.frombuffer(column.buffers()[2], dtype=np.uint8, offset=start, count=len(column) * HASHES).reshape(len(column), HASHES)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The groups of rows, sorted by their first ``keys`` columns, one at a time, wherever batches end."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in range(keys)])
        cuts = [0, *(np.flatnonzero((found[:, 1:] != found[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            group = tuple(found[:, start].tolist())
            if group != last and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = group
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Group:
    """Sets of one task: their chunks, known components, sizes and signatures."""

    def __init__(self, rows: pa.RecordBatch, percent: int, least: np.ndarray):
        self.low, self.high = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        self.chunk, self.node, label, self.size = (np.asarray(rows.column(c)) for c in (3, 4, 5, 6))
        self.label = label.copy()
        self.signature = _signatures(rows.column(7))
        self.percent, self.least = percent, least

    def likely(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each set with those after it (or in the other chunk) that are in other components and may be similar.

        A caller that changes ``label`` meanwhile is not given what it has connected.
        """
        first = np.flatnonzero(self.chunk == self.low)
        other = np.flatnonzero(self.chunk == self.high)
        for at, i in enumerate(first.tolist()):
            others = first[at + 1:] if self.low == self.high else other
            others = others[self.label[others] != self.label[i]]
            size = self.size[others]
            others = others[100 * np.minimum(size, self.size[i]) >= self.percent * np.maximum(size, self.size[i])]
            if len(others):
                others = others[still_possible(self.signature[i:i + 1], self.signature[others], self.least)]
            if len(others):
                yield i, others


def _with_likely_partners(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of each group that the comparison of signatures leaves a partner there; written."""
    least = least_matches(percent)
    schema = "leader bigint, low int, high int, chunk int, node bigint, label bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            partner = np.zeros(rows.num_rows, dtype=bool)
            for i, others in Group(rows, percent, least).likely():
                partner[i] = partner[others] = True
            if partner.any():
                yield rows.select(range(6)).filter(pa.array(partner))

    # The list of rows grows with the input: it is hashed where both sides are dealt by row, and never sent whole.
    signed = rows.hint("shuffle_hash").join(sets.select(F.col("row").alias("node"), "n_shingles", "signature"), "node")
    signed = signed.select("leader", "low", "high", "chunk", "node", "label", "n_shingles", "signature")
    return stage(signed.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high").mapInArrow(work, schema), "likely-sets")


def group_links(rows: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b``: exact links that connect whatever is connected within each group; written.

    ``rows``: ``leader, low, high, chunk, node, label`` with a group for each
    ``leader, low, high``. Only sets with a likely partner bring their texts.
    """
    least = least_matches(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            own: list[np.ndarray] = []
            for part in row_slices(rows, 8, BLOCK_CHARS):
                own += shingle_sets(hash_words(part.column(8).to_pylist(), SPACED), n)
            group = Group(rows, percent, least)
            # All sets end to end, shingles as small numbers.
            shingle = np.unique(np.concatenate(own), return_inverse=True)[1]
            begin = np.cumsum(group.size) - group.size
            mine = np.zeros(int(shingle.max()) + 1, dtype=bool)
            links: list[tuple[int, int]] = []
            for i, others in group.likely():
                held = shingle[begin[i]:begin[i] + group.size[i]]
                mine[held] = True
                ends = np.cumsum(group.size[others])
                at = np.arange(ends[-1]) + np.repeat(begin[others] - (ends - group.size[others]), group.size[others])
                both = np.add.reduceat(mine[shingle[at]].astype(np.int64), ends - group.size[others])
                mine[held] = False
                linked = others[100 * both >= percent * (group.size[others] + group.size[i] - both)]
                for label in np.unique(group.label[linked]).tolist():
                    # One link for each component that this set joins.
                    links.append((int(group.node[i]), int(group.node[linked[group.label[linked] == label][0]])))
                if len(linked):
                    merged = np.append(group.label[linked], group.label[i])
                    group.label[np.isin(group.label, merged)] = merged.min()
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    likely = _with_likely_partners(rows, sets, percent)
    full = likely.hint("shuffle_hash").join(sets.select(F.col("row").alias("node"), "n_shingles", "signature", "text"), "node")
    full = full.select("leader", "low", "high", "chunk", "node", "label", "n_shingles", "signature", "text")
    return stage(full.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high").mapInArrow(work, "a bigint, b bigint"), "links")


def set_classes(sets: DataFrame) -> DataFrame:
    """``high, low, n_shingles, node, first, rows``: a row for each distinct set, with the number of one of its rows and its least id; written."""
    counted = sets.filter("n_shingles > 0").groupBy("high", "low", "n_shingles")
    return stage(counted.agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "set-classes")


def star_members(sets: DataFrame, classes: DataFrame, group_sets: int) -> DataFrame:
    """``leader, chunks, chunk, node``: the sets that meet each leader in a bucket, and the leader in every chunk; written.

    Two sets that share a bucket are both under its leader. Chunks have about
    ``group_sets`` sets, and fewer where the sets are very large.
    """
    repeated = stage(classes.filter("rows > 1").select("high", "low", "n_shingles", "node"), "repeated-sets")
    # Written, so that its size is known and the bands of all sets are not shuffled for a short list.
    copies = stage(sets.filter("n_shingles > 0").select("row", "high", "low", "n_shingles").join(repeated, ["high", "low", "n_shingles"]).filter("row <> node").select("row"), "copies")
    single = sets.filter("n_shingles > 0").select("row", "bands").join(copies, "row", "left_anti")
    postings = single.select(F.explode("bands").alias("bucket"), F.col("row").alias("node"))
    sizes = postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = stage(postings.join(sizes, "bucket"), "shared-buckets")
    # The degree of a set: how many sets it meets, summed over its buckets.
    degrees = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    best = F.max(F.struct("degree", (-F.col("node")).alias("node")))
    leaders = shared.join(degrees, "node").groupBy("bucket").agg(best.alias("best")).select("bucket", (-F.col("best.node")).alias("leader"))
    stars = stage(shared.join(leaders, "bucket").select("leader", "node").distinct(), "stars")
    weighed = stars.join(sets.select(F.col("row").alias("node"), "n_shingles"), "node")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / group_sets), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES)).cast("int")
    dealt = stars.filter("leader <> node").join(weighed.groupBy("leader").agg(chunks.alias("chunks")), "leader")
    dealt = dealt.select("leader", "chunks", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node")
    heads = dealt.select("leader", "chunks", "chunk").distinct().withColumn("node", F.col("leader"))
    return stage(heads.unionByName(dealt), "star-members")


def chunk_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``group_links`` for every two chunks of the leaders that have several, where anything is still apart from the leader."""
    known = members.filter("chunks > 1 and node <> leader").join(labels, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("label"))
    leaders = members.filter("chunks > 1").select("leader", "chunks").distinct().join(labels, F.col("leader") == F.col("node"), "left").select(
        "leader", F.coalesce("component", "leader").alias("own"))
    marked = known.join(leaders, "leader").withColumn("apart", F.col("label") != F.col("own"))
    wanted = marked.groupBy("leader", "chunk").agg(F.max("apart").alias("any_apart"))
    other = wanted.select("leader", F.col("chunk").alias("other"), "any_apart")
    # Sets connected with the leader go only where some are not.
    sent = marked.join(other, "leader").filter("chunk <> other and (apart or any_apart)")
    return sent.select("leader", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "label")


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id", group_sets: int = GROUP_SETS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Documents link when their sets of distinct ``n``-word shingles (all words as
    one, where there are fewer) have a Jaccard similarity of ``percent`` or more.
    ``component_id`` is the smallest id reachable by links; ``kept`` marks the
    rows of that id. A null or wordless text has an empty set and links with
    nothing. Each row is a document: rows of one id link by their texts only, a
    null id takes part and has its group's smallest id, null if there is none.
    """
    sets = signed_sets(docs, n, percent, text, key)
    full = sets.filter("n_shingles > 0")
    classes = set_classes(sets)
    members = star_members(sets, classes, group_sets)
    chunk = F.col("chunk")
    links = group_links(members.select("leader", chunk.alias("low"), chunk.alias("high"), "chunk", "node", F.col("node").alias("label")), sets, n, percent)
    labels = connected_components(links)
    if not members.filter("chunks > 1").isEmpty():
        links = links.unionByName(group_links(stage(chunk_pairs(members, labels), "chunk-pairs"), sets, n, percent))
        labels = connected_components(links)
    merged = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = merged.groupBy("component").agg(F.min("first").alias("component_id"))
    named_classes = merged.join(least, "component").select("high", "low", "n_shingles", "component_id")
    linked = full.select("doc_id", "n_shingles", "high", "low").join(named_classes, ["high", "low", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
