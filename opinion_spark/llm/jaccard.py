"""Exact Jaccard join of word n-gram sets, by set relations.

1. Texts of equal sets are one set from here on.
2. A sketch of shingle frequencies over all texts gives one order of shingles,
   rare ones first. Two sets that link share a shingle in their prefixes by that
   order (prefix filtering), so each set posts its prefix only.
3. In a posting list the sets are ordered by size. Leaders cover the sizes they
   could link with; every set is attached to its leader and the one before, so
   that two sets that can link meet under a leader.
4. Each set has a bitmap of the places its shingles take, two places a shingle
   or more. Places that one set takes and another does not bound their
   similarity from above; a set that can link with no other under a leader is
   left out there, and its text is not sent.
5. The sets under a leader are joined exactly in one task, a hot leader's in
   several: index lists ordered by position let whole blocks be skipped, and
   sets very similar to one whose answers are known derive theirs from those
   answers and the few shingles in which they differ.
6. Links are merged to components by rounds of stars.

The sketch only orders shingles: it costs time where it is coarse, no links.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import map_batches, map_blocks, numbered_rows, row_slices
from opinion_spark.llm.bit_tables import bit_place, bit_table, filter_rows, may_hold
from opinion_spark.llm.components import connected_components
from opinion_spark.llm.wordhash import SPACED, hash_words, shingle_sets, text_blocks
from opinion_spark.session import drop_staged, stage, staged_paths

SHINGLE_WORDS = 5
PERCENT = 80
#: Counters of the frequency sketch: 4 MB as sent to the tasks, whatever the input.
SKETCH_BITS = 20
#: Sets under a leader that one task joins.
GROUP_SETS = 512
#: Bytes of compressed texts that are unpacked at a time.
PACKED_BLOCK = 1 << 18
#: Bytes of bitmaps that are compared at a time; a group of more goes on whole.
GROUP_BITS = 1 << 24
_PARTS = 64


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _packed_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, compressed."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << (8 * w - (w == 8)))
    return zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _unpacked_counts(packed: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, dtype=f"<u{len(raw) // size}").astype(np.int64)


def shingle_sketch(docs: DataFrame, n: int = SHINGLE_WORDS, text: str = "text") -> np.ndarray:
    """How many texts have a shingle in each of the sketch's buckets."""
    width = (1 << SKETCH_BITS) // _PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for rows in row_slices(batch, 0):
                for shingles in shingle_sets(hash_words(rows.column(0).to_pylist(), SPACED), n):
                    np.add.at(total, _buckets(shingles), 1)
        rows = total.reshape(_PARTS, width)
        yield pa.RecordBatch.from_pydict({"part": list(range(_PARTS)), "counts": [_packed_counts(r) for r in rows]}, schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.int64)
        for raw in parts["counts"]:
            total += _unpacked_counts(raw, width)
        return pd.DataFrame({"part": parts["part"].iloc[:1], "counts": [_packed_counts(total)]})

    counted = map_batches(docs.select(named(text).alias("text")), count, "part int, counts binary")
    sketch = np.zeros((_PARTS, width), dtype=np.int64)
    for row in counted.groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        sketch[row.part] = _unpacked_counts(row.counts, width)
    return np.minimum(sketch, 2**32 - 1).astype(np.uint32).reshape(-1)


def prefix_length(size: int, percent: int) -> int:
    """Shingles of a set of which one must be shared for a similarity of ``percent``."""
    return size - -(-size * percent // 100) + 1


def text_sets(docs: DataFrame, sketch: np.ndarray, n: int, percent: int, text: str, key: str) -> DataFrame:
    """``doc_id, n_shingles, digest, prefix, bits`` of every row; the prefix is null for an empty set."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(c: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(hash_words(c["text"], SPACED), n)
        digests, prefixes = [], []
        for s in sets:
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            if len(s):
                rare = np.lexsort((s, sent.value[_buckets(s)]))[:prefix_length(len(s), percent)]
                prefixes.append(s[rare].view(np.int64))
            else:
                prefixes.append(None)
        return {"doc_id": c["doc_id"], "n_shingles": [len(s) for s in sets], "digest": digests, "prefix": prefixes, "bits": [set_bits(s) for s in sets]}

    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).alias("text"))
    return map_blocks(source, run, "doc_id bigint, n_shingles bigint, digest binary, prefix array<bigint>, bits binary")


def set_bits(shingles: np.ndarray) -> bytes:
    """A bit for each place, of a power of two that is at least twice the set's size, that holds a shingle."""
    level = max(6, (2 * len(shingles) - 1).bit_length())
    places = np.zeros(1 << level, dtype=bool)
    places[(shingles >> np.uint64(64 - level)).astype(np.int64)] = True
    return np.packbits(places).tobytes()


def _at_width(bits: bytes, width: int) -> np.ndarray:
    """The bitmap in ``width`` bytes: neighbouring places become one."""
    raw = np.frombuffer(bits, dtype=np.uint8)
    return raw if len(raw) == width else np.packbits(np.unpackbits(raw).reshape(8 * width, -1).any(axis=1))


def may_link(sizes: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which of some sets can have the similarity with another of them, as far as their bitmaps tell; all that do are among them."""
    width = min(map(len, bits))
    places = np.stack([_at_width(b, width) for b in bits]).view(np.uint64)
    taken = np.bitwise_count(places).sum(axis=1, dtype=np.int64)
    found = np.zeros(len(bits), dtype=bool)
    for i in range(len(bits)):
        if found[i]:
            continue
        both = np.bitwise_count(places & places[i]).sum(axis=1, dtype=np.int64)
        # A place of one set alone holds a shingle at least that the other lacks.
        most = np.minimum(sizes[i] - (taken[i] - both), sizes - (taken - both))
        hit = 100 * most >= percent * (sizes + sizes[i] - most)
        hit[i] = False
        if hit.any():
            found |= hit
            found[i] = True
    return found


def _linkable(percent: int):
    """``leader, member`` of rows sorted by leader, without members that can link with no other there; a group may go on in the next batch."""
    def keep(leader: int, group: list[tuple[int, int, bytes]]) -> set[tuple[int, int]]:
        if len(group) < 2:
            return set()
        found = may_link(np.array([n for _, n, _ in group], dtype=np.int64), [b for _, _, b in group], percent)
        return {(leader, group[i][0]) for i in np.flatnonzero(found).tolist()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, group, held, whole = None, [], 0, False
        kept: set[tuple[int, int]] = set()
        for batch in batches:
            for rows in row_slices(batch, 3):
                for of, member, n, bits in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                    if of != leader:
                        kept |= keep(leader, group)
                        leader, group, held, whole = of, [], 0, False
                    held += len(bits)
                    if whole or held > GROUP_BITS:
                        kept.update((leader, m) for m, _, _ in group)
                        kept.add((leader, member))
                        group, whole = [], True
                    else:
                        group.append((member, n, bits))
                if kept:
                    yield _pairs(kept)
                    kept = set()
        kept |= keep(leader, group)
        if kept:
            yield _pairs(kept)

    return work


def _pairs(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(sorted(pairs), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["leader", "member"])


def _attach(percent: int):
    """Leaders of sorted postings, one batch after another; a list may go on in the next batch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, leaders = None, []
        for batch in batches:
            tokens, sizes, ids = (batch.column(i).to_numpy() for i in range(3))
            if not len(tokens):
                continue
            same = tokens[1:] == tokens[:-1]
            shared = np.zeros(len(tokens), dtype=bool)
            shared[1:] |= same
            shared[:-1] |= same
            shared[0] = shared[-1] = True
            rows = np.flatnonzero(shared)
            pairs: set[tuple[int, int]] = set()
            for t, size, i in zip(tokens[rows].tolist(), sizes[rows].tolist(), ids[rows].tolist(), strict=True):
                if t != token:
                    token, leaders = t, []
                if not leaders or 100 * leaders[-1][0] < percent * size:
                    leaders = [*leaders[-1:], (size, i)]
                # A leader's sets and the larger ones that these can link with.
                pairs.update((leader, i) for n, leader in leaders if leader != i and 10_000 * n >= percent * percent * size)
            if pairs:
                yield _pairs(pairs)
    return work


class SetJoin:
    """Links among some sets, found in one task.

    ``sets`` are sorted arrays of distinct shingles, none empty. ``labels``:
    sets of one label are known to be connected and are not compared.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None):
        self.percent = percent
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.labels = np.arange(len(sets)) if labels is None else labels.copy()
        _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Codes by rarity among these sets.
        rank = np.empty(len(df), dtype=np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        owner = np.repeat(np.arange(len(sets)), self.size)
        token = rank[code]
        self.token = np.sort(owner * len(df) + token) - owner * len(df)  # sets stay in their places
        self.owner = owner
        self.begin = np.cumsum(self.size) - self.size
        self.n_tokens = len(df)
        left = self.size[self.owner] - (np.arange(len(self.token)) - self.begin[self.owner])
        wide = -(-self.size * self._wide // 200)
        # Index lists hold the prefix for the wide threshold; in each, sets with most words left first.
        inside = np.flatnonzero(left >= wide[self.owner])
        inside = inside[np.lexsort((-left[inside], self.token[inside]))]
        self.index_token, self.index_set, self.index_left = self.token[inside], self.owner[inside], left[inside]
        self.lists = np.searchsorted(self.index_token, np.arange(self.n_tokens + 1))
        self.prefix = np.bincount(self.index_set, minlength=len(sets))

    @cached_property
    def _holders(self) -> tuple[np.ndarray, np.ndarray]:
        """Sets with each shingle, and where each shingle's begin."""
        by_token = np.argsort(self.token)
        return self.owner[by_token], np.searchsorted(self.token[by_token], np.arange(self.n_tokens + 1))

    @property
    def _near(self) -> int:  # of 200
        return 100 + self.percent

    @property
    def _wide(self) -> int:  # of 200
        return 3 * self.percent - 100

    def _reach(self, overlap: np.ndarray, total: np.ndarray, of_200: int) -> np.ndarray:
        """Whether sets of ``total`` shingles together have the similarity."""
        return overlap * (200 + of_200) >= of_200 * total

    def tokens(self, i: int) -> np.ndarray:
        return self.token[self.begin[i]:self.begin[i] + self.size[i]]

    def _candidates(self, i: int) -> np.ndarray:
        need = -(-int(self.size[i]) * self._wide // 200)
        parts = []
        for t in self.tokens(i)[:self.prefix[i]].tolist():
            a, b = self.lists[t], self.lists[t + 1]
            if b - a > 1:
                # The list's blocks are ordered by the words left at this position: those that cannot reach ``need`` are skipped whole.
                parts.append(self.index_set[a:a + np.searchsorted(-self.index_left[a:b], -need, side="right")])
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.int64)

    def _overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        mine = np.zeros(self.n_tokens, dtype=bool)
        mine[self.tokens(i)] = True
        sizes = self.size[others]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[others] - (ends - sizes), sizes)
        return np.add.reduceat(mine[self.token[at]].astype(np.int64), ends - sizes) if len(others) else np.empty(0, dtype=np.int64)

    def _link(self, i: int, others: np.ndarray) -> None:
        old = np.unique(self.labels[others])
        if len(old):
            old = np.append(old, self.labels[i])
            self.labels[np.isin(self.labels, old)] = old.min()

    def run(self) -> np.ndarray:
        """Labels after all links: equal for connected sets."""
        open_ = np.ones(len(self.size), dtype=bool)
        for z in np.argsort(self.size, kind="stable").tolist():
            if not open_[z]:
                continue
            open_[z] = False
            others = self._candidates(z)
            others = others[open_[others]]
            # Known to be connected with it, all of them: nothing to find here, nor for sets derived from it.
            if not (self.labels[others] != self.labels[z]).any():
                continue
            overlap = self._overlaps(z, others)
            total = self.size[others] + self.size[z]
            wide = self._reach(overlap, total, self._wide)
            others, overlap, total = others[wide], overlap[wide], total[wide]
            self._link(z, others[self._reach(overlap, total, 2 * self.percent)])
            for x in others[self._reach(overlap, total, self._near)].tolist():
                open_[x] = False
                self._derive(z, x, others, overlap, open_)
        return self.labels

    def _derive(self, z: int, x: int, others: np.ndarray, overlap: np.ndarray, open_: np.ndarray) -> None:
        """Links of ``x`` from the answers of ``z``: what links with ``x`` is within the wide threshold of ``z``."""
        look = open_[others] & (self.labels[others] != self.labels[x])
        others, overlap = others[look], overlap[look]
        if not len(others):
            return
        mine, base = self.tokens(x), self.tokens(z)
        gone, new = np.setdiff1d(base, mine, assume_unique=True), np.setdiff1d(mine, base, assume_unique=True)
        total = self.size[others] + self.size[x]
        sure = self._reach(overlap - len(gone), total, 2 * self.percent)
        self._link(x, others[sure])
        open_question = ~sure & self._reach(overlap + len(new), total, 2 * self.percent)
        others, overlap, total = others[open_question], overlap[open_question], total[open_question]
        if len(others):
            change = np.zeros(len(self.size), dtype=np.int64)
            holders, held = self._holders
            for sign, tokens in ((-1, gone), (1, new)):
                for t in tokens.tolist():
                    change[holders[held[t]:held[t + 1]]] += sign
            self._link(x, others[self._reach(overlap + change[others], total, 2 * self.percent)])


def packed_texts(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``doc_id, text`` with texts compressed, as they are dealt by id and then by leader: less than half of what is shuffled otherwise.

    Rows whose id is surely not among the ``doc_id`` of ``listed`` are left out; a join with it must follow.
    """
    table = bit_table(listed.select("doc_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.filter(pa.array(may_hold(table.value, batch.column(2).to_numpy())))
            for rows in row_slices(told, 1):
                texts = [None if t is None else zlib.compress(t, 1) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, type=pa.binary())], names=["doc_id", "text"])

    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text"), bit_place("doc_id").alias("place")), work, "doc_id bigint, text binary")


def _join_rows(rows: pd.DataFrame, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and, for each, the least id it is connected with here. ``known`` marks sets connected with the leader."""
    if not rows["member"].is_unique:
        rows = rows.sort_values(["member", "known"], ascending=[True, False], ignore_index=True).drop_duplicates(["member", "text"], ignore_index=True)
    sets: list[np.ndarray] = []
    packed = rows["text"].tolist()
    for part in text_blocks(packed, PACKED_BLOCK):
        sets += shingle_sets(hash_words([None if t is None else zlib.decompress(t) for t in packed[part]], SPACED), n)
    ids = rows["member"].to_numpy(dtype=np.int64)
    full = np.array([len(s) > 0 for s in sets], dtype=bool)
    ids, known, sets = ids[full], rows["known"].to_numpy(dtype=bool)[full], [s for s in sets if len(s)]
    if len(sets) < 2:
        return ids, ids
    # Rows of one id are one node.
    labels = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    labels[known] = labels[known].min() if known.any() else 0
    if len(sets) == 2:
        both, total = len(np.intersect1d(*sets, assume_unique=True)), len(sets[0]) + len(sets[1])
        labels = np.minimum(labels, labels.min()) if 100 * both >= percent * (total - both) else labels
    else:
        labels = SetJoin(sets, percent, labels).run()
    least = np.full(labels.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, labels, ids)
    return ids, least[labels]


def linkable_members(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rows`` (``leader, member`` and more) without members whose bitmaps rule out every link under their leader."""
    listed = sets.filter("n_shingles > 0").select("doc_id", "n_shingles", "digest", "bits")
    # Copies of a row with one id are one here, before anything is dealt by id.
    bitmaps = filter_rows(listed, bit_table(rows.select(F.col("member").alias("doc_id"))), "doc_id").groupBy("doc_id", "digest").agg(F.any_value("n_shingles").alias("n_shingles"), F.any_value("bits").alias("bits"))
    told = rows.select("leader", "member").hint("shuffle_hash").join(bitmaps.withColumnRenamed("doc_id", "member"), "member")
    sorted_ = told.select("leader", "member", "n_shingles", "bits").repartition("leader").sortWithinPartitions("leader")
    # A group may be told in several batches, a member of several sets more than once.
    kept = map_batches(sorted_, _linkable(percent), "leader bigint, member bigint").distinct()
    return rows.hint("shuffle_hash").join(kept, ["leader", "member"])


def set_links(docs: DataFrame, sets: DataFrame, attached: DataFrame, n: int, percent: int, group_sets: int) -> DataFrame:
    """``a, b``: links that connect whatever is connected among the sets under each leader.

    A leader of many sets is dealt out in chunks of about ``group_sets``, the
    leader with each. Sets that a chunk does not connect with the leader are
    then joined with every chunk; the others are connected already.
    """
    counts = attached.groupBy("leader").agg(F.count(F.lit(1)).alias("sets"))
    chunks = counts.select("leader", F.ceil(F.col("sets") / group_sets).cast("int").alias("chunks"))
    rows = attached.join(chunks, "leader").select("leader", "chunks", "member", F.pmod(F.xxhash64("member"), "chunks").cast("int").alias("chunk"))
    rows = rows.unionByName(chunks.select("leader", "chunks", F.col("leader").alias("member"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
    rows = stage(rows, "group-members")
    # Sets apart from a hot leader may link with those of any chunk: all of them go on.
    listed = stage(linkable_members(rows.filter("chunks = 1"), sets, percent).select(rows.columns).unionByName(rows.filter("chunks > 1")), "linkable-members")
    # The list of sets grows with the input: it is hashed where both sides are dealt by id, and never sent whole.
    texts = packed_texts(docs, listed.select(F.col("member").alias("doc_id"))).withColumnRenamed("doc_id", "member")
    members = stage(listed.hint("shuffle_hash").join(texts, "member"), "set-groups")

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        leader = int(rows["leader"].iloc[0])
        ids, least = _join_rows(rows.assign(known=rows["member"] == leader), n, percent)
        with_leader = least[ids == leader]
        out = pd.DataFrame({"leader": leader, "chunks": rows["chunks"].iloc[0], "a": ids, "b": least, "apart": least != (with_leader[0] if len(with_leader) else -1)})
        return out[(out["a"] != out["b"]) | (out["apart"] & (out["chunks"] > 1))].drop_duplicates()

    found = stage(members.groupBy("leader", "chunk").applyInPandas(first, "leader bigint, chunks int, a bigint, b bigint, apart boolean"), "set-links")
    apart = found.filter("apart and chunks > 1").select("leader", F.col("a").alias("member")).distinct()
    parts = apart.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / group_sets).cast("int").alias("parts"))
    large = members.filter("chunks > 1").join(parts, "leader")
    marked = large.join(apart.withColumn("apart", F.lit(True)), ["leader", "member"], "left").withColumn("known", F.col("apart").isNull())
    own = marked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = marked.filter("not known").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "member"), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["leader", "chunk", "part", "member", "text", "known"]

    def second(rows: pd.DataFrame) -> pd.DataFrame:
        ids, least = _join_rows(rows, n, percent)
        # Those known to be connected are so by links of the first pass.
        return pd.DataFrame({"a": ids, "b": least})[ids != least].drop_duplicates()

    across = own.select(columns).unionByName(sent.select(columns)).groupBy("leader", "chunk", "part").applyInPandas(second, "a bigint, b bigint")
    return found.select("a", "b").unionByName(across)


def first_rows(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``n_shingles, doc_id, prefix`` of the rows whose id is the first of a class of equal sets.

    A set that one row has stands for itself: prefixes are shuffled for repeated sets, and the few others that share a bit with one.
    """
    repeated = bit_table(classes.filter("rows > 1").select("digest"))
    rows = sets.filter("n_shingles > 0").select("digest", "n_shingles", "doc_id", "prefix")
    # The list of firsts grows with the input: it is never sent whole.
    firsts = classes.select(F.col("first").alias("doc_id")).distinct().hint("merge")
    asked = filter_rows(rows, repeated, "digest").join(firsts, "doc_id", "left_semi")
    return filter_rows(rows, repeated, "digest", held=False).unionByName(asked).drop("digest")


def named_rows(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, int]:
    """``doc_id, text`` and a bound: rows without an id get one of their own above it, so that links lead through them.

    Such numbers are written, with those rows only. Ids are expected below 2^62.
    """
    whole = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).alias("text"))
    top, unnamed = whole.agg(F.greatest(F.max("doc_id"), F.lit(0)), F.count_if(F.col("doc_id").isNull())).first()
    if unnamed:
        given = whole.filter("doc_id is null").withColumn("doc_id", F.lit(top) + 1 + F.monotonically_increasing_id())
        whole = whole.filter("doc_id is not null").unionByName(stage(given, "rows-without-id"))
    return whole, top


def jaccard_components(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id", group_sets: int = GROUP_SETS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two documents link when their sets of ``n``-word shingles have a Jaccard
    similarity of ``percent`` or more (35 to 100); ``component_id`` is the
    smallest id reachable by links. A text of fewer words has one shingle, all
    of it; a null text or one without words has none and links with nothing.
    Rows of one id are one document for links. A row with a null id is one by
    itself: links lead through it, and its own component is null.
    """
    whole, top = named_rows(docs, text, key)
    sets = stage(text_sets(whole, shingle_sketch(whole, n), n, percent, "text", "doc_id"), "shingle-sets")
    # Equal sets: one of them stands for all.
    classes = sets.filter("n_shingles > 0").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = stage(classes, "set-classes")
    postings = first_rows(sets, classes).select(F.explode("prefix").alias("token"), "n_shingles", "doc_id")
    ordered = postings.repartition("token").sortWithinPartitions("token", "n_shingles", "doc_id")
    attached = stage(map_batches(ordered, _attach(percent), "leader bigint, member bigint").distinct(), "set-pairs")
    links = set_links(whole, sets, attached, n, percent, group_sets)
    # Rows of one id with different sets hang together by the id.
    found = connected_components(links)
    resolved = classes.join(found, F.col("first") == F.col("node"), "left").select("digest", "n_shingles", F.coalesce("component", "first").alias("component"))
    return sets.select("doc_id", "n_shingles", "digest").join(resolved, ["digest", "n_shingles"], "left").select(
        F.when(F.col("doc_id") <= top, F.col("doc_id")).alias("doc_id"), "n_shingles", F.when(F.col("doc_id") <= top, F.least("component", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The row of the least id of each component, with all its columns; of rows of one id one stays. Rows without an id all stay."""
    found = stage(jaccard_components(docs, n, percent, text, key).filter("doc_id is not null"), "components")
    # Written, so that their size is known and texts are not shuffled for a short list.
    gone = stage(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "copies")
    repeated = stage(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id"), "repeated-ids")
    matches = named(key).cast("bigint") == F.col("_id")
    one_each = docs.join(repeated, matches, "left_semi").dropDuplicates([key])
    return docs.join(gone.unionByName(repeated), matches, "left_anti").unionByName(one_each)


def keep_one_row(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the least id, a null one last.

    Rows are told apart by themselves and not by their ids. Rows without words all stay.
    """
    numbered, row = numbered_rows(docs)
    before = len(staged_paths(docs.sparkSession))
    found = jaccard_components(numbered, n, percent, text, row).filter("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    found = stage(found.join(numbered.select(row, named(key).cast("bigint").alias("_id")), row), "components")
    rank = F.struct(F.col("_id").isNull().alias("no_id"), "_id", row)
    firsts = found.groupBy("component_id").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # Written, so that its size is known and texts are not shuffled for a short list.
    gone = stage(found.join(firsts, "component_id").filter(F.col(row) != F.col(f"first.{row}")).select(row), "copies")
    drop_staged(docs.sparkSession, before, -1)  # all that only this list was made of
    return numbered.join(gone, row, "left_anti").drop(row)
