"""Benchmark passages in training documents, by a positional inverted index.

The index is partitioned by documents: a row holds the postings of some
megabytes of text, as sorted terms and the positions of each. Queries (the
windows of the benchmark items) go in blocks of bounded size to every row, which
answers by itself: the list of a window's rarest term there, shifted by the
term's place in the window, is intersected with the other terms' lists in order
of rarity. Nothing is shuffled but the matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import free_name, map_batches, map_blocks, row_slices
from opinion_spark.llm.wordhash import ALPHANUMERIC, hash_words
from opinion_spark.session import drop_staged, stage, staged_paths

WINDOW = 10
#: Characters of text in an index row.
ROW_CHARS = 1 << 21
#: Windows that are sent to the index at a time: about 100 bytes each.
BLOCK_WINDOWS = 100_000
#: Candidate places worked on at a time.
_CANDIDATES = 1 << 20
#: Empty places between documents; a match of any kind must be shorter.
GAP = 256

#: {}: the type of keys.
INDEX_SCHEMA = "shard bigint, doc_id array<{}>, n_words array<int>, terms binary, starts binary, positions binary"
MATCH_SCHEMA = "shard bigint, ordinal int, item_id bigint, kind string, start int, end int"


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", row_chars: int = ROW_CHARS, key_type: str = "bigint") -> DataFrame:
    """Store the postings of every word of every text.

    Documents are told apart by ``shard`` and their place in ``doc_id``, so null
    and repeated keys are documents like all others. A null text has no words.
    """
    schema = StructType.fromDDL(INDEX_SCHEMA.format(key_type))
    arrow = to_arrow_schema(schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for rows in row_slices(batch, 1, row_chars):
                words = hash_words(rows.column(1).to_pylist(), ALPHANUMERIC)
                counts = np.diff(words.starts)
                place = np.arange(len(words.hashes)) + np.repeat(np.arange(len(counts)) * GAP, counts)
                order = np.argsort(words.hashes, kind="stable")
                terms, starts = np.unique(words.hashes[order], return_index=True)
                shard = (TaskContext.get().partitionId() << 32) + made
                made += 1
                row = {
                    "shard": [shard], "doc_id": [rows.column(0).to_pylist()], "n_words": [counts.tolist()], "terms": [terms.tobytes()],
                    "starts": [np.append(starts, len(order)).astype("<u4").tobytes()], "positions": [place[order].astype("<u4").tobytes()],
                }
                yield pa.RecordBatch.from_pydict(row, schema=arrow)

    source = docs.select(named(key).cast(key_type).alias("doc_id"), named(text).alias("text"))
    return stage(map_batches(source, index, schema), "positional-index")


def indexed_documents(index: DataFrame) -> DataFrame:
    """``shard, ordinal, doc_id, n_words`` of every document in the index."""
    return index.select("shard", F.posexplode(F.arrays_zip("doc_id", "n_words")).alias("ordinal", "d")).select("shard", "ordinal", "d.doc_id", "d.n_words")


def item_windows(items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """``item_id, terms binary`` of all windows of ``window`` consecutive words; an item of fewer words is one window."""
    def run(c: dict[str, list]) -> dict[str, list]:
        words = hash_words(c["text"], ALPHANUMERIC)
        ids, terms = [], []
        for i, item in enumerate(c["item_id"]):
            own = words.of(i)
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if size else 0):
                ids.append(item)
                terms.append(own[k:k + size].tobytes())
        return {"item_id": ids, "terms": terms}

    source = items.select(named(key).cast("bigint").alias("item_id"), named(text).alias("text"))
    return map_blocks(source, run, "item_id bigint, terms binary")


class _Queries:
    """Windows of one block, by their number of words."""

    def __init__(self, rows: list):
        self.items = [r.item_id for r in rows]
        hashes = np.frombuffer(b"".join(r.terms for r in rows), dtype="<u8")
        sizes = np.array([len(r.terms) // 8 for r in rows], dtype=np.int64)
        self.terms, code = np.unique(hashes, return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        self.groups = []
        for size in np.unique(sizes).tolist():
            rows_of = np.flatnonzero(sizes == size)
            self.groups.append((rows_of, code[begin[rows_of][:, None] + np.arange(size)].astype(np.int32)))


class _Postings:
    """One row of the index, ready for queries."""

    def __init__(self, terms: bytes, starts: bytes, positions: bytes, n_words: list[int]):
        self.terms = np.frombuffer(terms, dtype="<u8")
        self.starts = np.frombuffer(starts, dtype="<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, dtype="<u4").astype(np.int64)
        self.keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) << 32) | self.positions
        counts = np.asarray(n_words, dtype=np.int64)
        self.first = np.cumsum(counts) - counts + np.arange(len(counts)) * GAP

    def locate(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each term in this row's list, and how often it occurs here."""
        if not len(self.terms):
            return np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, self.starts[at + 1] - self.starts[at], 0)

    def rarest_first(self, windows: np.ndarray, at: np.ndarray, df: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows all of whose terms occur here, with the order of their terms by rarity and the rarest one's positions."""
        alive = np.flatnonzero((df[windows] > 0).all(axis=1))
        if not len(alive):
            return
        order = np.argsort(df[windows[alive]], axis=1, kind="stable")
        rare = windows[alive, order[:, 0]]
        total = np.cumsum(df[rare])
        cut = 0
        while cut < len(alive):
            end = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + _CANDIDATES)))
            some = np.arange(cut, min(end, len(alive)))
            times = df[rare[some]]
            which = np.repeat(some, times)
            into = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            yield alive[which], order[which], self.positions[self.starts[at[rare[which]]] + into]
            cut = end

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | position
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[found] == key) & (position >= 0)

    def phrases(self, windows: np.ndarray, at: np.ndarray, df: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window numbers and first positions of exact occurrences."""
        for which, order, position in self.rarest_first(windows, at, df):
            start = position - order[:, 0]
            for k in range(1, windows.shape[1]):
                column = order[:, k]
                hit = self.has(at[windows[which, column]], start + column)
                which, order, start = which[hit], order[hit], start[hit]
            yield which, start

    def near(self, windows: np.ndarray, at: np.ndarray, df: np.ndarray, span: int) -> Iterator[tuple[int, int, int]]:
        """Window number, first and last position of each shortest stretch, of at most ``span`` words, with all terms of a window in any order."""
        for which, order, position in self.rarest_first(windows, at, df):
            for k in range(1, windows.shape[1]):
                term = at[windows[which, order[:, k]]]
                after = np.minimum(np.searchsorted(self.keys, (term << 32) | np.maximum(position - span + 1, 0)), len(self.keys) - 1)
                hit = (self.keys[after] >> 32 == term) & ((self.keys[after] & 0xFFFFFFFF) < position + span)
                which, order, position = which[hit], order[hit], position[hit]
            for w, p in zip(which.tolist(), position.tolist(), strict=True):
                stretch = self._shortest(np.unique(at[windows[w]]), p, span)
                if stretch:
                    yield w, *stretch

    def _shortest(self, terms: np.ndarray, position: int, span: int) -> tuple[int, int] | None:
        places = []
        for t in terms.tolist():
            a, b = np.searchsorted(self.keys, [(t << 32) | max(position - span + 1, 0), (t << 32) | (position + span)])
            places += [(int(self.keys[i]) & 0xFFFFFFFF, t) for i in range(a, b)]
        best, last = None, {}
        for p, t in sorted(places):
            last[t] = p
            if len(last) == len(terms):
                first = min(last.values())
                if first <= position <= p and p - first < span and (best is None or p - first < best[1] - best[0]):
                    best = (first, p)
        return best


def search(index: DataFrame, windows: DataFrame, slop: int | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Occurrences of windows: ``shard, ordinal, item_id, kind, start, end`` in words of the document, the end exclusive.

    ``kind`` is ``phrase`` for exact occurrences; touching ones of one item are
    one row. With ``slop`` also ``proximity``: the shortest stretch around a
    window's rarest term that has all its terms in any order and is at most
    ``slop`` words longer than the window; exact occurrences are among them.
    Windows are sent in blocks of ``block_windows``; all are searched.
    """
    spark = index.sparkSession
    arrow = to_arrow_schema(StructType.fromDDL(MATCH_SCHEMA))
    written = stage(windows, "windows")
    blocks = max(1, -(-written.count() // block_windows))
    numbered = written.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        sent = spark.sparkContext.broadcast(_Queries(numbered.filter(F.col("block") == b).collect()))

        def answer(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = sent.value
            for batch in batches:
                for n in range(batch.num_rows):  # one at a time: rows are megabytes
                    made = _matches(queries, batch.slice(n, 1).to_pylist()[0], slop)
                    if made["shard"]:
                        yield pa.RecordBatch.from_pydict(made, schema=arrow)

        part = map_batches(index.select("shard", "n_words", "terms", "starts", "positions"), answer, MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def _matches(queries: _Queries, row: dict, slop: int | None) -> dict[str, list]:
    out: dict[str, list] = {"shard": [], "ordinal": [], "item_id": [], "kind": [], "start": [], "end": []}
    postings = _Postings(row["terms"], row["starts"], row["positions"], row["n_words"])
    at, df = postings.locate(queries.terms)

    def add(kind: str, window: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        ordinal = np.searchsorted(postings.first, first, side="right") - 1
        seen: dict[tuple, list[int]] = {}
        for w, o, a, b in sorted(zip(window.tolist(), ordinal.tolist(), first.tolist(), end.tolist(), strict=True), key=lambda m: (m[1], m[2], m[3])):
            key = (o, queries.items[w])
            base = int(postings.first[o])
            last = seen.get(key)
            if last is not None and kind == "phrase" and a - base <= last[1]:
                last[1] = max(last[1], b - base)
                continue
            if last is not None:
                _put(out, row["shard"], key, kind, last)
            seen[key] = [a - base, b - base]
        for key, last in seen.items():
            _put(out, row["shard"], key, kind, last)

    for rows, windows in queries.groups:
        size = windows.shape[1]
        for which, start in postings.phrases(windows, at, df):
            add("phrase", rows[which], start, start + size)
        if slop is not None:
            if size + slop > GAP:
                raise ValueError(f"a proximity match can span at most {GAP} words")
            near = sorted({(int(rows[w]), a, b + 1) for w, a, b in postings.near(windows, at, df, size + slop)})
            if near:
                add("proximity", *(np.array(x) for x in zip(*near, strict=True)))
    return out


def _put(out: dict[str, list], shard: int, key: tuple, kind: str, stretch: list[int]) -> None:
    for name, value in zip(out, (shard, key[0], key[1], kind, *stretch), strict=True):
        out[name].append(value)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document.

    A word inside any exact occurrence of an item's window is hit. Items without
    an id count in hits, not among the items. Texts without words, null ones
    among them, have no hits; an empty benchmark contaminates nothing.
    """
    index = build_index(docs, key=key, key_type=key_type)
    hits = search(index, item_windows(items, window))
    # A document's stretches from left to right: each adds what the ones before it have not covered.
    before = Window.partitionBy("shard", "ordinal").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.col("start"))), F.lit(0))
    found = hits.withColumn("covered", covered).groupBy("shard", "ordinal").agg(
        F.sum("covered").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    return indexed_documents(index).join(found, ["shard", "ordinal"], "left").select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns. Each row is judged by its own text, whatever its id.

    Equal texts have one verdict, so that texts are told apart by 128 bits of their SHA-256 and no row needs a number that has to be written.
    """
    spark, digest = docs.sparkSession, free_name(docs, "_text_digest")
    before = len(staged_paths(spark))
    text_digest = F.substring(F.unhex(F.sha2(named("text").cast("binary"), 256)), 1, 16)
    judged = contamination(docs.select(text_digest.alias("doc_id"), named("text").alias("text")), items, window, key_type="binary")
    # Written, so that its size is known and texts are not shuffled for a short list.
    bad = stage(judged.filter("contaminated").select(F.col("doc_id").alias(digest)).distinct(), "contaminated")
    drop_staged(spark, before, -1)  # the index and its queries
    return docs.join(bad, text_digest == F.col(digest), "left_anti")
