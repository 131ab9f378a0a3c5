import hashlib
import random

import pytest
from llm_cases import PLAIN, edge_documents, frame, lower, prose

from opinion_spark.llm import decontamination as dc


def words(text):
    return PLAIN.findall(lower(text))


def plain(rows, items, window=10):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            q = words(text)
            size = min(window, len(q))
            grams = {tuple(q[k:k + size]) for k in range(len(q) - size + 1)} if q else set()
            for k in range(len(w) - size + 1) if q else ():
                if tuple(w[k:k + size]) in grams:
                    hit.update(range(k, k + size))
                    found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(11)
    items = [(1, prose(rng, 40)), (2, prose(rng, 12)), (2, prose(rng, 12)), (3, "three words only"), (4, None), (5, " ,. "), (None, prose(rng, 15)), (10, prose(rng, 25)), (1, prose(rng, 30))]
    texts = [t for _, t in items if t and words(t)]
    rows = [(i, t) for i, t in edge_documents() if i != 40]
    for i in range(100, 140):
        text = prose(rng, rng.randint(0, 30)).split()
        for passage in rng.sample(texts, 2):
            at = passage.split()
            a = rng.randint(0, max(0, len(at) - 11))
            text += at[a:a + rng.randint(5, 20)] + prose(rng, 5).split()
        rows.append((i, " ".join(text).upper() if i % 2 else " - ".join(text)))
    rows += [(200, texts[0] * 3), (201, "Three, words (only)!"), (200, texts[0])]
    return rows, items


@pytest.mark.parametrize("block_windows,row_chars", [(100_000, 1 << 22), (7, 300)])
def test_equals_plain_search(spark, block_windows, row_chars, monkeypatch):
    monkeypatch.setattr(dc.build_index, "__defaults__", (*dc.build_index.__defaults__[:-1], row_chars))
    monkeypatch.setattr(dc.search, "__defaults__", (None, block_windows))
    rows, items = cases()
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, shard int")
    got = sorted((tuple(r) for r in dc.contamination(frame(spark, rows), benchmark).collect()), key=repr)
    assert got == plain(rows, items)


def test_drop_and_empty_tables(spark):
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, rows)
    left = dc.drop_contaminated(docs, benchmark)
    bad = {i for i, *_, c in plain(rows, items) if c}
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((i for i, _ in rows if i not in bad), key=repr)
    assert dc.contamination(frame(spark, []), benchmark).collect() == []
    none = dc.contamination(docs, benchmark.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x x alpha y beta gamma x"), (2, "gamma beta alpha"), (3, "alpha y y y beta y y gamma"), (4, "alpha beta"), (5, "alpha beta gamma")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id bigint, text string")
    index = dc.build_index(docs)
    found = dc.search(index, dc.item_windows(items), slop=1).join(dc.indexed_documents(index), ["shard", "ordinal"])
    assert {(r.doc_id, r.kind, r.start, r.end) for r in found.collect()} == {(1, "proximity", 2, 6), (2, "proximity", 0, 3), (5, "phrase", 0, 3), (5, "proximity", 0, 3)}
