import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import edge_documents, frame
from tokenizers import Tokenizer

from opinion_spark.llm.packing import OpenSequences, WordEncoder, pack_documents, pack_lengths
from opinion_spark.llm.queries import tokenizer_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def plain_ids(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()


def check(got, rows, capacity):
    want = []
    for i, t in rows:
        raw = plain_ids(t)
        for n, at in enumerate(range(0, len(raw), 4 * capacity)):
            part = raw[at:at + 4 * capacity]
            want.append((i, n, at // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in got) // capacity)


def test_edge_documents(spark):
    rows = edge_documents() + [(50, "<|endoftext|> it's <|startoftext|>"), (51, "don't WE'LL 12.5%  x́ İΑΣ"), (52, "tab\tand\rother\x0bblanks")]
    used, least = check(pack_documents(frame(spark, rows), tokenizer_path).collect(), rows, 2048)
    assert used <= least + 1


def test_small_capacity_and_many_blocks(spark):
    from opinion_spark.llm.packing import pack, token_pieces
    from opinion_spark.session import stage

    rows = [(i, "word " * (i % 23)) for i in range(300)]
    pieces = stage(token_pieces(frame(spark, rows), tokenizer_path, capacity=16), "pieces")
    used, least = check(pack(pieces, capacity=16, block_pieces=100).collect(), rows, 16)
    assert used <= 1.1 * least + 3


def test_empty_table(spark):
    assert pack_documents(frame(spark, []), tokenizer_path).collect() == []


def test_each_place_gives_the_least_sum_of_squares():
    rng = random.Random(5)
    packed, capacity = OpenSequences(20), 20
    gaps = []  # of open sequences, by the plain rule
    for item in range(400):
        size = rng.randint(1, 20)

        def total(open_gaps):
            return sum(open_gaps.count(g) ** 2 for g in set(open_gaps))

        options = [sorted([*gaps[:k], *gaps[k + 1:], *([g - size] if g > size else [])]) for k, g in enumerate(gaps) if g >= size]
        options.append(sorted([*gaps, *([capacity - size] if size < capacity else [])]))
        packed.place(item, size)
        gaps = sorted(g for g in range(1, capacity + 1) for _ in range(int(packed.count[g])))
        assert total(gaps) == min(map(total, options)) and gaps in options


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=60, deadline=None)
def test_every_item_is_in_one_sequence(sizes):
    packed = pack_lengths(sizes, 64)
    assert sorted(i for m in packed for i in m) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in m) <= 64 for m in packed)


@given(st.lists(st.text(max_size=40), max_size=20))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_tokenizer(texts):
    encoder = WordEncoder(PATH)
    got = encoder.encode(texts)
    assert got == [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_cache_may_run_full(monkeypatch):
    monkeypatch.setattr("opinion_spark.llm.packing.CACHED_WORDS", 10)
    encoder = WordEncoder(PATH)
    for text in ("Eins, zwei drei", "vier fünf sechs sieben acht neun zehn elf zwölf. dreizehn", "eins zwei", "Eins, vier"):
        assert encoder.encode([text, text])[1] == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_equal_rows_are_dealt_to_all_blocks(spark):
    from opinion_spark.llm.packing import pack
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(3).cast("bigint").alias("length"), F.lit(7).cast("bigint").alias("ids_crc32"))
    got = pack(rows, capacity=16, block_pieces=1000).withColumn("block", F.shiftright("sequence_id", 40)).groupBy("block").count().collect()
    assert len(got) == 20 and sum(r["count"] for r in got) == 20_000 and max(r["count"] for r in got) < 1200


def test_cache_keeps_the_words_met_last(monkeypatch):
    monkeypatch.setattr("opinion_spark.llm.packing.CACHED_WORDS", 100)
    encoder, rng = WordEncoder(PATH), random.Random(1)
    for _ in range(30):
        texts = [" ".join(f"{rng.choice(['wort', 'Wörter,', 'x1', chr(233)])}{rng.randrange(40)}" for _ in range(rng.randint(0, 80))) for _ in range(3)]
        assert encoder.encode(texts) == [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert len(encoder._hashes) == len(encoder._begin) == len(encoder._size) == len(encoder._met) < 400


class CountingTokenizer:
    """The tokenizer, with the characters that each call of it got."""

    def __init__(self):
        self.chars = []

    def encode_batch_fast(self, texts, add_special_tokens):
        self.chars.append(sum(map(len, texts)))
        return TOKENIZER.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_new_words_of_a_block_are_encoded_in_parts():
    encoder = WordEncoder(PATH)
    encoder._tokenizer = counting = CountingTokenizer()
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(f"{a}{b}{c}{end}" for a in letters for b in letters for c in letters for end in ("", "!", "7"))
    assert encoder.encode([text]) == [np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]
    assert max(counting.chars) < len(text) / 8


def test_cache_of_long_words_is_bounded(monkeypatch):
    monkeypatch.setattr("opinion_spark.llm.packing.CACHED_IDS", 500)
    encoder, rng = WordEncoder(PATH), random.Random(2)
    for _ in range(20):
        texts = ["".join(rng.choice("abcxyz0123456789é") for _ in range(200)) + " kurz wort"]
        assert encoder.encode(texts) == [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert len(encoder._pool) < 1000 and encoder._size.sum() == len(encoder._pool)


def test_arrow_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa
    from opinion_spark.llm.batches import BATCH_BYTES, map_batches
    from pyspark.sql import functions as F

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "n": [batch.num_rows]})

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    got = map_batches(texts, sizes, "bytes bigint, n bigint").collect()
    assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 2 * BATCH_BYTES
    spark.conf.set(limit, "1m")  # what a user has set stays
    assert max(r.bytes for r in map_batches(texts, sizes, "bytes bigint, n bigint").collect()) < BATCH_BYTES
    spark.conf.unset(limit)
