from llm_cases import SPACED, edge_documents, frame

from opinion_spark.llm import quality


def plain(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(words) < 2000 else None
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated


def test_measures_equal_plain_rules(spark):
    rows = [(i, t) for i, t in edge_documents() if t is None or len(t) < 20_000]
    got = {}
    for r in quality.quality_report(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        words, chars, symbols, dup, repeated = plain(t)
        for r in got[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, dup, len(repeated))
            assert r.base_failed == (words < 50 or 100 * len(repeated) > 50 * words)
            assert not (r.base_failed and r.kept)


def test_order_changes_no_verdict():
    block = quality.Measured([t for _, t in edge_documents()])
    rules = quality.default_rules()
    assert quality.run_cascade(block, rules).tolist() == quality.run_cascade(block, rules[::-1]).tolist()
    every = [~rule.reject(block, __import__("numpy").arange(len(block.texts))) for rule in rules]
    assert quality.run_cascade(block, rules).tolist() == [all(v) for v in zip(*every, strict=True)]


def test_later_rules_see_survivors_only():
    seen = []

    def spy(block, rows):
        seen.extend(rows.tolist())
        return rows < 0

    block = quality.Measured(["word " * 60, "few words"])
    quality.run_cascade(block, [quality.too_few_words(), quality.Rule("spy", spy)])
    assert seen == [0]


def test_costly_rules_that_reject_little_go_last(spark):
    import time

    slow = quality.Rule("slow", lambda b, rows: (time.sleep(0.05), rows < 0)[1])
    ordered = quality.order_rules(frame(spark, edge_documents()), [slow, quality.too_few_words()])
    assert [r.name for r in ordered] == ["too_few_words", "slow"]


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = frame(spark, edge_documents())
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 in ids and 1 not in ids and 45 not in ids and 46 not in ids
    assert quality.filter_quality(frame(spark, [])).collect() == [] and quality.quality_report(frame(spark, [])).collect() == []
