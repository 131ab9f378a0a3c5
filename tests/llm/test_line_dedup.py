import random

import pytest
from llm_cases import edge_documents, frame, prose

from opinion_spark.llm.line_dedup import MIN_WORDS, cut_spans, dedup_report, units_of


def cases():
    rng = random.Random(2)
    passage = ". ".join(prose(rng, 12).replace(".", "").replace(",", "") for _ in range(5)) + "."
    rows = edge_documents()
    for i in range(100, 120):
        before, after = prose(rng, 20), prose(rng, 20)
        rows.append((i, f"{before} {passage} {after}"))
    rows += [(200, "Short line.\nShort line.\n" * 3), (201, f"{passage.upper()}\n\n  {passage}")]
    return rows, passage


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_equals_plain_grouping(spark, unit):
    rows, _ = cases()
    rows = [r for r in rows if r[0] is not None and r != (6, rows[6][1])] + [(6, rows[6][1])]
    seen, want = {}, {}
    for i, t in sorted(rows):
        spans = []
        units = units_of(t, unit)
        for start, end, _, digest in units:
            if digest in seen:
                spans.append((start, end))
            seen.setdefault(digest, i)
        want[i] = (len(units), ",".join(f"{a}:{b}" for a, b in spans))
    got = {r.doc_id: r for r in dedup_report(frame(spark, rows), unit).collect()}
    assert {i: (r.n_units, r.removed) for i, r in got.items()} == want
    assert all(set(r.first_doc_ids) <= set(want) for r in got.values())


def test_repeated_rows_and_null_ids(spark):
    rows = edge_documents()
    got = dedup_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    six = sorted(r.n_removed for r in got if r.doc_id == 6)
    assert six[0] == 0 and six[1] > 0 and [r.n_removed > 0 for r in got if r.doc_id is None] == [True]
    assert dedup_report(frame(spark, [])).collect() == []


def test_passages_inside_paragraphs_are_found(spark):
    rows, passage = cases()
    docs = frame(spark, [r for r in rows if r[0] and r[0] >= 100])
    report = dedup_report(docs)
    texts = {r.doc_id: r for r in cut_spans(docs, report).collect()}
    original = dict(rows)
    removed = {r.doc_id: r for r in report.collect()}
    assert removed[100].n_removed == 0 and texts[100].text == original[100]
    for i in range(101, 120):
        assert removed[i].n_removed >= 4 and 100 in removed[i].first_doc_ids
        pieces = [tuple(map(int, s.split(":"))) for s in texts[i].kept.split(",")]
        assert "".join(original[i][a:b] for a, b in pieces) == texts[i].text


def test_units_keep_offsets_and_cover_lines():
    text = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen!\n\nshort. line\n"
    units = units_of(text)
    assert [text[a:b].strip() for a, b, *_ in units] == ["One two three four five six seven eight.", "Nine ten eleven twelve thirteen fourteen fifteen sixteen!"]
    assert units_of("ONE  two, three four\tfive six seven eight")[0][3] == units[0][3] and units_of(None) == [] and MIN_WORDS == 8


def test_whole_lines_of_any_length_and_merged_spans(spark):
    shouts = "A,!! SHHANT!! REAT.!! " * 20
    rows = [
        (1, f"{shouts}\nOk then.\n***\nunique to one\n\nShort one.\nAnd two."), (2, f"  {shouts}\nnew words\nOK, then\n***"), (3, shouts), (4, "short one and two"),
        (5, "Short\none. And\ntwo.\n\n---"), (6, "One two three four five six seven eight. Nine ten."), (7, "One two three four five six seven eight. Nine ten."),
        (8, "Before. One two three four five six seven eight. After"), (9, "alone\r\n\r\nlonely"), (10, "alone\nlonely\n \n"),
    ]
    docs = frame(spark, rows)
    report = dedup_report(docs)
    left = {r.doc_id: r.text for r in cut_spans(docs, report).collect()}
    text = dict(rows)
    assert {i: left[i] for i in (1, 6)} == {i: text[i] for i in (1, 6)}
    assert left[2].split() == ["new", "words"] and left[3] == "" and left[4] == "" and left[5].split() == ["---"] and left[7] == ""
    assert left[8] == "Before. After" and left[9] == text[9] and left[10].split() == []
    found = {r.doc_id: r for r in report.collect()}
    assert (found[7].n_removed, found[7].removed_words, found[7].removed) == (1, 10, f"0:{len(text[7])}")
    assert found[3].n_removed == 1 and found[3].removed_words == 60 and found[5].removed_words == 4
