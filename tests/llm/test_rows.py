"""Rows told apart by themselves: null and repeated ids, clashing names, and texts that once took quadratic time."""

import random
import re
import time

import pytest
from llm_cases import components, edge_documents, frame, prose

from opinion_spark.llm import batches, decontamination, jaccard, line_dedup, pii

OLD_SENTENCES = re.compile(r"[^\n]+?(?:[.!?]+(?=[ \t])[ \t]*|$)", re.M)


def plain_units(text, min_words=line_dedup.MIN_WORDS):
    """Units of any kind as (start, end, normal text), found line by line."""
    out, at, block = [], 0, []

    def normal(part):
        return " ".join(re.findall(r"\w+", part.lower()) or part.split())

    def close():
        real = [b for b in block if re.search(r"\w", text[b[0]:b[1]])]
        if len(real) > 1:
            out.append((real[0][0], real[-1][1], " ".join(normal(text[a:b]) for a, b in real)))
        block.clear()

    for line in (text or "").split("\n"):
        if line.strip():
            block.append((at, at + len(line)))
            out.append((at, at + len(line), normal(line)))
            whole = re.findall(r"\w+", line)
            for m in OLD_SENTENCES.finditer(line):
                if min_words <= len(re.findall(r"\w+", m.group())) < len(whole):
                    out.append((at + m.start(), at + m.end(), normal(m.group())))
        else:
            close()
        at += len(line) + 1
    close()
    return out


def plain_removal(rows):
    """Texts without the units that an earlier (id, offset) has, units inside removed ones left out."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first, out = {}, {}
    for k in order:
        for start, _, normal in sorted(plain_units(rows[k][1])):
            first.setdefault(normal, (k, start))
    for k, (_, text) in enumerate(rows):
        gone = {p for a, b, normal in plain_units(text) if first[normal] != (k, a) for p in range(a, b)}
        out[k] = None if text is None else "".join(c for p, c in enumerate(text) if p not in gone)
    return out


def documents():
    rng = random.Random(11)
    lines = [prose(rng, rng.randint(1, 12)) for _ in range(25)] + ["***", "OK.", "One two three four five six seven eight nine. And ten."]
    rows = [(i, "\n".join(rng.choice([*lines, "", " "]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (None, rows[3][1] + "\nonly without an id")]


def test_any_unit_equals_plain_version(spark):
    rows = documents()
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {rows[k][0]: text for k, text in plain_removal(rows).items()}


def test_removal_is_by_row(spark):
    line = "a line of text that is there more than once in this table"
    rows = [(None, f"{line}\nfirst"), (None, f"{line}\nsecond"), (7, f"{line}\nthird"), (7, f"{line}\nfourth"), (7, "fifth")]
    got = sorted(((r.doc_id, r.text.strip()) for r in line_dedup.remove_repeats(frame(spark, rows)).collect()), key=repr)
    assert len(got) == 5 and {t.split("\n")[-1] for _, t in got} == {"first", "second", "third", "fourth", "fifth"}
    kept = [(i, t) for i, t in got if line in t]
    assert len(kept) == 1 and kept[0][0] == 7  # one of the rows of the least id


def test_sentences_as_before():
    rng = random.Random(5)
    for _ in range(3000):
        line = "".join(rng.choice("ab.!? \t") for _ in range(rng.randint(0, 14)))
        assert list(line_dedup.sentences(line)) == [m.span() for m in OLD_SENTENCES.finditer(line)], line


@pytest.mark.parametrize("text", ["!" * 1_000_000, "a! " * 300_000, ". " * 500_000, "x.y" * 300_000, " \t" * 500_000])
def test_units_of_long_texts(text):
    start = time.perf_counter()
    line_dedup.units_of(text, "any")
    line_dedup.units_of(text, "sentence")
    assert time.perf_counter() - start < 10


def test_many_spans_of_personal_data():
    text = "mail a@b.example or call 555 123 4567, " * 20_000
    start = time.perf_counter()
    found = pii.scored_spans(text)
    assert time.perf_counter() - start < 20 and sum(s[2] == "email" for s in found) == 20_000
    # A further span that touches a base one is dropped, also where base spans nest.
    assert {s[2] for s in pii.scored_spans("tel +49 555 123 4567 tel")} == {"phone"}


def test_links_lead_through_rows_without_id(spark):
    rng = random.Random(3)
    words = prose(rng, 200).replace(",", "").replace(".", "").split()
    step = [" ".join([*words[:200 - k], *(f"new{j}" for j in range(k))]) for k in (0, 16, 32)]
    rows = [(5, step[0]), (None, step[1]), (3, step[2]), (None, "alone without an id " * 3)]
    assert components([(i, t) for i, t in rows if i]) == {5: 5, 3: 3}
    got = jaccard.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {5: 3, 3: 3}
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def test_components_with_all_ids_null_or_negative(spark):
    text = prose(random.Random(4), 40)
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(frame(spark, [(None, text), (None, text)])).collect()} == {(None, None)}
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(frame(spark, [(-9, text), (-2, text), (None, text)])).collect()} == {(-9, -9), (-2, -9), (None, None)}


def test_clashing_row_number(spark):
    docs = frame(spark, edge_documents()[:12]).withColumnRenamed("place", "_ROW_number")
    numbered, name = batches.numbered_rows(docs)
    assert name == "_row_number_" and numbered.columns == [*docs.columns, name]
    kept = jaccard.keep_one_row(docs)
    assert kept.columns == docs.columns and {r["_ROW_number"] for r in kept.collect()} == {2}
    items = spark.createDataFrame([(1, "four words only here")], "item_id bigint, text string")
    clean = decontamination.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and 5 not in {r.doc_id for r in clean.collect()}
