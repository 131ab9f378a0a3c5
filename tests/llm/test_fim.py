"""Fill-in-middle against regular expressions and slices; the wavelet matrix against plain counting."""

import hashlib
import random
import re

import numpy as np
import pytest

from llm_cases import edge_documents, frame

from opinion_spark.llm.fim import MARKERS, check_markers, fill_in_middle, restore_text
from opinion_spark.llm.wavelet import WaveletMatrix

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+"}


def plain(doc, text, unit, fim=100, spm=50):
    t = text or ""
    units = re.findall(UNITS[unit], t)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    p, s, m = MARKERS
    if not t or any(x in t for x in MARKERS) or h3 % 100 >= fim:
        return doc, len(units), "plain", None, None, t
    if h4 % 100 < spm:
        return doc, len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc, len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def documents():
    rng = random.Random(3)
    rows = edge_documents(rng)
    rows += [(50, "no break"), (51, "\n"), (52, "\n\n\n"), (53, "a\nb"), (54, "a\nb\n"), (55, "has <M> in\nit"), (56, "<P\n>S>\n<"), (57, "é\nü\U0001f600\n\nß x. y! z"), (None, "a\nb\nc"), (None, None)]
    return rows + [(i, "".join(rng.choice("ab é\U0001f600\n.! \t") for _ in range(rng.randint(0, 300)))) for i in range(60, 160)]


@pytest.mark.parametrize("unit", list(UNITS))
def test_outputs_equal_plain_version(spark, unit):
    rows = documents()
    got = sorted((tuple(r) for r in fill_in_middle(frame(spark, rows), unit).collect()), key=repr)
    assert got == sorted((plain(d, t, unit) for d, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_shares(spark):
    rows = [(i, f"{i}\n{i + 1}\n") for i in range(500)]
    got = sorted(tuple(r) for r in fill_in_middle(frame(spark, rows), "line", fim_percent=30, spm_percent=10).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())
    assert got == [plain(d, t, "line", 30, 10) for d, t in rows]


def test_digests_and_restored_text(spark):
    rows = documents()
    outputs = {(r.doc_id, r.output): r for r in fill_in_middle(frame(spark, rows), "line").collect()}
    for r in outputs.values():
        assert (r.doc_id, restore_text(r.output.encode(), r.form, check_markers(MARKERS)).decode()) in {(d, t or "") for d, t in rows}
    got = sorted((r.output_sha256, r.restored_sha256) for r in fill_in_middle(frame(spark, rows), "line", digests=True).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted((sha(plain(d, t, "line")[5]), sha(t or "")) for d, t in rows)


def test_empty_table_and_markers(spark):
    assert fill_in_middle(frame(spark, documents()).limit(0)).collect() == []
    assert check_markers(["<prefix>", "<suffix>", "<mid>"])
    for markers in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("<P>", "", "<M>"), ("ab", "bc", "x"), ("xab", "ab", "c")):
        with pytest.raises(ValueError):
            check_markers(markers)
    with pytest.raises(ValueError):
        fill_in_middle(frame(spark, documents()), "page")


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 5000])
def test_wavelet_matrix_counts(size):
    rng = np.random.default_rng(size)
    codes = rng.integers(0, 5, size).astype(np.uint8)
    matrix = WaveletMatrix(codes, 3)
    places = np.arange(size + 1)
    for code in range(8):
        ranks = np.concatenate(([0], np.cumsum(codes == code)))
        assert (matrix.rank(code, places) == ranks).all()
        assert (matrix.select(code, np.arange(ranks[-1])) == np.flatnonzero(codes == code)).all()
    several = np.flatnonzero(np.isin(codes, [1, 3]))
    assert (matrix.bisect([1, 3], np.arange(len(several))) == several).all()


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    from opinion_spark.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(ORACLE["op13_fim"])
    df = QUERIES["op13_fim"](spark, sf_dir)
    assert df.columns == [d[0] for d in cursor.description]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
