"""Small documents with every awkward case, and plain versions of the rules that operators follow."""

import random
import re
import string

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, kept boolean, n_words bigint, token string, "
    "block int, leader bigint, spans string, place bigint, _h bigint, sequence_id bigint"
)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def spaced(text):
    return SPACED.findall(lower(text))


def prose(rng, n):
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(60)]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def edge_documents(rng=None):
    """(doc_id, text) rows: nulls, empty and blank texts, repeated rows and ids, near copies, one very long text."""
    rng = rng or random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    rows = [(None, base), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "One"), (5, "four words only here"), (6, base), (6, base), (7, base.upper())]
    for i in range(8, 16):  # near copies
        copy = list(words)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = f"changed{rng.randrange(1000)}"
        rows.append((i, " ".join(copy)))
    rows += [(i, prose(rng, rng.randint(20, 90))) for i in range(16, 40)]
    rows += [(40, prose(rng, 30_000)), (41, "x" * 50_000), (42, "é ü ñ   \U0001f600 Straße line"), (43, "a b\nc d\na b\n\n a b"), (44, "\x00\x01 \x85nul")]
    rows += [(45, "same words " * 60), (46, "#|* $%& <>" * 20), (47, " ".join(words[:100]))]
    return rows


def frame(spark, rows):
    """A table of documents with columns whose names operators might use themselves."""
    full = [(i, t, None, None if n % 5 == 0 else f"src{n % 3}", None, 1, None, 3, "t", 0, 9, "s", 2, 5, 6) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def shingles(text, n=5):
    words = spaced(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def components(rows, percent=80):
    """doc_id -> least id reachable, by comparing all pairs; rows of one id are one document."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i in parent}
