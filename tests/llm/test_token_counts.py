import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import edge_documents, frame
from sentencepiece import SentencePieceProcessor

from opinion_spark.llm.queries import piece_path
from opinion_spark.llm.token_counts import WORD_MARK, PieceCounter, count_tokens


def plain_count(word, pieces):
    """Longest match first, by trying every length."""
    total = at = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                total, at = total + 1, end
                break
        else:
            total, at = total + len(word[at].encode("utf-8", "replace")), at + 1
    return total


@given(st.sets(st.text(alphabet="abcé", min_size=1, max_size=5), max_size=12), st.lists(st.text(alphabet="abcdé", max_size=12), max_size=12))
@settings(max_examples=600, deadline=None)
def test_automaton_equals_longest_match(pieces, words):
    counter = PieceCounter(pieces)
    for word in words:
        assert counter.count(word) == plain_count(word, pieces)


def test_whole_vocabulary(spark):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    rows = [(i, t) for i, t in edge_documents() if t is None or len(t) < 20_000]
    got = {}
    for r in count_tokens(frame(spark, rows), piece_path).collect():
        got.setdefault(r.doc_id, (r.n_words, r.n_tokens))
    from llm_cases import SPACED
    for i, t in rows:
        words = SPACED.findall(t or "")
        assert got[i] == (len(words), sum(plain_count(WORD_MARK + w, pieces) for w in words))
    assert count_tokens(frame(spark, []), piece_path).collect() == []
