import random

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from rolloom.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not T.installed(), reason="no vocabulary file here")

EDGES = ["", " ", "\n", "a", "'", "'s", "it's", "''s", " 's", "'re", "'r", "'rx", "'ll", "'l", "'lx", "'ve've", "a\n\n b", "a  b", "a \t", "12ab", "<|endoftext|>", "é́", "\U0001f600\U0001f600", "x  y", "\x1c\x1d", "'ſ", "日本語 text", "a" * 3000, " " * 500 + "z", "\U0010ffff a", "-'d", "9's"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(T.VOCABULARY)
    library.encode_special_tokens = True
    return T.Encoder(), library


def ids_of(encoder, texts):
    ids, at = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_against_the_library(both):
    encoder, library = both
    rng = random.Random(1)
    letters = "aste'rlvmd 1\n\t  .,'’éßЖ中٣½Ⅷ\U0001f600  _S"
    texts = EDGES + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(encoder, texts) == want
    assert ids_of(encoder, texts[:40]) == want[:40]


def test_round_trip_and_spans(both):
    encoder, _ = both
    for text in EDGES:
        ids = ids_of(encoder, [text])[0]
        assert encoder.decode(ids) == text
        spans = encoder.spans(text)
        assert [text.encode()[a:b] for a, b in spans] == [encoder.bytes_of[i] for i in ids]


def test_scan_is_the_automaton_stepped(both):
    scanner = both[0].scanner
    step, _ = T._automaton()
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 11, 5000).astype(np.uint8)
    states, s = [], T.START
    for k in kinds:
        states.append(s)
        s = step[s, k]
    assert (scanner.from_start[scanner.prefixes(scanner.of_class[kinds])] == states).all()


def test_nulls_and_small_caches(both):
    encoder = T.Encoder(most=10)
    assert ids_of(encoder, [None, "", "a b c d e f g h i j k l", None]) == [[], [], *ids_of(both[0], ["a b c d e f g h i j k l"]), []]
    assert ids_of(encoder, []) == []


def test_table(spark):
    df = spark.createDataFrame([(1, "it's", 5), (2, None, 6), (3, "", 7), (1, "it's", 5)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in T.encode_table(df).collect())
    assert got == [(1, [270, 338]), (1, [270, 338]), (2, []), (3, [])]
    assert T.encode_table(df.where("false")).collect() == []
