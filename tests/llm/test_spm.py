import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.common import tokenizer_file
from millrace.llm.spm import encode_decode, encoder

MODEL = tokenizer_file("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
FIXED = ["", " ", "  ", "a", " a", "a ", "the  cat   sat\n\n on\tit", "▁▁ x▁y", "日本語 текст", "\x00\x01", "ééé", "<s> </s> <unk> <0x0A>", "aaaaaaaaaaaaaaaa" * 9, " " * 77 + "x" + " " * 31, "1234567890.00", "x" * 3000]


@pytest.mark.parametrize("text", FIXED)
def test_ids_equal_the_library(text):
    assert encoder(MODEL).encode(text) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("  \n\tabcdetheinr▁éß0123.,")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(text):
    assert encoder(MODEL).encode(text) == LIBRARY.encode(text)


def test_long_random_words():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcdeinorst ") for _ in range(rng.randrange(200)))
        assert encoder(MODEL).encode(text) == LIBRARY.encode(text)


def test_operator_handles_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "the cat", "x"), (1, "the cat", "y"), (2, None, None), (3, "", "z"), (None, "a  b", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_decode(df, MODEL, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == 5
    for (key, text, _), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, r.decoded))), strict=True):
        want = LIBRARY.encode(text or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded == LIBRARY.decode(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(df, MODEL).collect() == []
