import os
import random

import pyarrow as pa
import pytest

from newslake.llm import sentencepiece_codec as S

MODEL = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")
TEXTS = ["Hello world", "", " a  b   c\n\nnew line\ttab", "日本語 テキスト 😀 emoji", "Ñandú çédille " + "x" * 300 + " yyyy", "   ", "​ zero", "a" * 70, "\n", "ÀÉ́ mixed\r\nends "]


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.load(MODEL)


def texts():
    rng = random.Random(2)
    return TEXTS + ["".join(rng.choice("abcdefghij  .,\n_-é中") for _ in range(rng.randrange(120))) for _ in range(200)]


def test_ids_are_those_of_the_library_in_its_unigram_mode(vocabulary):
    import sentencepiece
    raw = bytearray(open(MODEL, "rb").read())
    raw[raw.rfind(b"\x18\x02") + 1] = 1  # model_type of the trainer's settings: unigram
    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(bytes(raw))
    got = S.encode_column(vocabulary, pa.array(texts())).to_pylist()
    assert got == [sp.encode(t) for t in texts()]


def test_round_trip(vocabulary):
    every = texts() + ["▁ literal ▁▁ mark", None, "x" * 100_000, "word " * 20_000]
    for column in (pa.array(every), pa.array(every, pa.large_string()), pa.array(["pad"] + every)[1:]):
        ids = S.encode_column(vocabulary, column)
        assert S.decode_column(vocabulary, ids).to_pylist() == every
    assert S.decode_column(vocabulary, pa.array([[0, 259], [], None], pa.list_(pa.int32()))).to_pylist()[1:] == ["", None]


def test_long_parts_agree_with_short_ones(vocabulary):
    rng = random.Random(4)
    for _ in range(20):
        part = pa.array(["".join(rng.choice("abcdeéx") for _ in range(60))])
        together = S.encode_column(vocabulary, part)
        S.TOGETHER, kept = 0, S.TOGETHER
        try:
            assert S.encode_column(vocabulary, part) == together
        finally:
            S.TOGETHER = kept


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS + [None])], "doc_id long, text string, source string").repartition(3)
    out = S.encode(df, MODEL, check="ok")
    assert out.columns == ["doc_id", "text", "source", "token_ids", "ok"] and all(r["ok"] for r in out.collect())
    back = S.decode(out.drop("text", "ok"), MODEL)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(TEXTS + [None]))
    assert S.encode(df.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        S.encode(df.withColumnRenamed("source", "token_ids"), MODEL)
