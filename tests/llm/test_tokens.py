import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyframe.llm.encoding import Encoder
from tallyframe.llm.orc_tokens import tokens_through_orc
from tallyframe.llm.token_counts import Counter, count_tokens

ODD = ["", " ", "  a", "a ", "a  b", "a\nb", "a\n\nb c", "a \nb", "a\n b", "\n", "\n\nx", "x\n\n", "naïve Straße ¿qué?", "日本語 テキスト", "▁x y", "x y  z", "é ́x", "İstanbul ΣΑΣ", "<s> a </s>", "a<|endoftext|>b <|startoftext|>", "½ ﬁ x²", "tab\tx  \t y", "a\r\nb", "it's we'll I'D 's", "x y", "a\x1cb \x85 c", "emoji 😀 x", "1234 5,678.90", "a" * 5000, "word " * 4000, "a\n \nb", "a \n\n b", "​x ​"]


def texts():
    rng = random.Random(3)
    bits = ["the", "of", " ", "\n", "  ", "é", "Thand.", "!!", "'s", " ", "\t", "9", "日", "ing", "-", "<|", "́", "ß", "A"]
    return ODD + ["".join(rng.choice(bits) + rng.choice(("", " ")) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]


def test_counts_equal_the_library():
    path = P.path("piece_bpe_32k.model")
    sp, ours = sentencepiece.SentencePieceProcessor(model_file=path), Counter(path)
    assert ours.lines_split and len(ours.whole) > 5000
    for t, n in zip(texts(), ours.count(texts()), strict=True):
        assert n == len(sp.encode(t)), repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_equals_the_library(name):
    tok, ours = Tokenizer.from_file(P.path(name)), Encoder(P.path(name))
    for t, ids in zip(texts(), ours.encode(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def rows():
    return [(i * 7 % 101, t, "x") for i, t in enumerate(ODD + [None])]


def test_count_query(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, n_tokens string")
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r["id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(df, P.path("piece_bpe_32k.model")).collect()}
    assert got == {d: (len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for d, t, _ in rows()}
    assert count_tokens(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_orc_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string, file string")
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want, start = {}, 0
    for d, t, _ in sorted(rows(), key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r[0]: tuple(r)[1:] for r in tokens_through_orc(df, path, path=str(tmp_path / "t")).collect()}
    assert got == want
    assert tokens_through_orc(df.limit(0), path).count() == 0
