import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import bpe
from gleanery.llm.queries import TOKENIZER
from gleanery.llm.word_table import WordTable
from tests.llm.helpers import TEXTS, fixture

PIECES = [
    "'s", "'t", "<|endoftext|>", "<|startoftext|>", "Σ", "ς", "İ", "é", "é", "ﬀ", "中文", "\x1c", "\x85", "　",
    " ", "1", "²", "!!", "...", "\n", "\t", "the", "ing", "A", "ß", "🇫🇷", "👩‍👧", "́", "\0", "Ᲊ", "\U000323b0", ",", "word.", "Word!",
]


@pytest.fixture(scope="module")
def pair():
    return bpe.Bpe(TOKENIZER), Tokenizer.from_file(TOKENIZER)


def ids(model, text):
    return np.frombuffer(model.words.ids([text])[0], dtype="<u4").tolist()


def test_random_texts_equal_the_library(pair):
    mine, library = pair
    draw = random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(mine, text) == want, repr(text)
        assert mine.decode(mine.encode([text])[0]) == library.decode(want, skip_special_tokens=False)


def test_every_character_up_to_three_bytes(pair):
    mine, library = pair
    codes = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 64):
        text = " ".join(f"a{chr(c)}b {chr(c)}" for c in codes[at : at + 64])
        assert ids(mine, text) == library.encode(text, add_special_tokens=False).ids


def test_long_words(pair):
    mine, library = pair
    for text in ("abcdefghij" * 5000, "é" * 3000, "!" * 3000, "ab1" * 2000):
        assert ids(mine, text) == library.encode(text, add_special_tokens=False).ids


def test_word_table_forgets_and_still_answers():
    calls = []
    table = WordTable(lambda words: calls.append(len(words)) or [w.encode() for w in words], kept=5)
    for n in range(40):
        text = f"often w{n} v{n} u{n}"
        assert table.ids([text]) == [text.replace(" ", "").encode()]
    assert len(table.young) + len(table.old) < 20


def test_texts_of_the_fixture(spark, pair):
    library = pair[1]
    got = bpe.coded_texts(fixture(spark).withColumn("n_tokens", F.lit("clash")), TOKENIZER)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "_text", "_id", "words", "n_tokens", "token_ids", "decoded"}
    want = []
    for i, t, _, _ in TEXTS:
        coded = library.encode(t or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(coded, dtype="<u4").tobytes()).hexdigest()
        want.append((i, len(coded), digest, library.decode(coded, skip_special_tokens=False)))
    rows = got.select("doc_id", "n_tokens", F.sha2("token_ids", 256), "decoded").collect()
    assert sorted(str(tuple(r)) for r in rows) == sorted(map(str, want))
    apart = bpe.decode_ids(bpe.encode_texts(fixture(spark), TOKENIZER, keep=["doc_id"]), TOKENIZER)
    assert sorted(str((r.doc_id, r.decoded)) for r in apart.collect()) == sorted(str((w[0], w[3])) for w in want)
    assert bpe.coded_texts(fixture(spark).limit(0), TOKENIZER).collect() == []
