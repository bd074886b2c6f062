import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanery.llm import token_files as T
from gleanery.llm.queries import TOKENIZER
from gleanery.llm.word_table import letters_apart
from gleanery.session import scratch_path
from tests.llm.helpers import TEXTS, fixture


def test_frames():
    payloads = [b"", b"x", b"yz" * 1000]
    data = memoryview(b"".join(map(T.frame, payloads)))
    at, found = 0, []
    while at < len(data):
        payload, at = T.unframe(data, at)
        found.append(bytes(payload))
    assert found == payloads
    for place in (0, 9, 13, len(data) - 1):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            at = 0
            while at < len(broken):
                _, at = T.unframe(memoryview(broken), at)


@pytest.mark.parametrize("records", [1, 3, 2048])
def test_round_trip(spark, records):
    library = Tokenizer.from_file(TOKENIZER)
    folder = scratch_path(spark, "tokens-test")
    T.write_tokens(fixture(spark), folder, TOKENIZER, files=4)
    rows = T.read_tokens(spark, folder, records).collect()
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t, _, _ in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        coded = [*library.encode(t, add_special_tokens=False).ids, T.END_ID]
        want.append((i, start, len(coded), zlib.crc32(np.array(coded, dtype="<u4").tobytes())))
        start += len(coded)
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.token_ids)) for r in rows), key=str) == sorted(want, key=str)


def test_files_that_the_manifest_does_not_name_are_not_read(spark):
    folder = scratch_path(spark, "tokens-test")
    T.write_tokens(fixture(spark), folder, TOKENIZER, files=2)
    store, root = T.opened(folder)
    with store.open_output_stream(f"{root}/part-000000-lost.tok") as out:
        out.write(b"half a file")
    assert T.read_tokens(spark, folder).count() == len(TEXTS)


def test_empty_table(spark):
    folder = scratch_path(spark, "tokens-test")
    T.write_tokens(fixture(spark).limit(0), folder, TOKENIZER)
    assert T.read_tokens(spark, folder).collect() == []


def test_encoding_by_word_equals_whole_texts():
    one, other = T.Encoder(TOKENIZER, True), T.Encoder(TOKENIZER, False)
    texts = [t or "" for _, t, _, _ in TEXTS] + ["a\x1cb c", "x<|endoftext|>y", "é.", "don't,", " 　 "]
    assert one.encode(texts) == other.encode(texts)


def test_files_tell_whether_words_can_be_encoded_apart(spark):
    byte_level = TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k")
    assert T.Encoder(TOKENIZER).by_word and not T.Encoder(byte_level).by_word
    folder = scratch_path(spark, "tokens-test")
    texts = [(1, "ab ab"), (2, " x\n\n y"), (3, None)]
    T.write_tokens(spark.createDataFrame(texts, "doc_id long, text string"), folder, byte_level, end_id=None)
    library = Tokenizer.from_file(byte_level)
    got = {r.doc_id: np.frombuffer(r.token_ids, "<u4").tolist() for r in T.read_tokens(spark, folder).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}


def test_forms_of_a_word_are_encoded_once():
    one, other = T.Encoder(TOKENIZER, True), T.Encoder(TOKENIZER, False)
    library, calls = one.words.encode, []
    one.words.encode = lambda words: calls.extend(words) or library(words)
    forms = ["été", "Été,", "ÉTÉ***", "été...", "été&&&", "house", "House'", "HOUSE$|", "house_"]
    marks = ["'s", "house's***", "ªµß!", "İ***", "ΑΣ.", "e\u0301***", "x<|endoftext|>", "endoftext|>", "a1***", "***", "_", "ﬁ!?"]
    texts = [*forms, *marks, " ".join([*forms, *marks])]
    assert one.encode(texts) == other.encode(texts)
    assert calls.count("été") == calls.count("house") == 1
    assert not {"Été,", "ÉTÉ***", "été&&&", "HOUSE$|"} & set(calls)


def test_files_that_take_letters_apart_from_their_accents_share_no_forms():
    spec = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    assert letters_apart(spec)
    assert not letters_apart({**spec, "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "Lowercase"}]}})
    assert not letters_apart({**spec, "added_tokens": [{"content": "word!"}]})
