import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    r = random.Random(4)
    syllables = ["the", "tion", "an", "qu", "é", "ñ", "sch", "ß", "ing", "re", "o", "'s", "x", "ou", "ll", "'LL", "Ü"]
    out = ["", " ", "Hello, World's 123 …", "\x1c\x85\xa0　a b​c", "ΑΣ ΟΔΟΣ İstanbul ǅ ﬁ", "é é 가", "<|startoftext|>Hi<|endoftext|> <|ENDOFTEXT|> <|end", "日本語 テキスト 🙂🙂👨‍👩‍👧", "²½ⅷ٣ 𝟘", "a" * 3000, "!?" * 500, "don't we're I'M it'd'll",
           "\x00\x01�퟿", "aͅ ŉ ẞ Å", "Ⓐ ª º ʰ", "ab­cd"]
    for _ in range(400):
        out.append("".join(r.choice(syllables) + r.choice(["", "", " ", ", ", "\n"]) for _ in range(r.randint(1, 60))))
    for _ in range(300):
        out.append("".join(chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x2FF), r.randint(0x370, 0x5FF), r.randint(0x900, 0x97F), r.randint(0x2000, 0x22FF), r.randint(0x4E00, 0x4FFF)])) for _ in range(r.randint(1, 60))))
    return out


@pytest.mark.parametrize("kept", [400_000, 50])
def test_same_as_library(spark, library, monkeypatch, kept):
    monkeypatch.setattr(bpe, "WORDS_KEPT", kept)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", kept)
    monkeypatch.setattr(bpe, "ENCODE_CHUNK", 3000)
    bpe._loaded.clear()
    encoder = bpe.encoder(PATH)
    for t in [texts()[i : i + 9] for i in range(0, len(texts()), 9)]:
        for text, ids, want in zip(t, encoder.encode(t), library.encode_batch(t, add_special_tokens=False)):
            assert ids == want.ids, text
            assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_marks_and_letters_of_later_unicode_versions(library):
    r = random.Random(1)
    pool = [0x9FE, 0x11930, 0x11935, 0x1DFA, 0x300, 0x301, 0x323, 0x345, 0xA7CB, 0xA7DC, 0x10D50, 0x10D40, 0x16130, 0x13460, 0x16EA0, 0x61, 0x45, 0xC5, 0x3A3, 0x31, 0xB2, 0x20]
    texts = ["a\u0323\u09fe\u0323\u0301e\u0301", "\u09fe\u0323\u0301"]
    texts += ["".join(chr(r.choice([*pool, r.randint(0x80, 0x2FFF), r.randint(0x10000, 0x1EFFF)])) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    encoder = bpe.Encoder(PATH)
    for text, ids, want in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids == want.ids, [hex(ord(c)) for c in text]


def test_special_tokens_in_a_text_of_more_words_than_are_kept(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 20)
    text = "<|startoftext|>" + " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)) + "<|endoftext|>"
    encoder = bpe.Encoder(PATH)
    for t in (text, "some other words", text):
        assert encoder.encode([t]) == [library.encode(t, add_special_tokens=False).ids]


def test_most_words_are_not_merged(library):
    encoder = bpe.Encoder(PATH)
    merged = []
    plain = encoder.merge
    encoder.learn(["hello", "world"])
    encoder.merge = lambda ids: merged.append(1) or plain(ids)
    encoder.learn(["hello", "world"])
    assert not merged


def test_operator(spark, library):
    rows = [(1, "Two words", "x"), (2, None, "x"), (3, "", "x"), (1, "Two words", "x"), (None, "l'été", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in bpe.encode_and_decode(df, PATH).collect()), key=repr)
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    assert got == sorted(((i, w, library.decode(w, skip_special_tokens=False)) for (i, _, _), w in zip(rows, want)), key=repr)
    assert bpe.encode_and_decode(df.limit(0), PATH).count() == 0
