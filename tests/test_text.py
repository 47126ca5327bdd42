import pytest
from pyspark.sql import functions as F

from textloom.functions import hashing as H
from textloom.functions import text as T
from tests.conftest import make_session


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


make_session()
X = F.col("x")


@pytest.mark.parametrize("text,want", [("كتاب  \n علي", "کتاب علی"), ("آ", "آ"), ("می‍روم", "می‌روم"), (None, None), ("", ""), ("ە", "ه")])
def test_normalize(spark, text, want):
    assert one(spark, text, T.normalize_text(X)) == want


def test_changes_have_utf16_offsets(spark):
    got = one(spark, "\U0001f600ي\t", T.normalization_changes(X))
    assert [(c.kind, c["at"], c.after) for c in got] == [("LETTER", 2, "ی"), ("SPACE", 3, " ")]


def test_tokens(spark):
    text = "کتاب‌ها 12, abc é?\U0001f600\n  ۱۲"
    tokens = one(spark, text, T.tokens(X))
    assert "".join(tokens) == text
    got = one(spark, text, F.transform(T.tokens(X), T.token_class))
    assert list(zip(tokens, got)) == [("کتاب‌ها", "persian-word"), (" ", "whitespace"), ("12", "number"), (",", "punctuation"), (" ", "whitespace"), ("abc", "latin"), (" ", "whitespace"), ("é", "latin"), ("?", "punctuation"), ("\U0001f600", "unknown"), ("\n  ", "whitespace"), ("۱۲", "number")]
    assert one(spark, "a\U0001f600b", T.utf16_length(X)) == 4


def test_orthography(spark):
    got = one(spark, "کتابِ", T.orthography(X))
    assert (got.lookup_form, got.izafat, list(got.vowels)) == ("کتاب", "FINAL_KASRA", ["ِ"])
    assert one(spark, "خانۀ", T.orthography(X)).izafat == "HEH_ORTHOGRAPHY"
    assert one(spark, "خانۀ", T.lookup_form(X)) == "خانه"
    assert list(one(spark, "مّ", T.orthography(X)).unsupported_marks) == ["ّ"]


def test_renderings(spark):
    assert one(spark, "شةx", T.consonantal_scaffold(X)) == "sh[TM]·"
    assert one(spark, "tārīkh-i ʿilm va adab", T.citation_title(X)) == "Tārīkh-i ʿIlm Va Adab"
    assert one(spark, "tārīkh-i ʿilm va adab-i al-fārs", T.publication_title(X)) == "Tārīkh-i ʿIlm va Adab-i al-Fārs"
    assert one(spark, "ḥāfiẓ ʿayn", T.without_diacritics(X)) == "hafiz ʿayn"
    assert one(spark, "abc ⟦x⟧", T.canonical_findings(X)) == ["PLACEHOLDER"]
    assert one(spark, " ", T.manual_entry_findings(X)) == ["EMPTY"]
    assert one(spark, "ḥ", T.scholarly_rendering(X, F.lit("publication_title"))).rendered == "H"


def test_fields(spark):
    assert one(spark, "Container_Title - x", T.header_key(X)) == "containertitlex"
    assert one(spark, " A | | B ", T.creators(X)) == ["A", "B"]
    assert one(spark, "880-01/(3/r", T.linkage_subfield(X)).asDict() == {"tag": "880", "occurrence": "01", "script": "(3", "orientation": "r"}
    assert one(spark, "engper", T.marc_languages(X)) == ["eng", "per"]
    assert one(spark, "a &amp;lt; &quot;", T.decode_xml(X)) == 'a &lt; "'
    assert one(spark, r"a\{%$&#}", T.bibtex_value(X)) == r"a\\\{\%\$\&\#\}"
    assert one(spark, "pst_a-b", T.bibtex_key(X)) == "pst_a_b"
    assert one(spark, "a\r\nb ", T.ris_value(X)) == "a b"
    assert one(spark, 'a,"b', T.csv_cell(X)) == '"a,""b"'
    assert one(spark, "2020-02-30", T.valid_iso_date(X)) is False
    assert one(spark, "2020-02-29", T.valid_iso_date(X)) is True
    assert one(spark, "ISBN 978-3-16-148410-0, 1999", T.identifiers(X)).isbn == "9783161484100"
    assert one(spark, "سلام abc", T.script_class(X)) == "MIXED_ARABIC_LATIN"


def test_hashes(spark):
    assert one(spark, "", H.fnv1a_32(X)) == "811c9dc5"
    assert one(spark, "a", H.fnv1a_32(X)) == "e40c292c".replace("e40c292c", f"{((0x811C9DC5 ^ 97) * 0x01000193) & 0xFFFFFFFF:08x}")
    assert one(spark, "a", H.fnv1a_64(X)) == f"{((((0xCBF29CE484222325 ^ 97) * 0x100000001B3)) & (2**64 - 1)):016x}"
    assert one(spark, '{"b": [1, {"d": 2, "c": 3}], "a": null}', H.stable_json(X)) == '{"a":null,"b":[1,{"c":3,"d":2}]}'
    assert one(spark, "hello\n", H.git_blob_sha1(X)) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, None, H.content_id(X, F.lit("b"))) == one(spark, "", H.content_id(X, F.lit("b")))


def test_json_strings_as_scripts_write_them(spark):
    import hashlib
    import json

    texts = ["plain", 'q"uo\\te', "line\nfeed\ttab\r\b\f", "\x00\x01\x1f end", "é 🙂 /", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.j, r.h) for r in df.select("t", H.json_string(F.col("t")).alias("j"), H.quoted_sha256(F.col("t")).alias("h")).collect()}
    for t in texts:
        want = json.dumps(t, ensure_ascii=False)
        assert got[t] == (want, hashlib.sha256(want.encode()).hexdigest())
