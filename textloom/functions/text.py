"""Text column functions: normalisation, tokens, scripts, titles, field sanitising.

Built-in expressions wherever Spark has them; Arrow UDFs only for Unicode
composition and for callbacks on matches. Null in, null out unless stated.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

ZWNJ = "‌"

# Characters that are replaced, and what replaces them.
VARIANTS = "يىكە‍"  # Arabic yeh, alef maksura, Arabic kaf, ae, zero-width joiner
STANDARD = "ییکه‌"  # Persian yeh, Persian yeh, keheh, heh, zero-width non-joiner

# Consonants and their renderings.
CONSONANTS = {
    "ب": "b", "پ": "p", "ت": "t", "ث": "s", "ج": "j", "چ": "ch", "ح": "ḥ", "خ": "kh", "د": "d", "ذ": "z", "ر": "r", "ز": "z", "ژ": "zh",
    "س": "s", "ش": "sh", "ص": "ṣ", "ض": "ż", "ط": "ṭ", "ظ": "ẓ", "ع": "ʿ", "غ": "gh", "ف": "f", "ق": "q", "ک": "k", "گ": "g", "ل": "l",
    "م": "m", "ن": "n", "و": "v", "ه": "h", "ۀ": "h", "ی": "y", "ء": "ʾ", "أ": "ʾ", "إ": "ʾ", "ؤ": "ʾ", "ئ": "ʾ",
}

# Words and prefixes of publication titles.
MINOR_WORDS = ("al", "az", "ba", "bar", "bi", "dar", "fi", "la", "li", "ta", "u", "va", "wa")
STRUCTURAL_SUFFIXES = ("i", "yi", "ha", "hā", "am", "at", "ash", "iman", "imān", "itan", "itān", "ishan", "ishān")
PREFIXES = ("wa-l-", "bi-l-", "li-l-", "la-l-", "al-", "wa-", "bi-", "li-", "la-")

ARABIC_LETTER = r"[\p{IsArabic}&&\p{L}]"
WORD = rf"{ARABIC_LETTER}(?:{ARABIC_LETTER}|[\p{{M}}{ZWNJ}])*"
#: White space as browsers and databases with Unicode see it; Java's own class is ASCII.
SPACES = r"\t\n\x0B\f\r \x85   -     　﻿"


#: Texts of an Arrow batch that Python holds at once.
HELD = 32


def _by_slices(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """``change`` of every text that is not ASCII; of a batch only ``HELD`` texts are Python's at a time."""
    parts = []
    for at in range(0, len(texts), HELD):
        part = texts.slice(at, HELD)
        held = part.to_pylist()
        plain = all(x is None or x.isascii() for x in held)
        parts.append(part if plain else pa.array([x if x is None or x.isascii() else change(x) for x in held], texts.type))
    return pa.concat_arrays(parts) if parts else texts


@F.arrow_udf(StringType())
def nfc(s: pa.Array) -> pa.Array:
    return _by_slices(s, lambda x: unicodedata.normalize("NFC", x))


def normalize_text(c: Column) -> Column:
    """TXT1: composed form, standard letters, single spaces."""
    return F.regexp_replace(F.translate(nfc(c), VARIANTS, STANDARD), r"[ \t\r\n]+", " ")


_CHANGE = ArrayType(StructType([StructField("kind", StringType()), StructField("at", IntegerType()), StructField("before", StringType()), StructField("after", StringType())]))


@F.pandas_udf(_CHANGE)
def normalization_changes(s: pd.Series) -> pd.Series:
    """TXT1: what normalisation changes, in order, at UTF-16 offsets of the composed text."""
    swap = dict(zip(VARIANTS, STANDARD))

    def changes(text):
        if text is None:
            return None
        out, composed = [], unicodedata.normalize("NFC", text)
        if composed != text:
            out.append(("COMPOSE", 0, text, composed))
        at = 0
        for m in regex.finditer(r"[ \t\r\n]+|.", composed, regex.S):
            piece = m[0]
            if piece in swap:
                out.append(("LETTER" if piece != "‍" else "JOINER", at, piece, swap[piece]))
            elif piece in ("ۀ", "ة"):
                out.append(("KEPT", at, piece, piece))
            elif piece[0] in " \t\r\n" and piece != " ":
                out.append(("SPACE", at, piece, " "))
            at += len(piece.encode("utf-16-le")) // 2
        return out

    return s.map(changes)


TOKEN_CLASSES = (
    ("whitespace", rf"[{SPACES}]+"),
    ("persian-word", WORD),
    ("number", r"\p{Nd}+"),
    ("latin", r"[\p{IsLatin}&&\p{L}](?:[\p{IsLatin}&&\p{L}]|\p{M})*"),
    ("punctuation", r"\p{P}"),
    ("unknown", r"(?s:.)"),
)
#: The character that a token of each class begins with.
TOKEN_BEGINS = (("whitespace", rf"[{SPACES}]"), ("persian-word", ARABIC_LETTER), ("number", r"\p{Nd}"), ("latin", r"[\p{IsLatin}&&\p{L}]"), ("punctuation", r"\p{P}"))
_ANY_TOKEN = "|".join(f"(?:{rx})" for _, rx in TOKEN_CLASSES)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: code points plus those beyond the basic plane."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x{0}-\x{FFFF}]", ""))


@F.pandas_udf(ArrayType(IntegerType()))
def utf16_starts(surfaces: pd.Series) -> pd.Series:
    """WIN5: where each of a text's tokens starts, in UTF-16 units; linear in the text."""

    def starts(words):
        out, at = [], 0
        for w in words:
            out.append(at)
            at += len(w.encode("utf-16-le", "surrogatepass")) // 2
        return out

    return surfaces.map(lambda words: None if words is None else starts(words))


def tokens(c: Column) -> Column:
    """TXT2: array of surfaces; every character is in exactly one token."""
    return F.regexp_extract_all(c, F.lit(_ANY_TOKEN), F.lit(0))


def token_class(surface: Column) -> Column:
    """TXT2/TXT3: class of one token, by its first character."""
    first, out = F.substring(surface, 1, 1), F.lit("unknown")
    for name, rx in reversed(TOKEN_BEGINS):
        out = F.when(first.rlike(rx), name).otherwise(out)
    return out


def contains_arabic(c: Column) -> Column:
    """TXT4"""
    return c.rlike(r"[\p{IsArabic}&&[\p{L}\p{M}]]")


def script_counts(c: Column) -> Column:
    """TXT18: Arabic and Latin letters and lexical tokens."""
    count = lambda rx: F.size(F.regexp_extract_all(c, F.lit(rx), F.lit(0)))
    return F.struct(
        count(ARABIC_LETTER).alias("arabic"),
        count(r"[\p{IsLatin}&&\p{L}]").alias("latin"),
        F.size(F.filter(F.regexp_extract_all(c, F.lit(rf"(?:{ARABIC_LETTER}|[\p{{M}}{ZWNJ}])+"), F.lit(0)), lambda w: w.rlike(ARABIC_LETTER))).alias("tokens"),
    )


def script_class(c: Column) -> Column:
    """TXT19: five classes of a text's scripts."""
    arabic, latin = c.rlike(r"\p{IsArabic}"), c.rlike(r"\p{IsLatin}")
    persian = c.rlike("[پچژگکی]")
    return F.when(arabic & latin, "MIXED_ARABIC_LATIN").when(arabic & persian, "PERSIAN_SCRIPT").when(arabic, "ARABIC_SCRIPT_UNCERTAIN_LANGUAGE").when(latin, "LATIN_ONLY").otherwise("OTHER_SCRIPT")


def lookup_form(c: Column) -> Column:
    """TXT5: without marks, final heh without its hamza."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{M}", ""), "ۀ$", "ه")


def orthography(c: Column) -> Column:
    """TXT5: lookup form, segments, explicit izafat and unsupported marks of one word."""
    final_kasra = c.rlike(rf"{ARABIC_LETTER}ِ$")
    heh = c.rlike("ۀ$|هٔ$")
    return F.struct(
        lookup_form(c).alias("lookup_form"),
        F.split(lookup_form(c), ZWNJ, -1).alias("segments"),
        F.when(final_kasra, "FINAL_KASRA").when(heh, "HEH_ORTHOGRAPHY").alias("izafat"),
        F.regexp_extract_all(c, F.lit("[َُِ]"), F.lit(0)).alias("vowels"),
        F.regexp_extract_all(c, F.lit(r"[\p{M}&&[^َُِٔ]]"), F.lit(0)).alias("unsupported_marks"),
    )


def consonantal_scaffold(c: Column) -> Column:
    """TXT6: each character's rendering; [TM] for teh marbuta, a dot for what has none."""
    table = F.create_map(*(F.lit(x) for pair in {**CONSONANTS, "ة": "[TM]"}.items() for x in pair))
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(table, x), F.lit("·"))), "")


def canonical_initial(c: Column) -> Column:
    """TXT7"""
    return F.regexp_replace(c, "^ʾ", "")


_TITLE_WORD = regex.compile(r"[\p{L}\p{M}ʿʾ]+(?:-[\p{L}\p{M}ʿʾ]+)*")


def _citation_word(word: str) -> str:
    head, dash, rest = word.partition("-")
    mark = head[:1] if head[:1] in ("ʿ", "ʾ", "'", "`") else ""
    body = head[len(mark) :]
    return mark + body[:1].upper() + body[1:] + dash + rest


@F.pandas_udf(StringType())
def citation_title(s: pd.Series) -> pd.Series:
    """TXT8: each word's first segment capitalised."""
    return s.map(lambda t: None if t is None else _TITLE_WORD.sub(lambda m: _citation_word(m[0]), t))


@F.arrow_udf(StringType())
def without_diacritics(s: pa.Array) -> pa.Array:
    """TXT9: letters without their marks."""
    return _by_slices(s, lambda t: unicodedata.normalize("NFC", regex.sub(r"\p{M}+", "", unicodedata.normalize("NFD", t))))


def _capital(part: str) -> str:
    m = regex.search(r"(?V1)[\p{L}--[ʿʾ]]", part)
    return part if m is None else part[: m.start()] + m[0].upper() + part[m.end() :]


def _publication_word(word: str, edge: bool) -> str:
    low = word.lower()
    for prefix in PREFIXES:
        if low.startswith(prefix):
            return prefix + _capital(word[len(prefix) :])
    out = []
    for k, part in enumerate(word.split("-")):
        bare = regex.sub("^[ʿʾ]", "", part).lower()
        small = bare in MINOR_WORDS and not edge if k == 0 else bare in MINOR_WORDS or bare in STRUCTURAL_SUFFIXES
        out.append(part.lower() if small else _capital(part))
    return "-".join(out)


@F.pandas_udf(StringType())
def publication_title(s: pd.Series) -> pd.Series:
    """TXT10: headline case with minor words, prefixes and structural suffixes left small."""

    def title(t):
        if t is None:
            return None
        found = list(_TITLE_WORD.finditer(t))
        out, at = [], 0
        for k, m in enumerate(found):
            out += [t[at : m.start()], _publication_word(m[0], k in (0, len(found) - 1))]
            at = m.end()
        return "".join(out) + t[at:]

    return s.map(title)


def scholarly_rendering(canonical: Column, profile: Column) -> Column:
    """TXT11/TXT12: rendering of a canonical form by profile; diagnostics block it."""
    findings = canonical_findings(canonical)
    text = (
        F.when(profile == "ijmes_citation_title", citation_title(canonical)).when(profile == "publication_title", publication_title(without_diacritics(canonical))).when(profile == "ijmes_full", canonical)
    )
    return F.struct(F.when(F.size(findings) == 0, text).alias("rendered"), findings.alias("findings"))


def canonical_findings(c: Column) -> Column:
    """TXT12: what keeps a canonical form from being rendered."""
    rules = (("EMPTY", F.coalesce(F.trim(c), F.lit("")) == ""), ("ARABIC_SCRIPT", contains_arabic(c)), ("PLACEHOLDER", c.rlike("⟦|⟧|\\[TM\\]|·")), ("CONTROL", c.rlike(r"\p{Cc}")))
    return F.array_compact(F.array(*(F.when(bad, code) for code, bad in rules)))


def manual_entry_findings(c: Column) -> Column:
    """TXT13: a typed transliteration must not be blank, hold controls or Arabic script."""
    bare = unicode_trim(c)
    rules = (("EMPTY", F.coalesce(bare, F.lit("")) == ""), ("CONTROL_CHARACTER", bare.rlike(r"\p{Cc}")), ("ARABIC_SCRIPT", contains_arabic(bare)))
    return F.array_compact(F.array(*(F.when(bad, code) for code, bad in rules)))


def unicode_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def header_key(c: Column) -> Column:
    """TXT14"""
    return F.regexp_replace(F.lower(c), rf"[{SPACES}\-_]+", "")


def creators(c: Column) -> Column:
    """TXT15"""
    return F.filter(F.transform(F.split(c, r"\|"), unicode_trim), lambda x: x != "")


def roman_lexemes(c: Column) -> Column:
    """TXT16: romanised words with inner hyphens."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}ʿʾʼ’']+(?:-[\p{L}\p{M}ʿʾʼ’']+)*"), F.lit(0))


def lexical_words(c: Column) -> Column:
    """TXT17"""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def linkage_subfield(c: Column) -> Column:
    """TXT20: tag, occurrence, script and orientation of a linkage like 880-01/(3/r."""
    rx = r"^(\d{3})-(\d{2})(?:/([^/]+))?(?:/([a-z]))?$"
    part = lambda k: F.nullif(F.regexp_extract(c, rx, k), F.lit(""))
    return F.struct(part(1).alias("tag"), part(2).alias("occurrence"), part(3).alias("script"), part(4).alias("orientation"))


def marc_languages(c: Column) -> Column:
    """TXT21: codes of three letters."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3}"), F.lit(0))


def decode_xml(c: Column) -> Column:
    """TXT22: the five named references; the ampersand last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def identifiers(c: Column) -> Column:
    """TXT23: ISBN, year, OCLC number and NCID found in a text."""
    find = lambda rx, k=1: F.nullif(F.regexp_extract(c, rx, k), F.lit(""))
    isbn = F.regexp_replace(find(r"((?:97[89][- ]?)?\d[\d -]{8,14}[\dXx])"), "[^0-9Xx]", "")
    return F.struct(
        F.when(F.length(isbn).isin(10, 13), F.upper(isbn)).alias("isbn"),
        find(r"(?<!\d)(1[0-9]{3}|20[0-9]{2})(?!\d)").alias("year"),
        find(r"(?i)\bocolc\)?\s*0*(\d+)").alias("oclc"),
        find(r"\b(B[AB]\d{7}[\dX])\b").alias("ncid"),
    )


def bibtex_value(c: Column) -> Column:
    """TXT24"""
    return F.regexp_replace(c, r"([\\{}%$&#])", r"\\$1")


def bibtex_key(c: Column) -> Column:
    """TXT24"""
    clean = F.regexp_replace(c, r"[^a-zA-Z0-9_]", "_")
    return F.when(clean.startswith("pst_"), clean).otherwise(F.concat(F.lit("pst_"), clean))


def ris_value(c: Column) -> Column:
    """TXT24: line breaks become single spaces."""
    return unicode_trim(F.regexp_replace(c, r"[\r\n]+", " "))


def csv_cell(c: Column) -> Column:
    """SNK6"""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), "").when(c.rlike('[,"\r\n]'), quoted).otherwise(c)


def same_text(a: Column, b: Column) -> Column:
    """TXT25: equal when composed."""
    return nfc(a) == nfc(b)


def title_match(a: Column, b: Column) -> Column:
    """TXT26: exact, equal when normalised, contained or with a common beginning of ten characters, or none."""
    a, b = unicode_trim(a), unicode_trim(b)
    na, nb = unicode_trim(normalize_text(a)), unicode_trim(normalize_text(b))
    begins = (F.length(na) > 5) & (F.length(nb) > 5) & (na.startswith(F.left(nb, F.lit(10))) | nb.startswith(F.left(na, F.lit(10))))
    return F.when(a == b, "EXACT_PERSIAN_TITLE_MATCH").when(na == nb, "NORMALIZATION_EQUIVALENT_TITLE_MATCH").when(na.contains(nb) | nb.contains(na) | begins, "PARTIAL_TITLE_MATCH").otherwise("NO_CONFIRMED_MATCH")


def reading_identity(reading_id: Column, canonical: Column) -> Column:
    """TXT27"""
    return F.coalesce(reading_id, F.concat(F.lit("canonical:"), canonical))


def valid_iso_date(c: Column) -> Column:
    """TXT28"""
    return c.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$") & F.try_to_timestamp(c).isNotNull()
