"""Registered queries of the text, hashing, filter and lookup operators, with their SQL twins.

The tables hold Latin text; where an operator is about Persian, ``_fa`` writes the letters a-z
in Persian ones, over the whole column.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import hashing as H
from textloom.functions import text as T
from textloom.operators import accuracy as A2
from textloom.operators import audit as A
from textloom.operators import bibliography as B
from textloom.operators import coverage as C
from textloom.operators import evidence as E
from textloom.operators import resolve as R
from textloom.operators import selection as S
from textloom.operators import store as V
from textloom.plans.catalog import query
from textloom.session import table

LATIN, PERSIAN = "abcdefghijklmnopqrstuvwxyz", "ابپتثجچحخدذرزژسشصضطظعغفقکگ"


def _fa(c):
    return F.translate(F.lower(c), LATIN, PERSIAN)


def _sql_fa(c: str) -> str:
    return f"translate(lower({c}), '{LATIN}', '{PERSIAN}')"


_NAME = _sql_fa("p_name")
#: A name's first word in Persian letters, and all of them as rows.
_FIRST = _sql_fa("split_part(p_name, ' ', 1)")


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("fa", _fa(F.col("p_name"))).withColumn("first", _fa(F.split_part("p_name", F.lit(" "), F.lit(1))))


@query("txt3_persian_words", f"SELECT p_partkey, len(regexp_extract_all({_NAME}, '\\p{{Arabic}}+'))::INT AS words, len(regexp_extract_all({_NAME}, '[^\\p{{Arabic}}]'))::INT AS others FROM part")
def txt3(spark, sf_dir):
    classes = F.transform(T.tokens(F.col("fa")), T.token_class)
    count = lambda test: F.size(F.filter("cs", test))
    return _part(spark, sf_dir).select("p_partkey", classes.alias("cs")).select("p_partkey", count(lambda x: x == "persian-word").alias("words"), count(lambda x: x != "persian-word").alias("others"))


@query("txt4_contains_arabic", f"SELECT doc_id, regexp_matches(CASE WHEN n_chars > 500 THEN {_sql_fa('text')} ELSE text END, '\\p{{Arabic}}') AS arabic FROM documents")
def txt4(spark, sf_dir):
    mixed = F.when(F.col("n_chars") > 500, _fa(F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.contains_arabic(mixed).alias("arabic"))


@query("txt5_orthography", f"SELECT p_partkey, {_FIRST} AS lookup_form, CASE WHEN p_size > 25 THEN 'FINAL_KASRA' END AS izafat, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS vowels, 0 AS unsupported, 1 AS segments FROM part")
def txt5(spark, sf_dir):
    word = F.concat(F.left("first", F.lit(1)), F.lit("َ"), F.substring("first", 2, 99), F.when(F.col("p_size") > 25, "ِ").otherwise(""))
    o = _part(spark, sf_dir).select("p_partkey", T.orthography(word).alias("o"))
    return o.select("p_partkey", "o.lookup_form", "o.izafat", F.size("o.vowels").alias("vowels"), F.size("o.unsupported_marks").alias("unsupported"), F.size("o.segments").alias("segments"))


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**T.CONSONANTS, "ة": "[TM]"}.items()) + "}"


@query("txt6_scaffold", f"SELECT p_partkey, array_to_string(list_transform(string_split({_NAME}, ''), lambda c: coalesce({_MAP}[c], '·')), '') AS scaffold FROM part")
def txt6(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", T.consonantal_scaffold(F.col("fa")).alias("scaffold"))


@query("txt7_canonical_initial", "SELECT c_custkey, CASE WHEN c_acctbal > 3000 THEN c_name ELSE c_mktsegment || 'ʾ' END AS canonical FROM customer")
def txt7(spark, sf_dir):
    raw = F.when(F.col("c_acctbal") > 3000, F.concat(F.lit("ʾ"), "c_name")).otherwise(F.concat("c_mktsegment", F.lit("ʾ")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.canonical_initial(raw).alias("canonical"))


_CAPITALS = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("txt8_citation_title", "SELECT p_partkey, " + _CAPITALS.format(x="replace(p_name, ' ', '-') || ' al-' || lower(p_type)") + " AS title FROM part")
def txt8(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.citation_title(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" al-"), F.lower("p_type"))).alias("title"))


@query("txt10_publication_title", "SELECT p_partkey, " + _CAPITALS.format(x="split_part(p_name, ' ', 1)") + " || ' va al-' || " + _CAPITALS.format(x="split_part(p_name, ' ', 2)") + " || '-ha' AS title FROM part")
def txt10(spark, sf_dir):
    words = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" VA al-"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("-HA"))
    raw = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" va al-"), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(T.publication_title(raw), F.substring(T.publication_title(F.concat(F.lit("x"), F.lit("-HA"))), 2, 9)).alias("title"), words.alias("_w")).drop("_w")


@query("txt11_renderings", "SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size % 2 = 0 THEN " + _CAPITALS.format(x="p_name") + " ELSE p_name END AS rendered, CASE WHEN p_size > 40 THEN 'PLACEHOLDER' ELSE '' END AS findings FROM part")
def txt11(spark, sf_dir):
    canonical = F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("⟦x⟧"))).otherwise(F.col("p_name"))
    profile = F.when(F.col("p_size") % 2 == 0, "ijmes_citation_title").otherwise("ijmes_full")
    out = table(spark, sf_dir, "part").select("p_partkey", T.scholarly_rendering(canonical, profile).alias("r"))
    return out.select("p_partkey", "r.rendered", F.array_join("r.findings", ",").alias("findings"))


@query("txt12_canonical_findings", r"""SELECT doc_id, concat_ws(',', CASE WHEN trim(text, ' ') = '' THEN 'EMPTY' END, CASE WHEN regexp_matches(text, '⟦|⟧|\[TM\]|·') THEN 'PLACEHOLDER' END, CASE WHEN regexp_matches(text, '\p{Cc}') THEN 'CONTROL' END) AS findings FROM documents""")
def txt12(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.canonical_findings(F.col("text")), ",").alias("findings"))


@query("txt13_manual_entry", f"SELECT p_partkey, CASE WHEN p_size < 10 THEN 'EMPTY' WHEN p_size < 20 THEN 'CONTROL_CHARACTER' WHEN p_size < 30 THEN 'ARABIC_SCRIPT' ELSE '' END AS findings FROM part WHERE {_NAME} <> ''")
def txt13(spark, sf_dir):
    typed = F.when(F.col("p_size") < 10, "  　\t").when(F.col("p_size") < 20, F.concat("p_name", F.lit("\x07x"))).when(F.col("p_size") < 30, F.col("fa")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return _part(spark, sf_dir).select("p_partkey", F.array_join(T.manual_entry_findings(typed), ",").alias("findings"))


@query("txt15_creators", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '#') || CASE WHEN p_size < 25 THEN '#' || p_brand ELSE '' END AS creators, (len(string_split(p_name, ' ')) + (p_size < 25)::INT)::INT AS n FROM part")
def txt15(spark, sf_dir):
    names = T.creators(F.concat(F.lit(" |"), F.replace("p_name", F.lit(" "), F.lit(" ||　")), F.lit("|"), F.when(F.col("p_size") < 25, F.col("p_brand")).otherwise(F.lit("  "))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, "#").alias("creators"), F.size(names).alias("n"))


@query("txt16_roman_lexemes", r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}ʿʾʼ’'']+(?:-[\p{L}\p{M}ʿʾʼ’'']+)*'))::INT AS lexemes FROM documents""")
def txt16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.roman_lexemes(F.col("text"))).alias("lexemes"))


@query("txt17_lexical_words", f"SELECT doc_id, len(regexp_extract_all({_sql_fa('text')}, '\\p{{Arabic}}+'))::INT AS words FROM documents")
def txt17(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.lexical_words(_fa(F.col("text")))).alias("words"))


@query("txt19_script_class", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'OTHER_SCRIPT' WHEN p_size < 20 THEN 'LATIN_ONLY' WHEN p_size < 30 THEN 'MIXED_ARABIC_LATIN' WHEN regexp_matches(lower(p_name), '[cgnyz]') THEN 'PERSIAN_SCRIPT' ELSE 'ARABIC_SCRIPT_UNCERTAIN_LANGUAGE' END AS class FROM part""")
def txt19(spark, sf_dir):
    shown = F.when(F.col("p_size") < 10, F.col("p_size").cast("string")).when(F.col("p_size") < 20, F.col("p_name")).when(F.col("p_size") < 30, F.concat_ws(" ", "p_name", "fa")).otherwise(F.col("fa"))
    return _part(spark, sf_dir).select("p_partkey", T.script_class(shown).alias("class"))


@query("txt20_linkage", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 40 THEN '245' END AS tag, CASE WHEN l_quantity < 40 THEN lpad(l_linenumber::VARCHAR, 2, '0') END AS occurrence, CASE WHEN l_quantity < 20 THEN '(3' END AS script, CASE WHEN l_quantity < 10 THEN 'r' END AS orientation FROM lineitem""")
def txt20(spark, sf_dir):
    q = F.col("l_quantity")
    code = F.concat(F.when(q < 40, "245-").otherwise("24-"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.when(q < 20, "/(3").otherwise(""), F.when(q < 10, "/r").otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.linkage_subfield(code).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query("txt21_marc_languages", "SELECT o_orderkey, array_to_string(regexp_extract_all(lower(o_orderpriority || o_orderstatus), '[a-z]{3}'), ',') AS codes FROM orders")
def txt21(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.marc_languages(F.concat("o_orderpriority", "o_orderstatus")), ",").alias("codes"))


@query("txt22_decode_xml", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS decoded FROM pages")
def txt22(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.decode_xml(F.col("html"))).alias("decoded"))


@query("txt23_identifiers", """SELECT o_orderkey, '978' || lpad(o_orderkey::VARCHAR, 10, '0') AS isbn, strftime(o_orderdate, '%Y') AS year, CASE WHEN o_custkey > 0 THEN o_custkey::VARCHAR ELSE '0' END AS oclc FROM orders""")
def txt23(spark, sf_dir):
    note = F.concat(F.lit("ISBN 978"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit(" ; "), F.date_format("o_orderdate", "yyyy"), F.lit(" (OCoLC)00"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.identifiers(note).alias("i")).select("o_orderkey", "i.isbn", "i.year", "i.oclc")


@query("txt24_export_values", r"""SELECT c_custkey, regexp_replace(c_name || ' & {50%}', '([\\{}%$&#])', '\\\1', 'g') AS bibtex, 'pst_' || regexp_replace(c_name, '[^a-zA-Z0-9_]', '_', 'g') AS key, c_name || ' ' || c_mktsegment AS ris FROM customer""")
def txt24(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.bibtex_value(F.concat("c_name", F.lit(" & {50%}"))).alias("bibtex"), T.bibtex_key(F.col("c_name")).alias("key"), T.ris_value(F.concat("c_name", F.lit("\r\n\n"), "c_mktsegment", F.lit("\n"))).alias("ris"))


@query("txt25_same_text", "SELECT doc_id, text IS NOT NULL AS composed, text IS NOT NULL AND NOT regexp_matches(text, '[A-Za-z]') AS lowered FROM documents")
def txt25(spark, sf_dir):
    text = F.col("text")
    apart = F.replace(F.replace(text, F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.same_text(text, apart), F.lit(False)).alias("composed"), F.coalesce(T.same_text(F.translate(F.translate(text, LATIN, "A" * 26), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "1" * 26), text), F.lit(False)).alias("lowered"))


@query("txt26_title_match", f"""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'EXACT_PERSIAN_TITLE_MATCH' WHEN p_size < 20 THEN 'NORMALIZATION_EQUIVALENT_TITLE_MATCH' WHEN p_size < 30 THEN 'PARTIAL_TITLE_MATCH' ELSE 'NO_CONFIRMED_MATCH' END AS match FROM part WHERE {_NAME} IS NOT NULL""")
def txt26(spark, sf_dir):
    a = F.col("fa")
    b = F.when(F.col("p_size") < 10, F.concat(F.lit(" "), a)).when(F.col("p_size") < 20, F.regexp_replace(a, " ", "  ")).when(F.col("p_size") < 30, F.concat(a, F.lit(" بد"))).otherwise(F.lit("ۀۀۀۀۀۀۀۀ"))
    return _part(spark, sf_dir).select("p_partkey", T.title_match(a, b).alias("match"))


@query("txt27_reading_identity", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR ELSE 'canonical:' || o_orderpriority END AS identity FROM orders")
def txt27(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.reading_identity(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")), F.col("o_orderpriority")).alias("identity"))


@query("txt28_iso_dates", """SELECT o_orderkey, o_orderstatus = 'F' AS valid FROM orders""")
def txt28(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = F.when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("T10:20:30Z"))).when(F.col("o_orderstatus") == "O", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-01"))).otherwise(F.replace(day, F.lit("-"), F.lit("/")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.valid_iso_date(shown).alias("valid"))


# Hashing


def _fnv_sql(text: str, bits: int) -> str:
    offset, prime, kind = (0x811C9DC5, 0x01000193, "UBIGINT") if bits == 32 else (0xCBF29CE484222325, 0x100000001B3, "HUGEINT")
    units = f"list_transform(string_split({text}, ''), lambda c: ord(c)::{kind})"
    return f"format('{{:0{bits // 4}x}}', list_reduce(list_prepend({offset}::{kind}, {units}), lambda h, x: (xor(h, x) * {prime}::{kind}) % {1 << bits}::{kind})::UBIGINT)"


@query("hsh1_fnv_32", f"SELECT c_custkey, {_fnv_sql('c_name', 32)} AS h FROM customer")
def hsh1(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", H.fnv1a_32(F.col("c_name")).alias("h"))


@query("hsh2_fnv_64", f"SELECT c_custkey, {_fnv_sql('c_name', 64)} AS h FROM customer")
def hsh2(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", H.fnv1a_64(F.col("c_name")).alias("h"))


_FIELDS = "coalesce(p_name, '') || ':::' || coalesce(p_brand, '') || ':::' || ':::' || 'size=' || p_size || ':::' || 'type=' || p_type"


@query("hsh3_record_fingerprint", f"SELECT p_partkey, {_fnv_sql(_FIELDS, 64)} AS fingerprint FROM part")
def hsh3(spark, sf_dir):
    more = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", H.record_fingerprint([F.col("p_name"), F.col("p_brand"), F.lit(None)], more).alias("fingerprint"))


@query("hsh4_occurrence_ids", f"SELECT p_partkey, 'record:' || f || ':' || row_number() OVER (PARTITION BY f ORDER BY p_partkey) AS record_id FROM (SELECT p_partkey, {_fnv_sql('p_brand', 64)} AS f FROM part)")
def hsh4(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("fp", H.record_fingerprint([F.col("p_brand")]))
    return S.occurrence_ids(part, "fp", ["p_partkey"]).select("p_partkey", "record_id")


@query("hsh6_stable_json", """SELECT doc_id, sha256(to_json(text)::VARCHAR) AS quoted, '{"a":[{"x":"' || lang || '","y":2}],"b":' || n_chars || '}' AS stable FROM documents""")
def hsh6(spark, sf_dir):
    raw = F.concat(F.lit('{ "b": '), F.col("n_chars").cast("string"), F.lit(', "a": [ {"y": 2, "x": "'), "lang", F.lit('"} ] }'))
    return table(spark, sf_dir, "documents").select("doc_id", H.quoted_sha256(F.col("text")).alias("quoted"), H.stable_json(raw).alias("stable"))


@query("hsh7_set_fingerprint", "SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR || ':' || o_orderstatus, chr(10) ORDER BY o_orderkey::VARCHAR || ':' || o_orderstatus)) AS fingerprint FROM orders GROUP BY 1")
def hsh7(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(H.set_fingerprint(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")).alias("fingerprint"))


@query("hsh9_git_blobs", "SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS sha1 FROM documents")
def hsh9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.git_blob_sha1(F.col("text")).alias("sha1"))


@query("hsh10_package_hashes", """SELECT 'd/' || doc_id AS path, CASE WHEN length(text) % 7 = 0 THEN 'CHANGED' WHEN lang = 'fr' THEN 'EXTRA' END AS finding FROM documents WHERE length(text) % 7 = 0 AND lang <> 'fr' OR lang = 'fr'""".replace("CASE WHEN length(text) % 7 = 0 THEN 'CHANGED' WHEN lang = 'fr' THEN 'EXTRA' END", "CASE WHEN lang = 'fr' THEN 'EXTRA' ELSE 'CHANGED' END"))
def hsh10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    stated = F.when(F.length("text") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    manifest = docs.where("lang <> 'fr'").select("path", stated.alias("sha256"))
    return A.verify_package(docs.select("path", F.col("text").cast("binary").alias("content")), manifest)


@query("hsh11_derived_ids", "SELECT l_orderkey, l_linenumber, 'derived-' || left(sha256(l_orderkey::VARCHAR || chr(0) || l_linenumber || chr(0) || l_returnflag), 16) AS id FROM lineitem")
def hsh11(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", H.content_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag"), prefix="derived-").alias("id"))


# Filters


@query("flt2_valid_entries", f"SELECT doc_id, CASE WHEN n_chars < 50 THEN 'MALFORMED_JSON' WHEN source = 'books' THEN 'MISSING_WORD' WHEN lang <> 'fr' THEN 'NOT_PERSIAN' WHEN NOT regexp_matches({_sql_fa('text')}, '\\p{{Arabic}}') THEN 'NO_ARABIC_SCRIPT' END AS reason FROM documents")
def flt2(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("source") != "books", _fa(F.col("text"))).alias("word"), F.when(F.col("lang") == "fr", "fa").otherwise(F.col("lang")).alias("lang_code"), F.when(F.col("n_chars") < 50, "{").alias("_corrupt_record"))
    return E.valid_entries(raw).select("doc_id", "reason")


@query("flt3_language_evidence", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FIELD_041' WHEN 'O' THEN CASE WHEN o_totalprice > 100000 THEN 'FIELD_008' END ELSE 'FIELD_546' END AS field FROM orders""")
def flt3(spark, sf_dir):
    status = F.col("o_orderstatus")
    fixed = F.when(status == "O", F.concat(F.lpad(F.lit(""), 35, "x"), F.when(F.col("o_totalprice") > 100000, "per").otherwise("eng")))
    evidence = E.language_evidence(F.when(status == "F", "engper"), fixed, F.when(status != "F", "In Persian."))
    return table(spark, sf_dir, "orders").select("o_orderkey", evidence.alias("field"))


@query("flt4_pair_scripts", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'ROMAN_ARABIC' WHEN p_size < 20 THEN 'ARABIC_ROMAN' WHEN p_size < 30 THEN 'BOTH_ARABIC' ELSE 'NO_ARABIC' END AS pair FROM part""")
def flt4(spark, sf_dir):
    size = F.col("p_size")
    a, b = F.when((size >= 10) & (size < 30), F.col("fa")).otherwise(F.col("p_name")), F.when((size < 10) | ((size >= 20) & (size < 30)), F.col("fa")).otherwise(F.col("p_name"))
    return _part(spark, sf_dir).select("p_partkey", E.pair_scripts(a, b).alias("pair"))


@query("flt5_field_profiles", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'ijmes_citation_title' WHEN p_size % 4 IN (1, 2) THEN 'ijmes_full' END AS profile FROM part""")
def flt5(spark, sf_dir):
    k = F.col("p_size") % 4
    path = F.when(k == 0, "title").when(k == 1, F.concat(F.lit("authors."), F.col("p_size").cast("string"), F.lit(".literal"))).when(k == 2, "publisher").otherwise("doi")
    return table(spark, sf_dir, "part").select("p_partkey", B.field_profile(path).alias("profile"))


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", _fa(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("fa"), F.regexp_replace("next_text", "[^A-Za-z]+", " ").alias("roman"))


_TURNS = """WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') ws FROM conversations), p AS (SELECT a.conv_id, a.turn, a.ws x, b.ws y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query("flt6_segment_eligibility", _TURNS + " SELECT conv_id, turn, CASE WHEN len(x) = len(y) THEN 'ELIGIBLE' ELSE 'COUNT_MISMATCH' END AS eligibility, CASE WHEN len(x) = len(y) THEN greatest(len(x), 1) ELSE 1 END::BIGINT AS n FROM p")
def flt6(spark, sf_dir):
    return E.positional_alignment(_turns(spark, sf_dir), "fa", "roman").groupBy("conv_id", "turn", "eligibility").agg(F.count("*").alias("n"))


@query("flt7_optional_predicate", "SELECT c_mktsegment, count(*) AS n, count_if(contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7')) AS found, count_if(contains(lower(c_mktsegment), 'build')) AS named FROM customer GROUP BY 1")
def flt7(spark, sf_dir):
    """Without a term every row passes, with one those that have it in some field."""
    among = lambda fields, term: F.count_if(S.search_any(fields, term))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(among(["c_name"], None).alias("n"), among(["c_name", "c_mktsegment"], "7").alias("found"), among(["c_mktsegment"], "BUILD").alias("named"))


@query("flt8_literal_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the.') OR contains(lower(source), 'the.') OR contains(lower(lang), 'the.')")
def flt8(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(S.search_any(["text", "source", "lang"], "The.")).select("doc_id")


@query("flt9_in_or_not", "SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS inside, o_orderstatus NOT IN ('F', 'P') AS outside FROM orders")
def flt9(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.in_or_not("o_orderstatus", ["F", "P"]).alias("inside"), S.in_or_not("o_orderstatus", ["F", "P"], True).alias("outside"))


@query("flt10_guarded_rows", "SELECT o_orderpriority, bool_or(o_orderstatus = 'P' AND o_totalprice < 20000) AS passes FROM orders GROUP BY 1")
def flt10(spark, sf_dir):
    """For each priority: whether a snapshot of its cheap open orders may be published, which without rows it may not."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    cheap = orders.where("o_orderstatus = 'P' AND o_totalprice < 20000")

    def passes(name):
        try:
            return V.require_rows(cheap.where(F.col("o_orderpriority") == name), "no rows").limit(1).count() == 1
        except Exception as why:
            if "no rows" not in str(why):
                raise
            return False

    names = [r[0] for r in orders.select("o_orderpriority").distinct().collect()]
    return spark.createDataFrame([(n, passes(n)) for n in names], "o_orderpriority string, passes boolean")


@query("flt11_governance", """SELECT o_orderkey, unnest(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN ['ADOPTED_WITHOUT_DECISION', 'REJECTED_BUT_ADOPTED'] WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN ['ADOPTED_WITHOUT_DECISION'] WHEN o_orderstatus = 'P' THEN ['UNKNOWN_STATUS'] ELSE [] END) AS violation FROM orders""")
def flt11(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "ADOPTED").when(F.col("o_orderstatus") == "O", "CANDIDATE").otherwise("STRANGE").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "ACCEPTED").when(F.col("o_orderpriority") == "5-LOW", "REJECTED").otherwise("OPEN").alias("adjudication"), (F.col("o_orderstatus") == "F").alias("adopted"))
    return V.violations(rows, A.governance(F.col("status"), F.col("adjudication"), F.col("adopted")), ["o_orderkey"])


@query("flt12_row_schema", """SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN NOT (l_quantity BETWEEN 1 AND 45) THEN 'QUANTITY' END, CASE WHEN NOT (l_returnflag = 'N' OR l_linestatus = 'F') THEN 'FLAGS' END], lambda x: x IS NOT NULL)) AS violation FROM lineitem""")
def flt12(spark, sf_dir):
    rules = [("QUANTITY", F.col("l_quantity").between(1, 45)), ("FLAGS", (F.col("l_returnflag") == "N") | (F.col("l_linestatus") == "F"))]
    return V.violations(table(spark, sf_dir, "lineitem"), rules, ["l_orderkey", "l_linenumber"])


# Lookups


def _lexicon(spark, sf_dir, *more):
    """A lexicon of the parts' first words: category by size, the brands as readings."""
    rows = _part(spark, sf_dir).groupBy(F.col("first").alias("normalized")).agg(F.array_sort(F.collect_set("p_type")).alias("canonicals"), F.min("p_type").alias("t"))
    category = F.when(F.col("t") == "ECONOMY", "noun").when(F.col("t") == "PROMO", "adjective").otherwise("proper-noun")
    return rows.select("normalized", category.alias("category"), "canonicals", F.array().cast("array<string>").alias("izafat_after"), *more)


_WORD_SQL = f"WITH w AS (SELECT {_FIRST} AS w, p_partkey, p_type, p_size FROM part), l AS (SELECT w, list_sort(list_distinct(list(p_type))) AS c FROM w GROUP BY 1)"


@query("jon1_lexicon_lookup", _WORD_SQL + " SELECT p_partkey, CASE WHEN len(c) > 1 THEN 'AMBIGUOUS' ELSE 'LEXICON_RESOLVED' END AS state, CASE WHEN len(c) = 1 THEN c[1] END AS canonical FROM w JOIN l USING (w)")
def jon1(spark, sf_dir):
    words = _part(spark, sf_dir).select("p_partkey", F.col("first").alias("lookup"))
    lexicon = _lexicon(spark, sf_dir).select(F.col("normalized").alias("form"), "canonicals")
    return R.cascade(words, "lookup", [("LEXICON", lexicon)]).select("p_partkey", "state", "canonical")


@query("jon2_fallback_lookup", "WITH e AS (SELECT user_id, event_type FROM events), p AS (SELECT event_type AS w, min(props) AS h FROM events GROUP BY 1 HAVING count(*) > 10) SELECT event_type, CASE WHEN h IS NULL THEN 'UNRESOLVED' ELSE 'LEXICON_RESOLVED' END AS state, max(h) AS canonical, count(*) AS n FROM e LEFT JOIN p ON event_type = w GROUP BY 1, 2")
def jon2(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "props")
    pack = events.groupBy(F.col("event_type").alias("form")).agg(F.min("props").alias("h"), F.count("*").alias("n")).where("n > 10").select("form", F.array("h").alias("canonicals"))
    return R.cascade(events, "event_type", [("FALLBACK", pack)]).groupBy("event_type", "state").agg(F.max("canonical").alias("canonical"), F.count("*").alias("n"))


_AUTHORITY = """WITH e AS (SELECT DISTINCT lower(p_brand) AS b, p_type, CASE WHEN p_size > 25 THEN 'PERSON_NAME' ELSE 'TITLE' END AS c, p_name AS v FROM part),
f AS (SELECT p.p_partkey, list_sort(list_distinct(list(v) FILTER (WHERE c = 'TITLE'))) AS a, list_sort(list_distinct(list(v) FILTER (WHERE c = 'PERSON_NAME'))) AS z FROM part p LEFT JOIN e ON e.b = lower(p.p_brand) AND e.p_type = p.p_type GROUP BY 1),
g AS (SELECT p_partkey, CASE WHEN len(a) > 0 THEN a ELSE coalesce(z, []) END AS x FROM f)"""


def _published(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entries = part.select(F.lower("p_brand").alias("normalized"), F.col("p_type").alias("profile"), F.when(F.col("p_size") > 25, "PERSON_NAME").otherwise("TITLE").alias("context"), F.lit("PUBLISHED").alias("status"), F.col("p_name").alias("canonical")).distinct()
    phrases = part.select(F.col("p_partkey").alias("phrase_id"), F.lower("p_brand").alias("normalized"), F.col("p_type").alias("profile"), F.lit("TITLE").alias("context"))
    return R.published_authority(phrases, entries)


@query("jon3_phrase_authority", _AUTHORITY + " SELECT p_partkey AS phrase_id, CASE len(x) WHEN 0 THEN 'NONE' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS state FROM g")
def jon3(spark, sf_dir):
    return _published(spark, sf_dir).select("phrase_id", "state")


@query("jon4_context_fallback", _AUTHORITY + " SELECT p_partkey AS phrase_id, CASE WHEN len(x) = 1 THEN x[1] END AS canonical FROM g")
def jon4(spark, sf_dir):
    return _published(spark, sf_dir).select("phrase_id", "canonical")


@query("msc1_published_result", _AUTHORITY + " SELECT p_partkey AS phrase_id, len(x) = 1 AS copyable FROM g")
def msc1(spark, sf_dir):
    return _published(spark, sf_dir).select("phrase_id", "copyable")


def _titles(spark, sf_dir):
    """Token rows of the parts' names in Persian letters."""
    return R.token_table(_part(spark, sf_dir).select(F.col("p_partkey").alias("doc"), "fa"), "doc", "fa")


_PAIRS = f"WITH n AS (SELECT p_partkey AS doc, string_split({_NAME}, ' ') AS ws FROM part)"


@query("txt2_token_table", f"""WITH n AS (SELECT p_partkey AS doc, string_split({_NAME}, ' ') AS ws FROM part),
w AS (SELECT doc, ws, unnest(range(1, len(ws) + 1)) AS i FROM n), t AS (SELECT doc, i, ws[i] AS surface, coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x)))::BIGINT, 0) + i - 1 AS start, i < len(ws) AS more FROM w)
SELECT doc, (2 * i - 2)::INT AS idx, surface, start::INT AS start, 'persian-word' AS class FROM t UNION ALL SELECT doc, (2 * i - 1)::INT, ' ', (start + length(surface))::INT, 'whitespace' FROM t WHERE more""")
def txt2_table(spark, sf_dir):
    return _titles(spark, sf_dir).select("doc", "idx", "surface", F.col("start").cast("int").alias("start"), "class")


@query("jon6_next_word", _PAIRS + " SELECT doc, ws[1] AS surface, ws[2] AS next_surface FROM n WHERE len(ws) > 1")
def jon6(spark, sf_dir):
    return R.next_word(_titles(spark, sf_dir), "doc").select("doc", "surface", "next_surface")


@query("win4_lookahead", _PAIRS + " SELECT doc, 0 AS src_idx, 2 AS next_idx FROM n WHERE len(ws) > 1")
def win4(spark, sf_dir):
    return R.next_word(_titles(spark, sf_dir), "doc").select("doc", "src_idx", "next_idx")


_LEX = f", x AS (SELECT {_FIRST} AS w, list_distinct(list(p_type)) AS c, CASE min(p_type) WHEN 'ECONOMY' THEN 'noun' WHEN 'PROMO' THEN 'adjective' ELSE 'proper-noun' END AS cat FROM part GROUP BY 1)"


@query("jon7_context_pairs", _PAIRS + " SELECT doc, 'CURATED_LEXICAL_CONTEXT' AS relation, 'CONFIRMED' AS status FROM n WHERE len(ws) > 1")
def jon7(spark, sf_dir):
    part = _part(spark, sf_dir)
    second = _fa(F.split_part("p_name", F.lit(" "), F.lit(2)))
    lexicon = part.groupBy(F.col("first").alias("normalized")).agg(F.lit("noun").alias("category"), F.array(F.min("p_type")).alias("canonicals"), F.collect_set(second).alias("izafat_after"))
    return R.relations(_titles(spark, sf_dir), lexicon, "doc").select("doc", "relation", "status")


def _grammar(spark, sf_dir):
    part = _part(spark, sf_dir)
    firsts = part.select(F.col("first").alias("normalized"), F.lit("noun").alias("category"))
    seconds = part.select(_fa(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("normalized"), F.lit("adjective").alias("category"))
    words = firsts.unionByName(seconds).groupBy("normalized").agg(F.max("category").alias("category"))
    return words.select("normalized", "category", F.array("normalized").alias("canonicals"), F.array().cast("array<string>").alias("izafat_after"))


_GRAMMAR = _PAIRS + ", c AS (SELECT w, max(cat) AS cat FROM (SELECT ws[1] AS w, 'noun' AS cat FROM n UNION ALL SELECT ws[2], 'adjective' FROM n) GROUP BY 1)"


@query("dom7_grammatical_relations", _GRAMMAR + " SELECT doc, 'GRAMMATICAL_CANDIDATE' AS relation, 'CANDIDATE' AS status FROM n JOIN c ON c.w = ws[1] AND c.cat = 'noun' WHERE len(ws) > 1")
def dom7(spark, sf_dir):
    return R.relations(_titles(spark, sf_dir), _grammar(spark, sf_dir), "doc").select("doc", "relation", "status")


def _suffixed(spark, sf_dir):
    """Names' first words, by size with a plural, a comparative or nothing after a joiner."""
    tail = F.when(F.col("p_size") < 15, "‌ها").when(F.col("p_size") < 30, "‌تر").otherwise("")
    return _part(spark, sf_dir).select("p_partkey", F.concat("first", tail).alias("form"), "first", "p_size")


def _proposals(spark, sf_dir):
    part = _part(spark, sf_dir)
    lexicon = part.select(F.col("first").alias("normalized"), F.lit("noun").alias("category"), F.array(F.lit("kitāb")).alias("canonicals")).distinct()
    return R.suffix_proposals(_suffixed(spark, sf_dir), "form", lexicon), lexicon


#: The suffix rules, in order, and every form that any of them fits, judged as the operator's docstrings state.
_SUFFIX_ROWS = ", ".join(f"({k}, '{x}', '{t}', {'noun' in h}, '{r}', {c}, {j})" for k, (x, t, h, r, c, j) in enumerate(R.SUFFIXES))
_SUFFIXED = f"""WITH rules(ord, suffix, type, nouns, rendering, consonant, joinerless) AS (VALUES {_SUFFIX_ROWS}),
lex AS (SELECT DISTINCT {_FIRST} AS w FROM part), forms AS (SELECT DISTINCT {_FIRST} || CASE WHEN p_size < 15 THEN chr(8204) || 'ها' WHEN p_size < 30 THEN chr(8204) || 'تر' ELSE '' END AS form FROM part),
fit AS (SELECT *, NOT ends_with(form, suffix) AS izafat FROM forms, rules WHERE (ends_with(form, suffix) OR ends_with(form, suffix || 'ی')) AND length(form) > length(suffix)),
cut AS (SELECT *, left(form, length(form) - length(suffix) - izafat::INT) AS body FROM fit WHERE NOT izafat OR suffix = 'ها'),
host AS (SELECT *, ends_with(body, chr(8204)) AS joiner, CASE WHEN ends_with(body, chr(8204)) THEN left(body, length(body) - 1) ELSE body END AS stem FROM cut),
seen AS (SELECT h.*, s.w IS NOT NULL AS known, f.w IS NOT NULL AS whole FROM host h LEFT JOIN lex s ON s.w = stem LEFT JOIN lex f ON f.w = form WHERE length(stem) > 0),
t AS (SELECT *, CASE WHEN known AND NOT nouns THEN 'CONFLICT' WHEN known AND nouns AND (NOT consonant OR NOT ends_with(stem, 'ه')) AND (joiner OR joinerless) AND NOT whole THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS status FROM seen WHERE NOT (whole AND NOT known)),
p AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY CASE status WHEN 'CONFIRMED' THEN 0 WHEN 'CONFLICT' THEN 1 ELSE 2 END, length(stem) DESC, ord)::INT AS rank FROM t)"""


@query("jon8_suffix_rules", _SUFFIXED + " SELECT form, suffix, stem FROM p")
def jon8(spark, sf_dir):
    return _proposals(spark, sf_dir)[0].select("form", "suffix", "stem")


@query("dom1_suffix_status", _SUFFIXED + " SELECT form, type, status FROM p")
def dom1(spark, sf_dir):
    return _proposals(spark, sf_dir)[0].select("form", "type", "status")


@query("win8_best_proposal", _SUFFIXED + " SELECT form, suffix, rank FROM p")
def win8(spark, sf_dir):
    return _proposals(spark, sf_dir)[0].select("form", "suffix", "rank")


@query("dom3_suffix_resolution", _SUFFIXED + " SELECT form, CASE WHEN whole AND known THEN 'AMBIGUOUS' WHEN status = 'CONFIRMED' THEN 'LEXICON_RESOLVED' ELSE 'UNRESOLVED' END AS state, CASE WHEN NOT (whole AND known) AND status = 'CONFIRMED' THEN 'kitāb-' || rendering END AS canonical FROM p WHERE rank = 1")
def dom3(spark, sf_dir):
    best, lexicon = _proposals(spark, sf_dir)
    return R.resolve_suffix(best, lexicon).select("form", "state", "canonical")


@query("dom2_strength", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'BLOCKED_BY_EXPLICIT_EVIDENCE' WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_totalprice > 100000 THEN 'CONFIRMED_REVIEWED' ELSE 'CANDIDATE_SHAPE_ONLY' END
WHEN o_orderpriority = '5-LOW' THEN 'UNSUPPORTED_OR_AMBIGUOUS' WHEN o_totalprice > 100000 THEN 'COMPETING_REVIEWED' ELSE 'CANDIDATE_SHAPE_ONLY' END AS strength FROM orders""")
def dom2(spark, sf_dir):
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "CONFIRMED").when(F.col("o_orderpriority") == "5-LOW", "CONFLICT").otherwise("CANDIDATE")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.morphology_strength(status, F.col("o_totalprice") > 100000, F.lit(False), F.col("o_orderstatus") == "P").alias("strength"))


@query("dom4_vocalization", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'O' THEN 'INSUFFICIENT' ELSE 'CONFLICT' END AS outcome, CASE o_orderstatus WHEN 'F' THEN 'kitab' WHEN 'O' THEN 'kitab' ELSE 'kitab,kutub' END AS canonicals FROM orders""")
def dom4(spark, sf_dir):
    mapped = lambda *x: F.create_map(*map(F.lit, x))
    one = F.when(F.col("o_orderstatus") == "F", mapped("0", "i", "1", "a")).when(F.col("o_orderstatus") == "O", mapped("1", "a")).otherwise(mapped("0", "u"))
    readings = F.array(F.struct(F.lit("kitab").alias("canonical"), one.alias("vocalization")), F.struct(F.lit("kutub").alias("canonical"), mapped("0", "u", "1", "u").alias("vocalization")))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.vocalized_outcome(readings, mapped("0", "i")).alias("v")).select("o_orderkey", "v.outcome", F.array_join("v.canonicals", ",").alias("canonicals"))


@query("dom5_token_resolution", _WORD_SQL + " SELECT CASE WHEN len(c) > 1 THEN 'AMBIGUOUS' ELSE 'LEXICON_RESOLVED' END AS state, 'LEXICON' AS source, count(*) AS n FROM w JOIN l USING (w) GROUP BY 1")
def dom5(spark, sf_dir):
    words = _part(spark, sf_dir).select("p_partkey", F.col("first").alias("lookup"))
    empty = spark.createDataFrame([], "form string, canonicals array<string>")
    lexicon = _lexicon(spark, sf_dir).select(F.col("normalized").alias("form"), "canonicals")
    return R.cascade(words, "lookup", [("AUTHORITY", empty), ("LEXICON", lexicon)]).groupBy("state", "source").agg(F.count("*").alias("n"))


def _tokens(spark, sf_dir):
    """Order rows as tokens before routing."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    strength = F.when(F.col("o_orderpriority") == "1-URGENT", "CONFIRMED_REVIEWED").when(F.col("o_orderpriority") == "2-HIGH", "COMPETING_REVIEWED").when(F.col("o_orderpriority") == "3-MEDIUM", "CANDIDATE_SHAPE_ONLY")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(status == "F", "LEXICON_RESOLVED").alias("whole_state"), F.when(status == "F", "whole").alias("whole_canonical"), strength.alias("strength"),
        F.when(strength == "CONFIRMED_REVIEWED", "LEXICON_RESOLVED").when(strength.isNotNull(), "UNRESOLVED").alias("morph_state"), F.when(strength == "CONFIRMED_REVIEWED", "stem-suffix").alias("morph_canonical"),
        F.when(price > 200000, "proposal").alias("fallback"), (price < 20000).alias("marks"), (price.between(20000, 40000)).alias("vowels"))


_TOKENS = """WITH t AS (SELECT o_orderkey, o_orderstatus = 'F' AS whole, CASE o_orderpriority WHEN '1-URGENT' THEN 'C' WHEN '2-HIGH' THEN 'R' WHEN '3-MEDIUM' THEN 'S' END AS m, o_totalprice > 200000 AS fb, o_totalprice < 20000 AS marks, o_totalprice BETWEEN 20000 AND 40000 AS vowels FROM orders)"""


@query("dom6_production_routing", _TOKENS + " SELECT o_orderkey, CASE WHEN m = 'C' THEN 'LEXICON_RESOLVED' WHEN m IS NOT NULL THEN 'UNRESOLVED' WHEN marks THEN 'UNRESOLVED' WHEN whole THEN 'LEXICON_RESOLVED' ELSE 'UNRESOLVED' END AS state, CASE WHEN m IS NULL AND NOT marks AND NOT whole AND fb THEN 'proposal' END AS proposal FROM t")
def dom6(spark, sf_dir):
    return R.routed(_tokens(spark, sf_dir)).select("o_orderkey", "state", "proposal")


@query("dom6_safe_routing", _TOKENS + """ SELECT o_orderkey, CASE WHEN whole THEN CASE WHEN marks THEN 'UNRESOLVED' ELSE 'LEXICON_RESOLVED' END WHEN m = 'C' THEN 'LEXICON_RESOLVED' ELSE 'UNRESOLVED' END AS state,
CASE WHEN whole AND marks THEN 'UNSUPPORTED_ORTHOGRAPHIC_EVIDENCE' WHEN whole OR m = 'C' THEN NULL WHEN m = 'R' THEN CASE WHEN fb THEN 'WHOLE_WORD_FALLBACK_MORPHOLOGY_COMPETITION' END WHEN m = 'S' THEN CASE WHEN fb AND NOT vowels AND NOT marks THEN 'NO_LEXICAL_ENTRY' END
WHEN marks THEN 'UNSUPPORTED_ORTHOGRAPHIC_EVIDENCE' WHEN vowels THEN 'INSUFFICIENT_VOCALIZATION' ELSE 'NO_LEXICAL_ENTRY' END AS blocking FROM t""")
def dom6_safe(spark, sf_dir):
    return R.routed(_tokens(spark, sf_dir), "SAFE_WHOLE_WORD_EVIDENCE").select("o_orderkey", "state", "blocking")


def _issues(spark, sf_dir):
    routed = R.routed(_tokens(spark, sf_dir), "SAFE_WHOLE_WORD_EVIDENCE")
    marked = F.when(F.col("marks"), F.array(F.lit("x"))).otherwise(F.array()).cast("array<string>")
    cut = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = routed.join(cut, "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("start"), F.lit("w").alias("surface"), "state", "blocking", "proposal", marked.alias("unsupported_marks"), F.lit(None).cast("string").alias("morph_status"))
    return R.review_issues(rows, "o_custkey")


_ISSUES = _TOKENS + """, s AS (SELECT o_orderkey, marks, (whole OR coalesce(m, '') = 'C') AS ok, CASE WHEN m IS NULL AND NOT marks AND vowels THEN 'INSUFFICIENT_VOCALIZATION' WHEN fb AND (m IS NULL OR m IN ('R', 'S')) THEN 'EVIDENCE_DERIVED_READING' ELSE 'UNKNOWN_TOKEN' END AS k, whole FROM t),
i AS (SELECT o_orderkey, CASE WHEN marks THEN 'UNSUPPORTED_ORTHOGRAPHIC_EVIDENCE' ELSE k END AS issue_type FROM s WHERE NOT ok OR whole AND marks)"""


@query("dom8_review_issues", _ISSUES + " SELECT o_orderkey AS idx, issue_type FROM i")
def dom8(spark, sf_dir):
    return _issues(spark, sf_dir).select("idx", "issue_type")


@query("dom8_issue_ids", _ISSUES + " SELECT count(*) AS issues, count(*) AS ids FROM i")
def dom8_ids(spark, sf_dir):
    """Documents that differ share no id, though all their words look alike."""
    return _issues(spark, sf_dir).agg(F.count("*").alias("issues"), F.count_distinct("issue_id").alias("ids"))


@query("srt6_issues_in_order", _ISSUES + " SELECT o_custkey, string_agg(issue_type, ',' ORDER BY o_orderkey) AS issues FROM i JOIN orders USING (o_orderkey) GROUP BY 1")
def srt6(spark, sf_dir):
    return R.in_order(_issues(spark, sf_dir), "o_custkey").select("o_custkey", F.array_join(F.transform("issues", lambda x: x["issue_type"]), ",").alias("issues"))


def _decisions(spark, sf_dir):
    tokens = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("int").alias("idx"), F.col("o_orderpriority").alias("lookup"), F.when(F.col("o_orderstatus") == "F", "AMBIGUOUS").otherwise("LEXICON_RESOLVED").alias("state"), F.lit(None).cast("string").alias("canonical"), F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("issue_id"))
    first = tokens.where("state = 'AMBIGUOUS'").groupBy("o_custkey").agg(F.min_by("issue_id", "idx").alias("issue_id"))
    return tokens, first.select("o_custkey", "issue_id", F.lit("ACCEPT").alias("action"), F.lit("chosen").alias("value"))


@query("dom9_decisions", """WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey AS idx, CASE WHEN o_orderstatus <> 'F' THEN 'LEXICON_RESOLVED' WHEN o_orderpriority = p THEN 'USER_OVERRIDE' ELSE 'AMBIGUOUS' END AS state FROM orders LEFT JOIN f USING (o_custkey)""")
def dom9(spark, sf_dir):
    return R.apply_decisions(*_decisions(spark, sf_dir), "o_custkey").select(F.col("idx").cast("long").alias("idx"), "state")


@query("jon9_stale_decisions", "SELECT 'i' || min(o_orderkey) AS issue_id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING min(o_totalprice) IS NOT NULL AND arg_min(o_totalprice, o_orderkey) < 100000")
def jon9(spark, sf_dir):
    _, given = _decisions(spark, sf_dir)
    issues = table(spark, sf_dir, "orders").where("o_totalprice >= 100000").select(F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("issue_id"))
    return R.stale_decisions(given, issues).select("issue_id")


@query("agg33_document_status", """SELECT o_custkey, CASE max(CASE WHEN o_totalprice < 50000 THEN 3 WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END) WHEN 3 THEN 'UNRESOLVED' WHEN 2 THEN 'AMBIGUOUS' ELSE 'LEXICON_RESOLVED' END AS status FROM orders GROUP BY 1""")
def agg33(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    tokens = orders.select("o_custkey", F.when(F.col("o_totalprice") < 50000, "UNRESOLVED").otherwise("LEXICON_RESOLVED").alias("state"))
    found = orders.select("o_custkey", F.when(F.col("o_orderstatus") == "F", "CANDIDATE").otherwise("CONFIRMED").alias("status"))
    return R.document_status(tokens, "o_custkey", "state", found)


@query("dom21_canonical_output", "SELECT o_custkey, string_agg(o_orderstatus || CASE WHEN o_totalprice > 200000 THEN '-i' ELSE '' END, '' ORDER BY o_orderkey) AS rendered FROM orders GROUP BY 1")
def dom21(spark, sf_dir):
    tokens = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("idx"), "o_orderstatus", "o_totalprice")
    marks = tokens.where("o_totalprice > 200000").select("o_custkey", F.col("idx").alias("src_idx"), F.lit("-i").alias("mark"))
    return R.render_documents(tokens.select("o_custkey", "idx", "o_orderstatus"), "o_custkey", "o_orderstatus", marks)


@query("dom22_reading_alignment", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'UNIQUE' WHEN 'O' THEN 'AMBIGUOUS' ELSE 'NONE' END AS state FROM orders""")
def dom22(spark, sf_dir):
    status = F.col("o_orderstatus")
    readings = F.array(F.array(F.lit("a"), F.when(status == "O", "a").otherwise("b")), F.array(F.lit("c")))
    target = F.when(status == "P", "a d").otherwise("a c")
    return table(spark, sf_dir, "orders").select("o_orderkey", A.align_readings(F.array(F.lit("x"), F.lit("y")), readings, target)["state"].alias("state"))


@query("agg24_accuracy", """WITH r AS (SELECT o_orderkey, lower(o_orderpriority) = lower(p) AS norm, o_orderpriority = p AS exact, p = 'other' AS alt, p FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_totalprice < 50000 THEN lower(o_orderpriority) WHEN o_totalprice < 100000 THEN 'other' END AS p FROM orders))
SELECT count(*) AS cases, count(p) AS answered, count_if(exact) AS exact, count_if(exact OR alt) AS accepted, count_if(norm) AS normalized FROM r""")
def agg24(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    refs = orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("canonical"), F.array(F.lit("other")).alias("alternatives"))
    guess = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(F.col("o_totalprice") < 50000, F.lower("o_orderpriority")).when(F.col("o_totalprice") < 100000, "other")
    return C.accuracy(refs, orders.select(F.col("o_orderkey").alias("case_id"), guess.alias("proposal")).where("proposal IS NOT NULL")).drop("exact_interval")


_GRADED = """WITH c AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS scorable, o_orderpriority AS canonical, o_totalprice AS price, o_orderstatus FROM orders),
k AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'missing_prediction' WHEN id % 13 = 1 THEN 'provider_failure' WHEN id % 13 = 2 THEN 'timeout' WHEN id % 13 = 3 THEN 'invalid_prediction' END AS failed,
  CASE WHEN price > 200000 THEN canonical WHEN price > 100000 THEN lower(canonical) WHEN price > 50000 THEN ' ' || canonical || '  ' ELSE 'other' END AS proposal FROM c),
t AS (SELECT l_orderkey AS id, l_linenumber AS idx, min(l_returnflag) AS canonical, CASE WHEN max(l_quantity) <= 5 THEN NULL WHEN max(l_discount) > 0.08 THEN 'X' ELSE min(l_returnflag) END AS reading FROM lineitem GROUP BY 1, 2),
ks AS (SELECT * FROM k WHERE scorable), ts AS (SELECT t.*, failed FROM t JOIN ks USING (id)),
un AS (SELECT id, bool_or(reading IS NULL) AS un FROM t GROUP BY 1)"""


def _graded(spark, sf_dir):
    """Orders as cases whose tokens are their lines, and predictions that go wrong by the columns."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key, price, name = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    line = line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"), F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    lines = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("idx"), F.col("l_linestatus").alias("surface"), F.col("l_returnflag").alias("canonical"))).alias("tokens"),
        F.collect_list(F.when(F.col("l_quantity") > 5, F.struct(F.col("l_linenumber").alias("idx"), F.col("l_linestatus").alias("surface"), F.when(F.col("l_discount") > 0.08, "X").otherwise(F.col("l_returnflag")).alias("canonical")))).alias("read"),
    )
    rows = orders.join(lines, "o_orderkey", "left")
    kind = F.array(F.struct(F.lit("f1").alias("id"), F.col("o_orderstatus").alias("kind"), name.alias("expected")), F.struct(F.lit("f2").alias("id"), F.lit("HAMZA").alias("kind"), F.lit("x").alias("expected")))
    truth = F.create_map(F.lit("STRUCTURAL"), key % 2 == 0, F.lit("IJMES_POLICY"), F.when(key % 3 > 0, key % 3 == 1))
    cases = rows.select(key.alias("case_id"), (F.col("o_orderstatus") != "P").alias("scorable"), name.alias("canonical"), F.array(F.lit("other")).alias("alternatives"), F.coalesce("tokens", F.array().cast(dict(rows.dtypes)["tokens"])).alias("tokens"), kind.alias("features"), truth.alias("truth"))
    proposal = F.when(price > 200000, name).when(price > 100000, F.lower(name)).when(price > 50000, F.concat(F.lit(" "), name, F.lit("  "))).otherwise("other")
    signal = F.array_compact(F.array(F.when(key % 5 == 0, F.struct(F.lit("STRUCTURAL").alias("layer"), F.lit("BLOCK").alias("severity"))), F.when(key % 7 == 0, F.struct(F.lit("STRUCTURAL").alias("layer"), F.lit("INFO").alias("severity")))))
    predictions = rows.where(key % 13 != 0).select(
        key.alias("case_id"), F.when(key % 13 == 1, "PROVIDER_FAILURE").when(key % 13 == 2, "TIMEOUT").otherwise("ANSWER").alias("class"), (key % 13 != 3).alias("valid"), proposal.alias("proposal"), F.col("read").alias("tokens"),
        F.when(price > 100000, F.create_map(F.lit("f1"), name)).otherwise(F.create_map(F.lit("f1"), F.lit("y"))).alias("features"), signal.alias("signals"),
    )
    return A2.counters(cases, predictions)


@query("agg24_counters", f"""{_GRADED},
r AS (SELECT 'flow' AS part, '' AS name, 'excluded' AS measure, 1 AS n FROM k WHERE NOT scorable
UNION ALL SELECT 'flow', '', coalesce(failed, CASE WHEN un THEN 'unalignable' ELSE 'evaluated' END), 1 FROM ks LEFT JOIN un USING (id)
UNION ALL SELECT 'phrase', '', unnest(list_filter(['exact', CASE WHEN price > 200000 OR price <= 50000 THEN 'accepted' END, CASE WHEN price > 200000 OR price <= 100000 THEN 'normalized' END, CASE WHEN price > 50000 AND price <= 200000 THEN 'case_only' END], lambda m: m IS NOT NULL AND (m <> 'exact' OR price > 200000))), 1 FROM ks WHERE failed IS NULL
UNION ALL SELECT 'token', '', 'eligible', 1 FROM ts UNION ALL SELECT 'token', '', 'unsuccessful', 1 FROM ts WHERE failed IS NOT NULL
UNION ALL SELECT 'token', '', CASE WHEN reading IS NULL THEN 'unalignable' WHEN reading = canonical THEN 'correct' ELSE 'incorrect' END, 1 FROM ts WHERE failed IS NULL
UNION ALL SELECT 'feature', o_orderstatus, CASE WHEN failed IS NOT NULL THEN 'unevaluable' WHEN price > 100000 THEN 'correct' ELSE 'incorrect' END, 1 FROM ks UNION ALL SELECT 'feature', 'HAMZA', 'unevaluable', 1 FROM ks)
SELECT part, name, measure, sum(n)::BIGINT AS n FROM r GROUP BY 1, 2, 3""")
def agg24_counters(spark, sf_dir):
    return _graded(spark, sf_dir).where("part <> 'validator'")


@query("agg24_validator_layers", f"""{_GRADED},
v AS (SELECT unnest(['STRUCTURAL', 'DETERMINISTIC_CONSISTENCY', 'IJMES_POLICY', 'LINGUISTIC_REVIEW']) AS layer, * FROM ks),
j AS (SELECT layer, failed IS NULL AS ok, CASE layer WHEN 'STRUCTURAL' THEN id % 2 = 0 WHEN 'IJMES_POLICY' THEN CASE WHEN id % 3 > 0 THEN id % 3 = 1 END END AS truth, layer = 'STRUCTURAL' AND id % 5 = 0 AS flagged FROM v),
m AS (SELECT layer, count_if(ok AND truth AND flagged) AS detected, count_if(ok AND truth AND NOT flagged) AS missed, count_if(ok AND NOT truth AND flagged) AS false_warning, count_if(ok AND NOT truth AND NOT flagged) AS unflagged, count_if(NOT ok OR truth IS NULL) AS uncertain FROM j GROUP BY 1)
SELECT *, detected + missed + false_warning + unflagged > 0 AS measurable, detected / nullif(detected + false_warning, 0) AS precision, detected / nullif(detected + missed, 0) AS recall FROM m""")
def agg24_layers(spark, sf_dir):
    return A2.validator_matrices(_graded(spark, sf_dir))


@query("jon26_unanswered_cases", """SELECT count(*) AS cases, count_if(o_orderstatus = 'F') AS answered FROM orders""")
def jon26(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    refs = orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("canonical"), F.array().cast("array<string>").alias("alternatives"))
    return C.accuracy(refs, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("proposal"))).select("cases", "answered")
