import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import bibliography as B
from textloom.operators import evidence as E
from textloom.sources import csv_strict as C
from textloom.sources import records as R
from textloom.sources import remote, sinks


@pytest.mark.parametrize("text,rows,errors", [
    ('﻿a,b\r\n"x, ""y""",2\n\n', [["a", "b"], ['x, "y"', "2"]], 0), ("a\n\"p\nq\"\n", [["a"], ["p\nq"]], 0), ("a,b\n1\n", [["a", "b"], ["1"]], 1), ('a\nx"y\n', [["a"], ['x"y']], 1), ('a\n"x', [["a"], ["x"]], 1), ("", [], 0), ("a,b\r1,2", [["a", "b"], ["1", "2"]], 0),
])
def test_parse_csv(text, rows, errors):
    got, problems = C.parse_csv(text)
    assert got == rows and len(problems) == errors


def test_import_and_export(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Record_ID,type,Title,Authors,year,Extra\nr1,book,One & two,A | B,1999,x\n,article,Two,,2001,y\n,weird,,C,2002,\n", encoding="utf-8")
    rows = C.read_strict(spark, str(tmp_path / "in"))
    assert rows.where("row = 0").first()["errors"] == []
    records = C.import_records(rows)
    got = {r["row"]: r for r in records.collect()}
    assert got[1]["record_id"] == "r1" and got[1]["authors"] == ["A", "B"] and got[1]["type"] == "BOOK" and got[1]["passthrough"] == {"Extra": "x"}
    assert got[2]["record_id"].startswith("record:") and got[3]["diagnostics"] == ["MISSING_TITLE", "UNKNOWN_RECORD_TYPE"]
    fields = B.long_fields(records).select("record_id", "path", "source_text", F.lit("PASSTHROUGH").alias("status"), F.col("source_text").alias("final_text"), F.lit(0).alias("issues"))
    processed = B.readiness(records, fields)
    assert {r.readiness: r["n"] for r in processed.groupBy("readiness").agg(F.count("*").alias("n")).collect()} == {"READY": 2, "INVALID": 1}
    findings = B.export_findings(records, fields)
    assert findings.count() == 0
    ready, skipped = B.gate(processed, findings, "READY_ONLY")
    assert ready.count() == 2 and skipped.count() == 1
    assert B.gate(processed, findings, "STRICT_ALL")[0].count() == 0
    blocks = {r.record_id: r.block for r in B.ris(ready, fields).collect()}
    assert blocks["r1"] == "TY  - BOOK\r\nTI  - One & two\r\nAU  - A\r\nAU  - B\r\nPY  - 1999\r\nER  - "
    entries = {r.record_id: r.entry for r in B.bibtex(ready, fields).collect()}
    assert entries["r1"] == "@book{pst_r1,\n  title = {One \\& two},\n  author = {A and B},\n  year = {1999}\n}"
    lines = {r.record_id: r.line for r in B.final_csv(ready, fields, ["title", "authors", "year"]).collect()}
    assert lines["r1"] == "One & two,A | B,1999,x"
    review = {r.record_id: r.line for r in B.review_csv(processed).collect()}
    assert review["r1"] == "r1,book,One & two,A | B,1999,x,r1,READY,0,"
    sinks.write_blocks(B.ris(ready, fields), "block", str(tmp_path / "ris"))
    assert B.batch_summary(processed).first().asDict() == {"total": 3, "ready": 2, "review_required": 0, "invalid": 1}


def test_key_collision_is_marked(spark):
    base = spark.createDataFrame([("a-b", "t"), ("a_b", "t"), ("c", "t")], "record_id string, title string")
    none = {c: F.lit(None).cast("string") for c in ("type", "containerTitle", "publisher", "place", "year", "volume", "issue", "pageStart", "pageEnd", "doi", "url", "isbn", "issn", "language", "notes")}
    lists = {c: F.array().cast("array<string>") for c in ("authors", "editors", "translators")}
    records = base.withColumns({**none, **lists})
    fields = B.long_fields(records).withColumn("final_text", F.col("source_text"))
    assert {r.record_id: r.collision for r in B.bibtex(records, fields).collect()} == {"a-b": True, "a_b": True, "c": False}


def test_dictionary_to_pack(spark, tmp_path):
    def entry(word, roman, tags, **more):
        return json.dumps({"word": word, "lang_code": "fa", "pos": "noun", "forms": [{"form": r, "tags": ["romanization", *t]} for r, t in zip(roman, tags)], "senses": [{"glosses": ["x"]}], **more}, ensure_ascii=False)

    lines = [entry("کتاب", ["ketâb", "kitāb"], [["Iran"], ["Dari"]]), entry("باد", ["bâd"], [["Iran"]]), entry("سر", [], []), "{broken", entry("x", [], []), entry("شب", ["shab"], [[]]), entry("بن", ["bon"], [["Iran"]], senses=[{"form_of": [{"word": "y"}]}])]
    (tmp_path / "d.jsonl").write_text("\n".join(lines), encoding="utf-8")
    raw = E.valid_entries(R.dictionary(spark, str(tmp_path / "d.jsonl")))
    assert {r["reason"]: r["n"] for r in raw.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {None: 5, "MALFORMED_JSON": 1, "NO_ARABIC_SCRIPT": 1}
    done = E.interpret(E.observations(raw.where("reason IS NULL")))
    got = {(r.normalized, r.romanization): (r.status, r.hypothesis) for r in done.collect()}
    assert got == {("کتاب", "ketâb"): ("DETERMINISTIC_EQUIVALENT", "kitāb"), ("کتاب", "kitāb"): ("DIRECT_EQUIVALENT", "kitāb"), ("باد", "bâd"): ("DETERMINISTIC_EQUIVALENT", "bād"), ("سر", None): ("UNSUPPORTED", None), ("شب", "shab"): ("CONTEXT_REQUIRED", None), ("بن", "bon"): ("CONTEXT_REQUIRED", None)}
    pack = {r.normalized: (r.hypothesis, r.consensus, r.tier) for r in E.fallback_pack(done).collect()}
    assert pack == {"کتاب": ("kitāb", "UNANIMOUS_DETERMINISTIC", "CROSS_PROFILE_CONSENSUS"), "باد": ("bād", "UNANIMOUS_DETERMINISTIC", "SINGLE_OBSERVATION_DETERMINISTIC")}
    head = sinks.write_pack(E.fallback_pack(done), "normalized", str(tmp_path / "pack")).first()
    assert head["bytes"] > 0 and len(head["semantic_sha256"]) == 64
    with pytest.raises(ValueError):
        sinks.write_pack(E.fallback_pack(done), "normalized", str(tmp_path / "small"), 10)


MARC = """<collection><record><leader>x</leader><controlfield tag="001">r1</controlfield><controlfield tag="008">{}</controlfield>
<datafield tag="245" ind1="1" ind2="0"><subfield code="6">880-01</subfield><subfield code="a">Kitab</subfield></datafield>
<datafield tag="880" ind1="1" ind2="0"><subfield code="6">245-01/(3/r</subfield><subfield code="a">کتاب</subfield></datafield>
<datafield tag="260" ind1=" " ind2=" "><subfield code="6">880-02</subfield><subfield code="a">Tihran</subfield></datafield></record></collection>"""


def test_marc_linkage(spark, tmp_path):
    (tmp_path / "m.xml").write_text(MARC.format(" " * 35 + "per"), encoding="utf-8")
    records = R.marc(spark, str(tmp_path / "m.xml"))
    cells = R.marc_fields(records).groupBy("record_id", "place", "tag").agg(F.max(F.when(F.col("code") == "6", F.col("value"))).alias("linkage"), F.max(F.when(F.col("code") == "a", F.col("value"))).alias("value"))
    got = {(r.tag, r.occurrence): (r.status, r.regular, r.alternate) for r in E.linked_fields(cells).collect()}
    assert got == {("245", "01"): ("MATCHED", "Kitab", "کتاب")}
    f008 = records.select(F.filter("controlfield", lambda c: c["_tag"] == "008")[0]["_VALUE"].alias("f"))
    assert len(f008.first()["f"]) >= 3
    (tmp_path / "bad.xml").write_text("<!DOCTYPE x><collection/>")
    assert R.marc(spark, str(tmp_path)).count() == 1
    assert [(r["path"].rpartition("/")[2], r["reason"]) for r in R.refused_xml(spark, str(tmp_path)).collect()] == [("bad.xml", "DOCUMENT_TYPE")]


def test_catalogue_json_and_pages(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"@id": "1", "title": "T", "dc:creator": ["A", "B"]}, {"@id": "2", "title": ["X", "Y"]}]}))
    got = {r.id: (r.titles, r.creators) for r in R.catalogue_items(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"1": (["T"], ["A", "B"]), "2": (["X", "Y"], [])}
    (tmp_path / "pages").mkdir()
    for k in range(3):
        (tmp_path / "pages" / f"{k}.json").write_text(json.dumps({"results": [{"id": f"{k}-{i}", "title": "t", "language": "fa", "type": "book", "year": 2000} for i in range(2)]}))
    saved = remote.saved_pages(spark, str(tmp_path / "pages"))
    assert saved.select("id").distinct().count() == 6 and saved.first()["year"] == 2000
    (tmp_path / "cursors").mkdir()
    for k, (cursor, after) in enumerate([("*", "a"), ("a", "b"), ("a", None)]):
        (tmp_path / "cursors" / f"{k}.json").write_text(json.dumps({"cursor": cursor, "next": after, "results": []}))
    got = {(r.page, r.finding) for r in remote.page_findings(spark, str(tmp_path / "cursors")).collect()}
    assert got == {("1.json", "MISSING_NEXT"), ("1.json", "CURSOR_TWICE"), ("2.json", "CURSOR_TWICE")}


def test_paged_source(spark):
    def fetch(query, cursor):
        k = 0 if cursor == "*" else int(cursor)
        return 200, {"results": [{"id": f"{query}{k}", "title": "t", "year": 2000 + k}], "next": str(k + 1) if k < 3 else None}, None

    spark.dataSource.register(remote.paged_source("works", fetch, budget=3))
    rows = spark.read.format("works").option("queries", "a\nb").load().collect()
    assert sorted((r.id, r.year) for r in rows) == [(f"{q}{k}", 2000 + k) for q in "ab" for k in range(3)]


def test_pager():
    pages = {"*": {"results": [1, 2], "next": "a"}, "a": {"results": [3, 4], "next": "b"}, "b": {"results": []}}
    calls, waits = [], []

    def fetch(cursor):
        calls.append(cursor)
        return (429, {}, 2.0) if len(calls) == 1 else (200, pages[cursor], None)

    assert list(remote.Pager(fetch, sleep=waits.append)) == [1, 2, 3, 4] and waits == [2.0]
    assert list(remote.Pager(fetch, budget=3, sleep=waits.append)) == [1, 2, 3]
    with pytest.raises(OSError):
        list(remote.Pager(lambda c: (200, {"results": [1], "next": "*"}, None)))
    with pytest.raises(ValueError):
        remote.sru_url("http://x", "any", "t")
    assert "title%3D%22a%5C%22b%22" in remote.sru_url("http://x", "title", 'a"b')


def test_blobs(spark, tmp_path):
    sinks.put_blob(spark, b"abc", str(tmp_path / "b"))
    sinks.put_blob(spark, b"abc", str(tmp_path / "b"))
    assert sinks.broken_blobs(spark, str(tmp_path / "b")).count() == 0
