"""Bounds and reasons of MARC XML pages; good pages round trip."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.sources import marc_xml as X
from textloom.sources.marc_xml import Bounds, Refused, canonical, parse_page

M, S = X.MARC_NAMESPACE, X.SRU_NAMESPACE


def record(ident="r1", extra="", ns=M):
    return f'<record xmlns="{ns}"><leader>l</leader><controlfield tag="001"> {ident} </controlfield>{extra}</record>'


def collection(*records, head=""):
    return f'{head}<collection xmlns="{M}">{"".join(records)}</collection>'


def response(n=2, version="1.2", total="9", positions=None, more="", after="3"):
    rows = "".join(f"<record><recordData>{record(f'r{k}')}</recordData><recordPosition>{p}</recordPosition></record>" for k, p in enumerate(positions or range(1, n + 1)))
    return f'<searchRetrieveResponse xmlns="{S}"><version>{version}</version><numberOfRecords>{total}</numberOfRecords><records>{rows}</records><nextRecordPosition>{after}</nextRecordPosition>{more}</searchRetrieveResponse>'


def reason(xml, kind="COLLECTION", **more):
    try:
        parse_page(xml.encode(), kind, **more)
    except Refused as why:
        return str(why)


FIELD = '<datafield tag="245" ind1="1" ind2=" "><subfield code="a">x</subfield></datafield>'


@pytest.mark.parametrize("xml,want", [
    (collection(record()), None),
    (collection(record(), head='<?xml version="1.0" encoding="UTF-8"?>'), None),
    (collection(record(), head="<!DOCTYPE x [<!ENTITY e 'e'>]>"), "DOCUMENT_TYPE"),
    (collection(record(), head="<?style x?>"), "INSTRUCTION"),
    (collection(record())[:-3], "SYNTAX"),
    ("", "SYNTAX"),
    (record(), "ROOT"),
    (collection(record()).replace(f'<collection xmlns="{M}">', "<collection>"), "ROOT"),
    (collection(record(extra='<x xmlns="urn:o"/>')), "NAMESPACE"),
    (collection(record(extra="<subfield code='a'>x</subfield>")), "STRUCTURE"),
    (collection(record(extra=record("r2"))), "STRUCTURE"),
    (collection(record(extra='<controlfield>x</controlfield>')), "ATTRIBUTES"),
    (collection(record(extra=FIELD.replace('ind2=" "', 'ind2="12"'))), "ATTRIBUTES"),
    (collection(record(extra=FIELD.replace('code="a"', 'code=""'))), "ATTRIBUTES"),
    (collection(record().replace('"001"', '"003"')), "NO_CONTROL_NUMBER"),
])
def test_reasons(xml, want):
    assert reason(xml) == want


@pytest.mark.parametrize("xml,want", [
    (response(), None), (response(version="1.1"), "VERSION"), (response(total="x"), "NUMBER"), (response(total="1"), "OVER_TOTAL"), (response(positions=[1, 3]), "POSITIONS"), (response(after="9"), "NEXT_POSITION"), (response(after="0"), "NUMBER"),
    (response(more='<diagnostics><d:diagnostic xmlns:d="http://www.loc.gov/zing/srw/diagnostic/"><d:uri>u</d:uri></d:diagnostic></diagnostics>'), "DIAGNOSTIC"),
    (response(version="0", more='<diagnostics><d:diagnostic xmlns:d="http://www.loc.gov/zing/srw/diagnostic/"><d:uri>u</d:uri><d:message>m</d:message></d:diagnostic></diagnostics>'), None),
    (f'<searchRetrieveResponse xmlns="{S}">{record()}</searchRetrieveResponse>', "OUTSIDE_RECORD_DATA"),
    (f'<searchRetrieveResponse xmlns="{S}"><version>1.2</version></searchRetrieveResponse>', "NO_TOTAL"),
])
def test_reasons_of_responses(xml, want):
    assert reason(xml, "SRU") == want


def test_every_bound_holds_at_its_value():
    one = collection(record(extra=FIELD))
    assert reason(one, bounds=Bounds(bytes=len(one) - 1)) == "TOO_LARGE" and reason(one, bounds=Bounds(bytes=len(one))) is None
    assert reason(one, bounds=Bounds(depth=3)) == "DEPTH" and reason(one, bounds=Bounds(depth=4)) is None
    assert reason(one, bounds=Bounds(elements=5)) == "ELEMENTS" and reason(one, bounds=Bounds(elements=6)) is None
    assert reason(one, bounds=Bounds(fields=1)) == "FIELDS" and reason(one, bounds=Bounds(fields=2)) is None
    assert reason(one, bounds=Bounds(subfields=0)) == "SUBFIELDS" and reason(one, bounds=Bounds(subfields=1)) is None
    assert reason(one, bounds=Bounds(text=3)) == "TEXT" and reason(one, bounds=Bounds(text=8)) is None
    two = collection(record("a"), record("b"))
    assert reason(two, bounds=Bounds(records=1)) == "RECORDS" and reason(two, bounds=Bounds(records=2)) is None


VALUE = st.text(alphabet="ab &<>\"'é کت\n", max_size=8)


@given(st.lists(st.tuples(VALUE, st.lists(st.tuples(st.sampled_from("abc"), VALUE), max_size=3)), max_size=3))
@settings(max_examples=100, deadline=None)
def test_canonical_text_reads_back(fields):
    made = {"leader": "l", "controlfield": [{"_tag": "001", "_VALUE": "i"}], "datafield": [{"_tag": "245", "_ind1": " ", "_ind2": "1", "subfield": [{"_code": c, "_VALUE": v.strip()} for c, v in subs]} for _, subs in fields]}
    got = parse_page(canonical(made).encode(), "RECORD")["records"][0]
    assert got.pop("xml") == canonical(made) and got == made


def test_one_bad_page_does_not_end_the_folder(spark, tmp_path):
    for name, xml in {"a": response(), "b": response(total="x"), "c": "<x", "d": response(more="<extra>" + "y" * 3000 + "</extra>")}.items():
        (tmp_path / f"{name}.xml").write_text(xml)
    pages = X.read_pages(spark, str(tmp_path), "SRU", bounds=Bounds(bytes=2500))
    assert {r["path"][-5]: r["reason"] for r in X.refused_pages(pages).collect()} == {"b": "NUMBER", "c": "SYNTAX", "d": "TOO_LARGE"}
    good = pages.where("reason IS NULL").first()
    assert (good["total"], good["next"], good["positions"]) == (9, 3, [1, 2])
    assert [(r["place"], r["controlfield"][0]["_VALUE"]) for r in X.page_records(pages).orderBy("place").collect()] == [(1, "r0"), (2, "r1")]
    assert parse_page(response().replace(f' xmlns="{M}"', "").replace(f' xmlns="{S}"', "").encode(), "SRU", strict=False)["records"][1]["controlfield"][0]["_VALUE"] == "r1"


def test_saved_responses_are_lines(spark, tmp_path):
    """Line feeds within a page stay in it; a page that is too large, empty or bad does not end the others."""
    pages = {"a": response(), "b": response(total="x"), "c": "", "d": response(more="<extra>" + "é" * 1500 + "</extra>"), "e": "\n" + collection(record("\n r\r\n9 ")).replace("><", ">\n<")}
    spark.createDataFrame([*pages.items(), ("f", None)], "path string, content string").coalesce(1).write.json(str(tmp_path / "saved"))
    got = X.read_saved(spark, str(tmp_path / "saved"), "SRU", bounds=Bounds(bytes=2500))
    assert {r["path"]: r["reason"] for r in X.refused_pages(got).collect()} == {"b": "NUMBER", "c": "SYNTAX", "d": "TOO_LARGE", "e": "ROOT", "f": "SYNTAX"}
    assert [(r["path"], r["place"], r["controlfield"][0]["_VALUE"]) for r in X.page_records(got).orderBy("place").collect()] == [("a", 1, "r0"), ("a", 2, "r1")]
    one = X.read_saved(spark, str(tmp_path / "saved"), "COLLECTION", xml=False).where("path = 'e'").first()
    assert [r["controlfield"][0]["_VALUE"] for r in one["records"]] == ["r\n9"] and "xml" not in one["records"][0]


def test_pages_are_handed_on_together():
    """Records of small pages share a batch, those of large ones do not pile up."""
    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, parse, _):
            return parse

    parse = X.parsed_pages(Pages(), "RECORD", xml=False)
    batches = lambda n, size: iter([pa.record_batch({"path": [str(k) for k in range(n)], "content": [record(extra=FIELD.replace("x", "x" * size)).encode()] * n})])
    assert [b.num_rows for b in parse(batches(100, 1))] == [100]
    assert max(b.nbytes for b in parse(batches(100, 100_000))) < 1_500_000
