"""SRC8/9: MARC XML pages, parsed under bounds; a page that breaks one is a row with its reason.

Pages are files, or lines of saved responses. Those above ``bytes`` are not opened. Others are parsed by events in an Arrow map, so a page
costs its records and one path of open elements. Document types and processing
instructions are refused before anything that they could expand. Kinds of pages: a
search response (``SRU``), a ``COLLECTION`` or one ``RECORD``; with ``strict`` every name must be in its
namespace, without it only local names count.

Reasons: TOO_LARGE, SYNTAX, DOCUMENT_TYPE, INSTRUCTION, DEPTH, ELEMENTS, TEXT, ROOT, NAMESPACE, STRUCTURE,
ATTRIBUTES, FIELDS, SUBFIELDS, RECORDS, NO_CONTROL_NUMBER, OUTSIDE_RECORD_DATA; of search responses also NUMBER,
DIAGNOSTIC, VERSION, NO_TOTAL, POSITIONS, OVER_TOTAL, NEXT_POSITION.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

# Namespaces.
MARC_NAMESPACE = "http://www.loc.gov/MARC21/slim"
SRU_NAMESPACE = "http://www.loc.gov/zing/srw/"

_ROOTS = {"SRU": ("searchRetrieveResponse", SRU_NAMESPACE), "COLLECTION": ("collection", MARC_NAMESPACE), "RECORD": ("record", MARC_NAMESPACE)}
_CHILDREN = {"record": ("leader", "controlfield", "datafield"), "datafield": ("subfield",)}


@dataclass(frozen=True)
class Bounds:
    # Bounds of a page.
    bytes: int = 5_000_000
    depth: int = 32
    elements: int = 100_000
    text: int = 1_000_000
    records: int = 50
    fields: int = 2_000
    subfields: int = 500


class Refused(ValueError):
    """A page that is not to be used; its text is the reason."""


class _Page:
    """The events of one page."""

    def __init__(self, kind: str, strict: bool, bounds: Bounds, xml: bool = True):
        self.kind, self.strict, self.bounds, self.xml = kind, strict, bounds, xml
        self.depth, self.most, self.names = bounds.depth, bounds.elements, {}
        self.open: list[tuple[str, str]] = []
        self.texts: list[list[str]] = []
        self.lengths: list[int] = []
        self.elements = 0
        self.record = self.field = self.diagnostic = None
        self.in_data = False
        self.out = {"version": None, "total": None, "next": None, "positions": [], "diagnostics": [], "records": []}

    def _is(self, space: str, want: str) -> bool:
        return space == want or not self.strict

    def start(self, name: str, given: dict) -> None:
        here, path = self.names.get(name), self.open
        if here is None:
            here = self.names[name] = name.rpartition(" ")[::2]
        space, local = here
        self.elements += 1
        if len(path) >= self.depth:
            raise Refused("DEPTH")
        if self.elements > self.most:
            raise Refused("ELEMENTS")
        if not path:
            root, root_space = _ROOTS[self.kind]
            if local != root or not self._is(space, root_space):
                raise Refused("ROOT")
        parent = path[-1][1] if path else None
        path.append(here)
        self.texts.append([])
        self.lengths.append(0)
        if self.record is not None:
            if self.strict and space != MARC_NAMESPACE:
                raise Refused("NAMESPACE")
            if local not in _CHILDREN.get(parent, ()):
                raise Refused("STRUCTURE")
            self._inside(local, given)
        elif self._is(space, MARC_NAMESPACE) and local == "record" and not self._sru_record(space):
            if self.kind == "SRU" and not self.in_data:
                raise Refused("OUTSIDE_RECORD_DATA")
            self.record = {"leader": "", "controlfield": [], "datafield": []}
        elif self.kind == "SRU" and local == "recordData" and self._is(space, SRU_NAMESPACE):
            self.in_data = True
        elif self.kind == "SRU" and local == "diagnostic" and ("diagnostic" in space or not self.strict):
            self.diagnostic = {}

    def _sru_record(self, space: str) -> bool:
        """Without namespaces, a search response's own record is the one that is not within record data."""
        return self.kind == "SRU" and not self.strict and not self.in_data

    def _inside(self, local: str, given: dict) -> None:
        if local == "subfield":
            if len(self.field["subfield"]) >= self.bounds.subfields:
                raise Refused("SUBFIELDS")
            if len(given.get("code", "")) != 1:
                raise Refused("ATTRIBUTES")
            self.field["subfield"].append({"_code": given["code"], "_VALUE": ""})
            return
        if local in ("controlfield", "datafield") and len(self.record["controlfield"]) + len(self.record["datafield"]) >= self.bounds.fields:
            raise Refused("FIELDS")
        if local == "controlfield" and not given.get("tag"):
            raise Refused("ATTRIBUTES")
        if local == "controlfield":
            self.field = {"_tag": given["tag"]}
        if local == "datafield":
            if not given.get("tag") or len(given.get("ind1", "")) != 1 or len(given.get("ind2", "")) != 1:
                raise Refused("ATTRIBUTES")
            self.field = {"_tag": given["tag"], "_ind1": given["ind1"], "_ind2": given["ind2"], "subfield": []}

    def text(self, text: str) -> None:
        if self.open:
            self.texts[-1].append(text)
            self.lengths[-1] += len(text)
            if self.lengths[-1] > self.bounds.text:
                raise Refused("TEXT")

    def short_text(self, text: str) -> None:
        """:meth:`text` of a page that has no more bytes than a text may have characters."""
        if self.texts:
            self.texts[-1].append(text)

    def end(self, name: str) -> None:
        space, local = self.open.pop()
        text, length = "".join(self.texts.pop()), self.lengths.pop()
        if self.open:
            self.lengths[-1] += length
            if self.kind == "SRU":  # elsewhere only elements without others have a value
                self.texts[-1].append(text)
        value = text.strip()
        if self.record is not None:
            self._ended(local, value)
        elif self.diagnostic is not None and local in ("uri", "message", "details"):
            self.diagnostic[local] = value
        elif self.diagnostic is not None and local == "diagnostic":
            if not self.diagnostic.get("uri") or not self.diagnostic.get("message"):
                raise Refused("DIAGNOSTIC")
            self.out["diagnostics"].append({"uri": self.diagnostic["uri"], "message": self.diagnostic["message"], "details": self.diagnostic.get("details", "")})
            self.diagnostic = None
        elif self.kind == "SRU" and self._is(space, SRU_NAMESPACE):
            if local == "version":
                self.out["version"] = value
            elif local in ("numberOfRecords", "nextRecordPosition", "recordPosition"):
                number = int(value) if re.fullmatch(r"[0-9]{1,16}", value) else -1
                if number < (local != "numberOfRecords") or number >= 1 << 53:
                    raise Refused("NUMBER")
                if local == "recordPosition":
                    self.out["positions"].append(number)
                else:
                    self.out["total" if local == "numberOfRecords" else "next"] = number
            elif local == "recordData":
                self.in_data = False

    def _ended(self, local: str, value: str) -> None:
        if local == "subfield":
            self.field["subfield"][-1]["_VALUE"] = value
        elif local == "leader":
            self.record["leader"] = value
        elif local == "controlfield":
            self.record["controlfield"].append({**self.field, "_VALUE": value})
        elif local == "datafield":
            self.record["datafield"].append(self.field)
        elif local == "record":
            if not any(c["_tag"] == "001" for c in self.record["controlfield"]):
                raise Refused("NO_CONTROL_NUMBER")
            if len(self.out["records"]) >= self.bounds.records:
                raise Refused("RECORDS")
            self.out["records"].append({**self.record, "xml": canonical(self.record)} if self.xml else self.record)
            self.record = None

    def checked(self) -> dict:
        """The page, if a search response agrees with itself; one with diagnostics need not."""
        page, places = self.out, self.out["positions"]
        if self.kind == "SRU" and not page["diagnostics"]:
            if page["version"] != "1.2":
                raise Refused("VERSION")
            if page["total"] is None:
                raise Refused("NO_TOTAL")
            if len(places) != len(page["records"]) or places != list(range(places[0], places[0] + len(places)) if places else []):
                raise Refused("POSITIONS")
            if len(page["records"]) > page["total"]:
                raise Refused("OVER_TOTAL")
            if page["next"] is not None and places and page["next"] != places[-1] + 1:
                raise Refused("NEXT_POSITION")
        return page


def canonical(record: dict) -> str:
    """A record in one spelling, for checksums."""
    safe = lambda v: escape(v, {'"': "&quot;"})
    control = "".join(f'<controlfield tag="{safe(c["_tag"])}">{safe(c["_VALUE"])}</controlfield>' for c in record["controlfield"])
    data = "".join(
        f'<datafield tag="{safe(d["_tag"])}" ind1="{safe(d["_ind1"])}" ind2="{safe(d["_ind2"])}">' + "".join(f'<subfield code="{safe(s["_code"])}">{safe(s["_VALUE"])}</subfield>' for s in d["subfield"]) + "</datafield>" for d in record["datafield"]
    )
    return f'<record xmlns="{MARC_NAMESPACE}"><leader>{safe(record["leader"])}</leader>{control}{data}</record>'


def parse_page(content: bytes, kind: str = "COLLECTION", strict: bool = True, bounds: Bounds = Bounds(), xml: bool = True) -> dict:
    """Version, total, next and record positions, diagnostics and records of one page; raises :class:`Refused`. ``xml``: records have their canonical text."""
    if len(content) > bounds.bytes:
        raise Refused("TOO_LARGE")
    page, parser = _Page(kind, strict, bounds, xml), expat.ParserCreate(namespace_separator=" ")

    def refuse(reason: str):
        def handler(*_):
            raise Refused(reason)

        return handler

    parser.StartDoctypeDeclHandler, parser.ProcessingInstructionHandler = refuse("DOCUMENT_TYPE"), refuse("INSTRUCTION")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = page.start, page.end, page.text if len(content) > bounds.text else page.short_text
    try:
        parser.Parse(content, True)
    except expat.ExpatError:
        raise Refused("SYNTAX") from None
    return page.checked()


_PAIR = lambda *names: pa.list_(pa.struct([(n, pa.string()) for n in names]))
_RECORD = [
    ("leader", pa.string()), ("controlfield", _PAIR("_tag", "_VALUE")),
    ("datafield", pa.list_(pa.struct([("_tag", pa.string()), ("_ind1", pa.string()), ("_ind2", pa.string()), ("subfield", _PAIR("_code", "_VALUE"))]))),
]


def _page(xml: bool) -> pa.Schema:
    return pa.schema([
        ("path", pa.string()), ("reason", pa.string()), ("version", pa.string()), ("total", pa.int64()), ("next", pa.int64()), ("positions", pa.list_(pa.int64())),
        ("diagnostics", _PAIR("uri", "message", "details")), ("records", pa.list_(pa.struct([*_RECORD, *[("xml", pa.string())] * xml]))),
    ])


#: Bytes of pages whose records are handed on together.
TOGETHER = 1_000_000


def parsed_pages(pages: DataFrame, kind: str = "COLLECTION", strict: bool = True, bounds: Bounds = Bounds(), xml: bool = True) -> DataFrame:
    """One row for each of ``path, content`` (bytes; null for a page that is not opened because it is too large), with the columns of :func:`read_pages`."""
    page = _page(xml)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                row, content = dict.fromkeys(page.names) | {"path": name.as_py()}, content.as_py()
                try:
                    if content is None:
                        raise Refused("TOO_LARGE")
                    row |= parse_page(content, kind, strict, bounds, xml)
                    held += len(content)
                except Refused as why:
                    row["reason"] = str(why)
                rows.append(row)
                if held >= TOGETHER or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=page)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=page)

    return pages.select("path", "content").mapInArrow(parse, from_arrow_schema(page))


def read_pages(spark: SparkSession, path: str, kind: str = "COLLECTION", strict: bool = True, bounds: Bounds = Bounds(), xml: bool = True) -> DataFrame:
    """One row a file: ``path, reason, version, total, next, positions, diagnostics, records``; ``reason`` is null for good pages, and the rest is null for others.

    Without ``xml`` records come without their canonical text.
    """
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > bounds.bytes).select("path", F.lit("TOO_LARGE").alias("reason"))
    return parsed_pages(files.where(F.col("length") <= bounds.bytes), kind, strict, bounds, xml).unionByName(large, allowMissingColumns=True)


def read_saved(spark: SparkSession, path: str, kind: str = "SRU", strict: bool = True, bounds: Bounds = Bounds(), xml: bool = True) -> DataFrame:
    """:func:`read_pages` of responses that are saved as JSON lines of ``path, content``: many are a few large files, which are read by byte range."""
    saved = spark.read.schema("path string, content string").json(path)
    content = F.coalesce("content", F.lit("")).cast("binary")
    return parsed_pages(saved.select("path", F.when(F.octet_length(content) <= bounds.bytes, content).alias("content")), kind, strict, bounds, xml)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of good pages: ``path, place`` (on the page, from 1) and the record's fields."""
    return pages.where("reason IS NULL").select("path", F.posexplode("records").alias("place", "r")).select("path", (F.col("place") + 1).alias("place"), "r.*")


def refused_pages(pages: DataFrame) -> DataFrame:
    return pages.where("reason IS NOT NULL").select("path", "reason")
