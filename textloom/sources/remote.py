"""SRC10-13: paged catalogue services.

:func:`paged_source` makes a Spark data source of a ``fetch`` function: a partition for each query, read
by a :class:`Pager` with its retries, budget and cursor checks. The same source streams: its offset is
the cursor of each query, so a stream that stops goes on at the page after the last one that its
checkpoint has. :func:`sru_fetch` is the ``fetch`` of a search service that answers in MARC XML.
:func:`saved_pages` reads responses that were saved, from any file system that Spark reads.
"""

from __future__ import annotations

import copy
import hashlib
import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from textloom.sources.marc_xml import parse_page

# Indexes that may be searched, records of a request, records of a scan.
INDEXES = ("title", "creator", "subject", "isbn", "issn", "lccn", "year", "language")
PER_REQUEST, MAX_SCAN = 20, 15_000


def sru_url(base: str, index: str, term: str, start: int = 1, count: int = PER_REQUEST) -> str:
    if index not in INDEXES:
        raise ValueError(f"index {index} is not allowed")
    if not 1 <= count <= PER_REQUEST:
        raise ValueError("1 to 20 records a request")
    quoted = term.replace("\\", "\\\\").replace('"', '\\"')
    return base + "?" + urlencode({"operation": "searchRetrieve", "version": "1.1", "query": f'{index}="{quoted}"', "startRecord": start, "maximumRecords": count})


def http_get(url: str, timeout: float = 30) -> tuple[int, bytes, float | None]:
    """Status, body and the seconds that the service asks to wait."""
    try:
        with urlopen(Request(url, headers={"Accept": "application/xml, application/json"}), timeout=timeout) as answer:
            return answer.status, answer.read(), None
    except HTTPError as answer:
        after = answer.headers.get("Retry-After", "")
        return answer.code, b"", float(after) if after.isdigit() else None


def sru_fetch(base: str, index: str, count: int = PER_REQUEST, get: Callable[[str], tuple[int, bytes, float | None]] = http_get) -> Callable[[str, str], tuple[int, dict, float | None]]:
    """SRC10: ``fetch(term, cursor)`` of a search service; the cursor is the number of a page's first record.

    Pages are parsed under the bounds of :mod:`textloom.sources.marc_xml`; one that is refused, or a diagnostic, is an error.
    """

    def item(record: dict) -> dict:
        field = {c["_tag"]: c["_VALUE"] for c in reversed(record["controlfield"])}
        titles = [s["_VALUE"] for d in record["datafield"] if d["_tag"] == "245" for s in d["subfield"] if s["_code"] in "abnp"]
        date = field.get("008", "")[7:11]
        return {"id": field["001"], "title": " ".join(titles) or None, "language": field.get("008", "")[35:38] or None, "type": record["leader"][6:8] or None, "year": int(date) if date.isdecimal() else None, "xml": record["xml"]}

    def fetch(term: str, cursor: str) -> tuple[int, dict, float | None]:
        status, body, after = get(sru_url(base, index, term, 1 if cursor == "*" else int(cursor), count))
        if status != 200:
            return status, {}, after
        page = parse_page(body, "SRU")
        if page["diagnostics"]:
            raise OSError("; ".join(d["message"] for d in page["diagnostics"]))
        return status, {"results": [item(r) for r in page["records"]], "next": page["next"] and str(page["next"])}, None

    return fetch


class Pager:
    """Cursor paging with a budget; ``fetch(cursor)`` gives (status, body, retry-after)."""

    def __init__(self, fetch: Callable[[str], tuple[int, dict, float | None]], budget: int = MAX_SCAN, tries: int = 4, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep):
        self.fetch, self.budget, self.tries, self.pause, self.sleep = fetch, budget, tries, pause, sleep

    def page(self, cursor: str) -> dict:
        for k in range(self.tries):
            status, body, after = self.fetch(cursor)
            if status == 200:
                return body
            if status != 429 and status < 500:
                raise OSError(f"status {status}")
            self.sleep(after if after is not None else self.pause * 2**k)
        raise OSError(f"status {status} after {self.tries} tries")

    def __iter__(self) -> Iterator[dict]:
        cursor, seen, left = "*", set(), self.budget
        while cursor and left > 0:
            if cursor in seen:
                raise OSError("the service gave a cursor twice")
            seen.add(cursor)
            page = self.page(cursor)
            yield from page["results"][:left]
            left -= len(page["results"])
            cursor = page.get("next") if page["results"] else None


WORK = "id string, title string, language string, type string, year int, raw string"


class _Query(InputPartition):
    def __init__(self, text: str):
        self.text = text


def _row(item: dict) -> tuple:
    return item.get("id"), item.get("title"), item.get("language"), item.get("type"), item.get("year"), json.dumps(item, ensure_ascii=False, sort_keys=True)


def paged_source(name: str, fetch: Callable[[str, str], tuple[int, dict, float | None]], budget: int = MAX_SCAN, tries: int = 4, pause: float = 0.5) -> type[DataSource]:
    """A data source ``name`` over ``fetch(query, cursor)``, to be read or streamed; option ``queries`` has one query a line.

    A read has a partition for each query. A stream takes ``pages`` pages (option, 1) of each query a batch; its
    offset holds for each query the next cursor, the budget left and hashes of the cursors that were used, so a
    batch that is run again asks for the same pages.
    """

    def queries(options) -> list[str]:
        return [q for q in options.get("queries", "").split("\n") if q]

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.queries = queries(options)

        def partitions(self):
            return [_Query(q) for q in self.queries] or [_Query("")]

        def read(self, partition):
            if partition.text:
                yield from map(_row, Pager(lambda cursor: fetch(partition.text, cursor), budget, tries, pause))

    class Stream(SimpleDataSourceStreamReader):
        def __init__(self, options):
            self.queries, self.pages = queries(options), int(options.get("pages", "1"))

        def initialOffset(self):
            return {q: {"cursor": "*", "left": budget, "used": []} for q in self.queries}

        def read(self, start):
            rows, place = [], copy.deepcopy(start)
            for query, at in place.items():
                pager = Pager(lambda cursor, q=query: fetch(q, cursor), budget, tries, pause)
                for _ in range(self.pages):
                    if at["cursor"] is None or at["left"] <= 0:
                        break
                    mark = hashlib.sha256(at["cursor"].encode()).hexdigest()[:16]
                    if mark in at["used"]:
                        raise OSError("the service gave a cursor twice")
                    page = pager.page(at["cursor"])
                    rows += map(_row, page["results"][: at["left"]])
                    at["used"].append(mark)
                    at["left"] -= len(page["results"])
                    at["cursor"] = (page.get("next") or None) if page["results"] else None
            return iter(rows), place

        def readBetweenOffsets(self, start, end):
            rows = []
            while start != end:
                more, after = self.read(start)
                rows += more
                if after == start:
                    raise OSError("the service no longer gives the pages of a batch that is to be repeated")
                start = after
            return iter(rows)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return WORK

        def reader(self, schema):
            return Reader(self.options)

        def simpleStreamReader(self, schema):
            return Stream(self.options)

    return Paged


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Works of saved responses, one JSON file a page, with the page they came on."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.explode(F.from_json("value", "results array<string>")["results"]).alias("raw"))
    return pages.select("page", F.from_json("raw", "id string, title string, language string, type string, year int").alias("w"), "raw").select("page", "w.*", "raw")


def page_findings(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: saved pages whose next cursor no page answers, or that several pages name as theirs (``cursor``, ``next``)."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.from_json("value", "cursor string, next string").alias("p")).select("page", "p.*")
    held = pages.groupBy("cursor").agg(F.count("*").alias("n"))
    open_ = pages.where("next IS NOT NULL").join(held.select(F.col("cursor").alias("next")), "next", "left_anti").select("page", F.lit("MISSING_NEXT").alias("finding"))
    twice = pages.join(held.where("n > 1"), "cursor", "left_semi").select("page", F.lit("CURSOR_TWICE").alias("finding"))
    return open_.unionByName(twice)
