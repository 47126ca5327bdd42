"""A search service over HTTP, read and streamed, with failures on the way."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from textloom.sources import remote
from textloom.sources.marc_xml import MARC_NAMESPACE, SRU_NAMESPACE


class Service:
    """``sizes``: records of each term. ``failures``: start positions that are refused so many times."""

    def __init__(self, sizes, failures=()):
        self.sizes, self.failures, self.asked = sizes, dict(failures), []
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                given = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                term, start, count = given["query"].split('"')[1], int(given["startRecord"]), int(given["maximumRecords"])
                service.asked.append((term, start))
                if service.failures.get(start, 0):
                    service.failures[start] -= 1
                    self.send_response(503)
                    self.end_headers()
                    return
                self.send_response(200)
                self.end_headers()
                self.wfile.write(service.page(term, start, count).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}/sru"

    def page(self, term, start, count):
        total = self.sizes[term]
        places = range(start, min(start + count, total + 1))
        rows = "".join(
            f'<record><recordData><record xmlns="{MARC_NAMESPACE}"><leader>00000nam</leader><controlfield tag="001">{term}{k}</controlfield><controlfield tag="008">1234567{1900 + k}{"-" * 24}per</controlfield>'
            f'<datafield tag="245" ind1=" " ind2=" "><subfield code="a">t</subfield><subfield code="b">{k}</subfield></datafield></record></recordData><recordPosition>{k}</recordPosition></record>'
            for k in places
        )
        after = f"<nextRecordPosition>{start + count}</nextRecordPosition>" if start + count <= total else ""
        return f'<searchRetrieveResponse xmlns="{SRU_NAMESPACE}"><version>1.2</version><numberOfRecords>{total}</numberOfRecords><records>{rows}</records>{after}</searchRetrieveResponse>'

    def source(self, name, **more):
        return remote.paged_source(name, remote.sru_fetch(self.base, "title", 4), pause=0.01, **more)


def test_a_batch_read_asks_page_by_page(spark):
    service = Service({"a": 10, "b": 3, "c": 0}, {5: 2})
    spark.dataSource.register(service.source("sru_batch"))
    rows = {r["id"]: r for r in spark.read.format("sru_batch").option("queries", "a\nb\nc").load().collect()}
    assert sorted(rows) == sorted([f"a{k}" for k in range(1, 11)] + [f"b{k}" for k in range(1, 4)])
    assert (rows["a7"]["title"], rows["a7"]["language"], rows["a7"]["type"], rows["a7"]["year"]) == ("t 7", "per", "am", 1907) and "<leader>" in rows["a7"]["raw"]
    assert sorted(service.asked) == [("a", 1), ("a", 5), ("a", 5), ("a", 5), ("a", 9), ("b", 1), ("c", 1)]
    with pytest.raises(Exception, match="status 503 after 2 tries"):
        spark.dataSource.register(Service({"a": 3}, {1: 9}).source("sru_down", tries=2))
        spark.read.format("sru_down").option("queries", "a").load().collect()


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """The service fails in the middle; the next start repeats no page that is committed, and each record comes once."""
    service = Service({"a": 22, "b": 6}, {13: 4})
    spark.dataSource.register(service.source("sru_stream", tries=2))

    def run():
        rows = spark.readStream.format("sru_stream").option("queries", "a\nb").load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    def ids():
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    with pytest.raises(Exception, match="status 503 after 2 tries"):
        run()
    assert 0 < len(ids()) < 28
    with pytest.raises(Exception, match="status 503 after 2 tries"):
        run()
    run()
    run()
    assert ids() == sorted([f"a{k}" for k in range(1, 23)] + [f"b{k}" for k in range(1, 7)])
    assert [a for a in service.asked if a[1] == 1].count(("a", 1)) == 1


def test_offsets_hold_budget_and_cursors():
    pages = {"*": (["1", "2"], "x"), "x": (["3", "4"], "y"), "y": (["5"], "x")}
    fetch = lambda q, c: (200, {"results": [{"id": q + i} for i in pages[c][0]], "next": pages[c][1]}, None)
    stream = remote.paged_source("s", fetch, budget=3)(options={"queries": "q"}).simpleStreamReader(None)
    start = stream.initialOffset()
    first, after = stream.read(start)
    assert [r[0] for r in first] == ["q1", "q2"] and after["q"]["left"] == 1 and after["q"]["cursor"] == "x" and start == stream.initialOffset()
    second, end = stream.read(after)
    assert [r[0] for r in second] == ["q3"] and list(stream.read(end)[0]) == [] and stream.read(end)[1] == end
    assert [r[0] for r in stream.readBetweenOffsets(start, end)] == ["q1", "q2", "q3"]
    looped = remote.paged_source("s", fetch)(options={"queries": "q", "pages": "9"}).simpleStreamReader(None)
    with pytest.raises(OSError, match="twice"):
        looped.read(looped.initialOffset())
