"""Services as sources and sinks, against a small server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from quarry.session import Session


@pytest.fixture()
def server():
    got, failures = [], [1]

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, doc):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(doc).encode())

        def do_GET(self):
            url = urlsplit(self.path)
            page = int(parse_qs(url.query).get("page", ["1"])[0])
            if self.headers.get("Authorization") != "Bearer secret":
                return self.answer(401, {"error": "who are you"})
            self.answer(200, {"data": {"ships": [{"no": page * 10 + k, "name": f"s{page}{k}"} for k in range(2 if page < 3 else 1)]}})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if failures:
                failures.pop()
                return self.answer(429, {})
            got.append(body)
            self.answer(200, {})

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", got
    s.shutdown()


def test_pages_are_read_and_errors_told(spark, server):
    url, _ = server
    s = Session(spark)
    s.sql(f"CREATE CONNECTION api AS API (URL = '{url}/ships', AUTH_TYPE = 'BEARER', TOKEN = 'secret', ROOT_PATH = '$.data.ships', PAGINATION_MODE = 'PAGE', PAGE_SIZE = 2)")
    assert [tuple(r) for r in s.sql("SELECT no, name FROM api WHERE no > 10 ORDER BY no").collect()] == [(11, "s11"), (20, "s20"), (21, "s21"), (30, "s30")]
    s.sql(f"CREATE CONNECTION bad AS REST (URL = '{url}/ships')")
    with pytest.raises(Exception, match="401"):
        s.sql("SELECT * FROM bad").collect()


def test_rows_are_sent_one_by_one_or_in_arrays(spark, server):
    url, got = server
    s = Session(spark)
    s.sql("CREATE TABLE #t (no INT, name STRING); INSERT INTO #t VALUES (1, 'a'), (2, NULL), (3, 'c')")
    s.sql(f"CREATE CONNECTION hook AS SLACK (URL = '{url}', RETRY_BACKOFF_MS = 1); INSERT INTO hook SELECT name AS Text FROM #t WHERE no = 1")
    assert got == [{"text": "a"}]
    got.clear()
    s.sql(f"CREATE CONNECTION bulk AS API (URL = '{url}', METHOD = 'POST', BODY_MODE = 'WRAPPED_ARRAY', BATCH_ROOT = 'rows', BATCH_SIZE = 100); INSERT INTO bulk SELECT no, name FROM #t")
    assert sorted((r["no"], r["name"]) for b in got for r in b["rows"]) == [(1, "a"), (2, None), (3, "c")]
