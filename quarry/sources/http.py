"""Web services as sources and sinks: paged JSON in, rows as JSON out."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class HttpError(Exception):
    """A request that was answered with an error, or not at all."""


def _headers(options: dict) -> dict[str, str]:
    out = {"Content-Type": "application/json"}
    kind = str(options.get("AUTH_TYPE", "NONE")).upper()
    if kind == "BASIC":
        out["Authorization"] = "Basic " + base64.b64encode(f"{options['USER']}:{options['PASSWORD']}".encode()).decode()
    elif kind == "BEARER":
        out["Authorization"] = f"Bearer {options['TOKEN']}"
    elif kind == "APIKEY":
        out[str(options.get("HEADER_NAME", "X-API-Key"))] = str(options["TOKEN"])
    return out


def request(options: dict, url: str, body: str | None = None, retries: int = 0) -> str:
    """The text that a URL answers with; RETRY_STATUS answers are tried again after a growing pause."""
    again = {int(x) for x in str(options.get("RETRY_STATUS", "408,429,500,502,503,504")).split(",")}
    method = str(options.get("METHOD", "GET" if body is None else "POST")).upper()
    tries = int(options.get("RETRY_COUNT", retries)) + 1
    for k in range(tries):
        try:
            r = urllib.request.Request(url, body.encode() if body is not None else None, _headers(options), method=method)
            with urllib.request.urlopen(r, timeout=float(options.get("TIMEOUT_SECONDS", 30))) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if e.code not in again or k + 1 == tries:
                raise HttpError(f"{urllib.parse.urlsplit(url).netloc} answered {e.code}: {e.read()[:4096].decode(errors='replace')}") from None
        except urllib.error.URLError as e:
            if k + 1 == tries:
                raise HttpError(f"{urllib.parse.urlsplit(url).netloc}: {e.reason}") from None
        time.sleep(float(options.get("RETRY_BACKOFF_MS", 500)) / 1000 * 2**k)
    raise HttpError(url)


def _at(doc, path: str | None):
    """The value of a path such as $.a.b; None where it leads nowhere."""
    for part in (path or "$").lstrip("$").strip(".").split("."):
        if part:
            doc = doc.get(part) if isinstance(doc, dict) else None
    return doc


def pages(options: dict) -> Iterator[list]:
    """The items of each page, by PAGINATION_MODE: NONE, PAGE, OFFSET or CURSOR, or by NEXT_URL_PATH."""
    mode, most = str(options.get("PAGINATION_MODE", "NONE")).upper(), int(options.get("MAX_PAGES", 1000))
    size = options.get("PAGE_SIZE")
    cursor, offset, url = None, 0, str(options["URL"])
    for k in range(most):
        query = {}
        if mode == "PAGE":
            query[str(options.get("PAGE_PARAM", "page"))] = int(options.get("PAGE_START", 1)) + k
        elif mode == "OFFSET":
            query[str(options.get("OFFSET_PARAM", "offset"))] = offset
        elif mode == "CURSOR" and cursor is not None:
            query[str(options.get("CURSOR_PARAM", "cursor"))] = cursor
        if size and mode != "NONE":
            query[str(options.get("LIMIT_PARAM", "limit"))] = size
        full = url + (("&" if "?" in url else "?") + urllib.parse.urlencode(query) if query else "")
        doc = json.loads(request(options, full, str(options["BODY"]) if "BODY" in options else None))
        found = _at(doc, options.get("ROOT_PATH"))
        items = found if isinstance(found, list) else [] if found is None else [found]
        yield items
        offset += len(items)
        if options.get("NEXT_URL_PATH"):
            url = _at(doc, options["NEXT_URL_PATH"])
            if not url:
                return
            url = urllib.parse.urljoin(str(options["URL"]), url)
        elif mode == "CURSOR":
            cursor = _at(doc, options.get("CURSOR_PATH"))
            if not cursor:
                return
        elif mode == "NONE" or not items or size and len(items) < int(size):
            return


def read_api(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
    """A service's items as rows. Pages depend on each other, so the driver fetches them, MAX_PAGES at most."""
    texts = [json.dumps(x if isinstance(x, dict) else {"value": x}) for page in pages(options) for x in page]
    return spark.read.json(spark.sparkContext.parallelize(texts, max(1, min(64, len(texts) // 1000)))) if texts else spark.createDataFrame([], "value string")


def _message(row: dict, style: str) -> dict:
    text = row.get("Text") or "; ".join(f"{k}: {v}" for k, v in row.items())
    return {"SLACK": {"text": text}, "TEAMS": {"@type": "MessageCard", "@context": "https://schema.org/extensions", "title": row.get("Title", ""), "text": text}}.get(style, row)


def write_api(df: DataFrame, options: dict, kind: str) -> None:
    """Send rows to a service: one request a row, or BATCH_SIZE rows as an array; each task sends its own.

    A task that is run again sends its rows again, so a receiver that must not see a row twice
    needs the row's own key.
    """
    given = {str(k): v for k, v in options.items()} | {"METHOD": "POST" if str(options.get("METHOD", "GET")).upper() == "GET" else options["METHOD"]}
    style = {"SLACK": "SLACK", "TEAMS": "TEAMS"}.get(kind, str(options.get("FORMAT", "GENERIC")).upper())
    mode, size, root = str(options.get("BODY_MODE", "ROW_OBJECT")).upper(), int(options.get("BATCH_SIZE", 500)), options.get("BATCH_ROOT")
    hook = kind != "API"
    url = str(options["URL"])

    def send(rows) -> None:
        held = []

        def flush() -> None:
            if held:
                request(given, url, json.dumps({root: held} if mode == "WRAPPED_ARRAY" else held))
                held.clear()

        for r in rows:
            row = json.loads(r["value"])
            if hook or mode == "ROW_OBJECT":
                request(given, url, json.dumps(_message(row, style) if hook else row), 2 if hook else 0)
                continue
            held.append(row)
            if len(held) >= size:
                flush()
        flush()

    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).foreachPartition(send)
