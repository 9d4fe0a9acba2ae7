"""Fetching pages: address encoding, retries, size and type gates, a cache by address.

The opener is a parameter, so a crawl on executors and a test without network run
the same code.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame

from folioforge.sources.connectors import decode_body

# Attempts, seconds between them, and bytes of one page.
ATTEMPTS, DELAY, MOST_PAGE_BYTES = 2, 1.0, 5_000_000
SCHEMA = "page_url string, status string, html string, error string, final_url string, headers map<string,string>"


class Answer(NamedTuple):
    status: int
    headers: dict[str, str]
    body: bytes
    final_url: str


Opener = Callable[[str], Answer]


def encoded_url(url: str) -> str:
    """An address as it is sent: host in ASCII, other signs as percent codes; codes that stand there stay, so encoding twice changes nothing."""
    parts = urlsplit(url.strip())
    host = parts.hostname or ""
    try:
        host = host.encode("idna").decode("ascii") if host and not host.isascii() else host
    except UnicodeError:
        pass
    if ":" in host:
        host = f"[{host}]"
    if parts.port:
        host = f"{host}:{parts.port}"
    if parts.username:
        user = quote(parts.username, safe="%")
        host = f"{user}:{quote(parts.password, safe='%')}@{host}" if parts.password else f"{user}@{host}"
    keep = "%/:=&?~#+!$,;'@()*[]"
    return urlunsplit((parts.scheme, host, quote(parts.path, safe=keep), quote(parts.query, safe=keep), quote(parts.fragment, safe=keep)))


def with_retries(open_: Opener, url: str, attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """An answer, asked for again after a lost connection or a server's fault; the last failure is raised."""
    for k in range(attempts):
        try:
            got = open_(url)
            if got.status < 500 or k == attempts - 1:
                return got
        except HTTPError as e:
            if e.code < 500 or k == attempts - 1:
                raise
        except (URLError, TimeoutError, ConnectionError):
            if k == attempts - 1:
                raise
        sleep(delay)
    raise ValueError("no attempts")


def is_page_type(content_type: str | None) -> bool:
    """Text or html, but no xml; an unsaid type may be a page."""
    low = (content_type or "text/html").lower()
    return "xml" not in low.replace("xhtml+xml", "") and ("html" in low or "text" in low)


def fetched(url: str, open_: Opener, **retries: object) -> dict[str, object]:
    """One row of :data:`SCHEMA`; failures are rows too."""
    row: dict[str, object] = {"page_url": url, "status": "unavailable", "html": None, "error": None, "final_url": None, "headers": None}
    try:
        got = with_retries(open_, encoded_url(url), **retries)
    except Exception as e:  # whatever a server or network does is a row
        return row | {"error": f"{type(e).__name__}: {e}"}
    headers = {k.lower(): v for k, v in got.headers.items()}
    row |= {"final_url": got.final_url, "headers": headers}
    if not 200 <= got.status < 300:
        return row | {"error": f"status {got.status}"}
    if not is_page_type(headers.get("content-type")):
        return row | {"status": "not_html", "error": f"content type {headers.get('content-type')}"}
    if len(got.body) > MOST_PAGE_BYTES:
        return row | {"status": "not_html", "error": f"{len(got.body)} bytes"}
    charset = re.search(r"charset=[\"']?([\w.:-]+)", headers.get("content-type", ""))
    text = decode_body(got.body, headers.get("content-encoding"), charset[1] if charset else None)
    return row | ({"status": "present", "html": text} if text is not None else {"error": "cannot be decoded"})


class Cache:
    """Rows of present pages by the hash of their address, in a folder that all executors share; what cannot be read or written is as if it were not there."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _path(self, url: str) -> str:
        name = hashlib.sha256(url.encode()).hexdigest()
        return os.path.join(self.folder, name[:2], name)

    def get(self, url: str) -> dict[str, object] | None:
        try:
            with open(self._path(url), encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return None

    def put(self, url: str, row: dict[str, object]) -> None:
        if row["status"] != "present":
            return
        try:
            path = self._path(url)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
                json.dump(row, f)
            os.replace(f"{path}.{os.getpid()}", path)
        except OSError:
            pass


def fetch_pages(urls: DataFrame, open_: Opener, cache: str | None = None, at_once: int = 3, **retries: object) -> DataFrame:
    """:data:`SCHEMA` of the ``page_url`` rows, each address once.

    ``at_once`` tasks fetch side by side; an address answered before comes from the cache.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Cache(cache) if cache else None
        for batch in batches:
            rows = []
            for url in batch["page_url"]:
                row = store.get(url) if store else None
                if row is None:
                    row = fetched(url, open_, **retries)
                    if store:
                        store.put(url, row)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["page_url", "status", "html", "error", "final_url", "headers"])

    return urls.select("page_url").where("page_url is not null").distinct().repartition(at_once, "page_url").mapInPandas(run, SCHEMA)
