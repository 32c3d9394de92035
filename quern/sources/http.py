"""Polite fetching: a task owns a host, waits between its requests, and retries what may succeed later."""

from __future__ import annotations

import codecs
import re
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from http.client import HTTPException
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRIED = frozenset({408, 429, *range(500, 600)})
DELAY, TIMEOUT, ATTEMPTS, BACKOFF, LONGEST_WAIT = 1.0, 25, 3, 1.5, 30.0
DECLARED = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", re.IGNORECASE)
Response = tuple[int, dict, bytes]
Fetcher = Callable[[str], Response]


def open_url(url: str) -> Response:
    request = urllib.request.Request(url, headers={"User-Agent": "quern/1.0"})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), b""


def wait_asked(headers: dict) -> float | None:
    """Retry-After in seconds, with or without a fraction, at most 30; a date or 0 asks for nothing."""
    value = next((v for k, v in headers.items() if k.lower() == "retry-after"), "")
    try:
        seconds = float(str(value).strip())
    except ValueError:
        return None
    return min(seconds, LONGEST_WAIT) if seconds > 0 else None


def codec_named(body: bytes) -> str:
    """The charset that the head of a page declares, in any case of letters, if Python knows it; else UTF-8."""
    for m in DECLARED.finditer(body, 0, 3000):
        try:
            return codecs.lookup(m[1].decode("ascii")).name
        except LookupError:
            break
    return "utf-8"


def decode_body(body: bytes) -> str:
    """The page's text; a body that starts like gzip is unzipped first, as far as it goes. Undecodable bytes become U+FFFD."""
    if body.startswith(b"\x1f\x8b"):
        unzip = zlib.decompressobj(wbits=31)
        body = unzip.decompress(body)
        if not unzip.eof:
            raise EOFError("the gzip stream is cut off")
    return str(body, codec_named(body), "replace")


def fetch(url: str, get: Fetcher = open_url, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str, str | None]:
    """(status, text, error) after at most three attempts; client errors other than 408 and 429 are final.

    No failure is raised: one bad page must not end the job. Faults of the connection and broken bodies are tried again,
    an address that can't be asked for isn't.
    """
    error, status = None, 0
    for attempt in range(ATTEMPTS):
        wait = BACKOFF * (attempt + 1)
        try:
            status, headers, body = get(url)
            if status < 400:
                return status, decode_body(body), None
            error = f"HTTP {status}"
            if status not in RETRIED:
                break
            wait = wait_asked(headers) or wait
        except (OSError, EOFError, zlib.error, HTTPException) as e:
            error = type(e).__name__
        except Exception as e:  # whatever a page does, the job goes on
            return 0, "", f"{type(e).__name__}: {e}"[:200]
        if attempt < ATTEMPTS - 1:
            sleep(wait)
    return status, "", error


def robots_allow(status: int, body: str, url: str, agent: str = "quern") -> bool:
    """Client errors allow all, server errors and failures nothing; otherwise the rules decide for this very address."""
    if 400 <= status < 500:
        return True
    if not 200 <= status < 300:
        return False
    rules = RobotFileParser()
    rules.parse(body.splitlines())
    return rules.can_fetch(agent, url)


def origin_of(url: str) -> str | None:
    """Scheme and host of a web address; None if it isn't one."""
    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return None
    return f"{parts.scheme}://{parts.netloc}" if parts.scheme in ("http", "https") and parts.netloc else None


def crawl(urls: DataFrame, *, get: Fetcher = open_url, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, status, text, error) of urls(url): partitioned by host, so that one task paces all requests to a host.

    A host's rules are read once a task. Null addresses are dropped; one that isn't a web address has the error "bad address".
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules: dict[str, tuple[int, str]] = {}
        for df in batches:
            rows = []
            for url in df["url"]:
                origin = origin_of(url)
                if origin is None:
                    rows.append((url, 0, "", "bad address"))
                    continue
                if origin not in rules:
                    rules[origin] = fetch(f"{origin}/robots.txt", get, sleep)[:2]
                if robots_allow(*rules[origin], url):
                    sleep(DELAY)
                    rows.append((url, *fetch(url, get, sleep)))
                else:
                    rows.append((url, 0, "", "robots"))
            yield pd.DataFrame(rows, columns=["url", "status", "text", "error"])

    hosts = urls.where("url is not null").withColumn("_host", F.split_part("url", F.lit("/"), F.lit(3)))
    return hosts.repartition("_host").select("url").mapInPandas(run, "url string, status int, text string, error string")


def api_markdown(ids: DataFrame, address: str, *, get: Fetcher = open_url, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(api_id, markdown): each article of an API by its number, "" where it has none or can't be read; address has {} for the number."""
    asked = ids.where("api_id is not null").select("api_id", F.format_string(address.replace("{}", "%s"), F.col("api_id").cast("string")).alias("url")).distinct()
    got = crawl(asked.select("url"), get=get, sleep=sleep)
    return asked.join(got, "url").select("api_id", F.coalesce(F.get_json_object("text", "$.body_markdown"), F.lit("")).alias("markdown"))

