"""Where a document's content comes from: given inline, at a URL, or in a local file."""

from __future__ import annotations

import http.client
import ipaddress
import os
import socket
import ssl
import urllib.parse
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILE = 10 * 1024 * 1024
#: Bytes of an answer that are taken.
MAX_ANSWER = 64 * 1024 * 1024
MAX_REDIRECTS = 5
#: Networks that URLs must not lead into.
PRIVATE_NETWORKS = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "::1/128", "fc00::/7")
_NETWORKS = tuple(map(ipaddress.ip_network, PRIVATE_NETWORKS))


class ContentError(ValueError):
    """A source that gives no content."""


class Fetcher(Protocol):
    def fetch(self, url: str) -> str: ...


def sources_given(content: Column, url: Column, local_path: Column) -> Column:
    """How many of the three sources are given; empty ones are not."""
    given = [F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in (content, url, local_path)]
    return given[0] + given[1] + given[2]


def is_private(address: str) -> bool:
    """Whether an IP address is private, of the own host, or link-local; one that is none is not."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    ip = ip.ipv4_mapped or ip if isinstance(ip, ipaddress.IPv6Address) else ip
    link = ip.is_link_local or (ip.is_multicast and str(ip).startswith(("224.0.0.", "ff02:")))
    return ip.is_loopback or link or any(ip.version == n.version and ip in n for n in _NETWORKS)


def addresses(url: str, allow_private: bool) -> tuple[urllib.parse.SplitResult, list[str]]:
    """An HTTP address and what its host resolves to; refused if any of it is private."""
    parts = urllib.parse.urlsplit(url)
    try:
        port = parts.port
    except ValueError as e:
        raise ContentError(f"not an HTTP address: {url}") from e
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ContentError(f"not an HTTP address: {url}")
    try:
        found = list(dict.fromkeys(str(x[4][0]) for x in socket.getaddrinfo(parts.hostname, port, type=socket.SOCK_STREAM)))
    except (OSError, UnicodeError) as e:
        raise ContentError(f"{parts.hostname} can't be resolved: {e}") from e
    for address in found:
        if not allow_private and is_private(address):
            raise ContentError(f"{parts.hostname} is a private address: {address}")
    return parts, found


def _connection(parts: urllib.parse.SplitResult, found: list[str], timeout: float) -> http.client.HTTPConnection:
    """A connection to one of the addresses that were checked, so that no second resolving can lead elsewhere."""
    secure = parts.scheme == "https"
    port = parts.port or (443 if secure else 80)
    error: OSError | None = None
    for address in found:
        try:
            sock = socket.create_connection((address, port), timeout)
        except OSError as e:
            error = e
            continue
        connection = http.client.HTTPConnection(str(parts.hostname), port, timeout=timeout)
        connection.sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname) if secure else sock
        connection.auto_open = 0
        return connection
    raise error or OSError("no address")


class HttpFetcher:
    """Fetches text over HTTP; every host on the way is resolved once, and refused if it is private."""

    def __init__(self, timeout_seconds: int = 30, allow_private: bool = False, max_bytes: int = MAX_ANSWER):
        self.timeout = timeout_seconds if timeout_seconds > 0 else 30
        self.allow_private, self.max_bytes = allow_private, max_bytes

    def fetch(self, url: str) -> str:
        for _ in range(MAX_REDIRECTS + 1):
            parts, found = addresses(url, self.allow_private)
            try:
                connection = _connection(parts, found, self.timeout)
                try:
                    target = urllib.parse.quote(urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, "")), safe="/?&=%:;,@+$!*'()~#[]")
                    host = parts.netloc.rpartition("@")[2]
                    connection.request("GET", target, headers={"Host": host, "User-Agent": "docpool", "Accept": "text/*"})
                    answer = connection.getresponse()
                    if answer.status in (301, 302, 303, 307, 308) and answer.getheader("Location"):
                        url = urllib.parse.urljoin(url, str(answer.getheader("Location")))
                        continue
                    return self._text(answer, url)
                finally:
                    connection.close()
            except (OSError, http.client.HTTPException) as e:
                raise ContentError(f"{url}: {e}") from e
        raise ContentError(f"more than {MAX_REDIRECTS} redirects: {url}")

    def _text(self, answer: http.client.HTTPResponse, url: str) -> str:
        if not 200 <= answer.status < 300:
            raise ContentError(f"status {answer.status}: {url}")
        kind = answer.getheader("Content-Type") or ""
        if kind and not kind.lower().startswith("text/"):
            raise ContentError(f"not a text: {kind} ({url})")
        body = answer.read(self.max_bytes + 1)
        if len(body) > self.max_bytes:
            raise ContentError(f"more than {self.max_bytes} bytes: {url}")
        return body.decode("utf-8", "replace")


def read_local(path: str) -> str:
    """The text of a local file by its absolute path: no `..`, a plain file, at most MAX_FILE bytes.

    On a cluster this runs in the tasks, so the path must be one that all executors see, such as a shared mount.
    """
    if not path or not os.path.isabs(path):
        raise ContentError(f"not an absolute path: {path!r}")
    if ".." in path.split(os.sep):
        raise ContentError(f"a path with '..': {path!r}")
    try:
        real = os.path.realpath(path, strict=True)
        size = os.stat(real).st_size
    except OSError as e:
        raise ContentError(f"{path}: {e}") from e
    if not os.path.isfile(real):
        raise ContentError(f"{real!r} is no plain file")
    if size > MAX_FILE:
        raise ContentError(f"{size} bytes are more than {MAX_FILE}: {real!r}")
    with open(real, encoding="utf-8", errors="replace") as f:
        return f.read()


def resolve(docs: DataFrame, fetcher: Fetcher, read: Callable[[str], str] = read_local) -> DataFrame:
    """docs (pos, path, content, url, local_path) as (pos, path, content, error): contents, or why there is none.

    Fetching and reading run in the tasks, in batches. A document needs a path and exactly one source.
    """

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, errors = [], []
            for path, content, url, local, n in zip(batch["path"], batch["content"], batch["url"], batch["local_path"], batch["given"], strict=True):
                text, error = None, None
                try:
                    if not path:
                        raise ContentError("a path is required")
                    if n != 1:
                        raise ContentError("exactly one of content, url and local_path is required")
                    text = content or (fetcher.fetch(url) if url else read(local))
                except Exception as e:  # noqa: BLE001 - any failure is this document's alone
                    error = str(e)
                contents.append(text)
                errors.append(error)
            yield pd.DataFrame({"pos": batch["pos"], "path": batch["path"], "content": contents, "error": errors})

    blank = lambda c: F.coalesce(c, F.lit(""))
    asked = docs.select("pos", blank(F.col("path")).alias("path"), *[blank(F.col(c)).alias(c) for c in ("content", "url", "local_path")])
    asked = asked.withColumn("given", sources_given(F.col("content"), F.col("url"), F.col("local_path")))
    return asked.mapInPandas(get, "pos long, path string, content string, error string")
