"""Ticks from a live service as a streaming source: ``spark.readStream.format("tick_feed")``.

The service is spoken to in JSON over a WebSocket. It says its time and gives the ticks of a symbol between two times, so an
offset is a time, a batch can be asked for again, and nothing is lost between a connection that breaks and the next one. Each
symbol and slice of time is a partition with a connection of its own in the task that reads it. A connection that breaks
or isn't made in time is made again, to the next of the addresses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import socket
import ssl
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed value: the text that the WebSocket protocol (RFC 6455) appends to a key.
_GUID = b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
#: Ticks that one request brings at most.
PAGE = 5_000

SCHEMA = "symbol string, epoch long, k int, price double"


class FeedError(RuntimeError):
    """The service refuses a request, or can't be reached."""


class WebSocket:
    """A client's side of one connection, for text messages."""

    def __init__(self, url: str, timeout: float):
        at = urlparse(url)
        secure = at.scheme == "wss"
        self._s = socket.create_connection((at.hostname, at.port or (443 if secure else 80)), timeout)
        if secure:
            self._s = ssl.create_default_context().wrap_socket(self._s, server_hostname=at.hostname)
        self._f = self._s.makefile("rb")
        key = base64.b64encode(os.urandom(16))
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        self._s.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key.decode()}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        status, head = self._f.readline(), {}
        while (line := self._f.readline()).strip():
            name, _, value = line.decode("latin-1").partition(":")
            head[name.lower()] = value.strip()
        if b" 101 " not in status or head.get("sec-websocket-accept") != base64.b64encode(hashlib.sha1(key + _GUID).digest()).decode():
            raise ConnectionError(f"no WebSocket at {url}")

    def _frame(self, opcode: int, data: bytes) -> None:
        n, mask = len(data), os.urandom(4)
        size = struct.pack("!B", 128 | n) if n < 126 else struct.pack("!BH", 254, n) if n < 65_536 else struct.pack("!BQ", 255, n)
        self._s.sendall(bytes([128 | opcode]) + size + mask + bytes(b ^ mask[i & 3] for i, b in enumerate(data)))

    def send(self, text: str) -> None:
        self._frame(1, text.encode())

    def _read(self, n: int) -> bytes:
        data = self._f.read(n)
        if len(data) < n:
            raise ConnectionError("the connection is closed")
        return data

    def receive(self) -> str:
        """The next message; pings are answered on the way."""
        whole = b""
        while True:
            first, size = self._read(2)
            n = size & 127
            n = struct.unpack("!H", self._read(2))[0] if n == 126 else struct.unpack("!Q", self._read(8))[0] if n == 127 else n
            mask = self._read(4) if size & 128 else b""
            data = self._read(n)
            if mask:
                data = bytes(b ^ mask[i & 3] for i, b in enumerate(data))
            opcode = first & 15
            if opcode == 8:
                raise ConnectionError("the service closed the connection")
            if opcode == 9:
                self._frame(10, data)
            elif opcode < 3:
                whole += data
                if first & 128:
                    return whole.decode()

    def close(self) -> None:
        self._f.close()
        self._s.close()


class Feed:
    """Requests to a service at one of several addresses."""

    def __init__(self, urls: list[str], wait: float = 3.0, tries: int = 20, timeout: float = 8.0):
        self.urls, self.wait, self.tries, self.timeout = urls, wait, tries, timeout
        self._socket: WebSocket | None = None
        self._at = self._asked = 0
        self.reconnects = 0

    def ask(self, message: dict) -> dict:
        """The answer to ``message``, by its number; what the service sends unasked is passed over."""
        problem: Exception | None = None
        for n in range(self.tries):
            if n:
                time.sleep(self.wait)
            try:
                if self._socket is None:
                    self._socket = WebSocket(self.urls[self._at % len(self.urls)], self.timeout)
                self._asked += 1
                self._socket.send(json.dumps({**message, "req_id": self._asked}))
                while True:
                    said = json.loads(self._socket.receive())
                    if said.get("req_id") == self._asked:
                        break
            except (OSError, ValueError) as e:
                problem = e
                self.close()
                self._at += 1
                self.reconnects += 1
                continue
            if "error" in said:
                raise FeedError(str(said["error"].get("message", said["error"])))
            return said
        raise FeedError(f"no answer from {self.urls} in {self.tries} tries") from problem

    def now(self) -> int:
        return int(self.ask({"time": 1})["time"])

    def ticks(self, symbol: str, start: int, end: int, page: int = PAGE) -> Iterator[tuple[str, int, int, float]]:
        """(symbol, epoch, k, price) from ``start`` to ``end``, both included, k numbering the ticks of a second. A full page may
        end within a second, so the next begins with that second again."""
        while start <= end:
            got = self.ask({"ticks_history": symbol, "style": "ticks", "start": start, "end": end, "count": page})["history"]
            times, prices = [int(t) for t in got["times"]], [float(p) for p in got["prices"]]
            again = times[-1] if len(times) >= page else None
            if again is not None and times[0] == again:
                raise FeedError(f"{symbol} has more than {page} ticks in second {again}")
            k, last = 0, None
            for t, p in zip(times, prices, strict=True):
                if t == again:
                    break
                k, last = (k + 1 if t == last else 0), t
                yield symbol, t, k, p
            if again is None:
                return
            start = again

    def close(self) -> None:
        if self._socket is not None:
            self._socket.close()
        self._socket = None


@dataclass
class Slice(InputPartition):
    symbol: str
    start: int
    end: int


class _Settings:
    def __init__(self, options: dict):
        self.urls = [u.strip() for u in options["urls"].split(",")]
        self.symbols = [s.strip() for s in options["symbols"].split(",")]
        self.wait, self.tries, self.timeout = float(options.get("wait", 3)), int(options.get("tries", 20)), float(options.get("timeout", 8))
        self.slice, self.lag, self.page = int(options.get("slice", 3600)), int(options.get("lag", 1)), int(options.get("page", PAGE))
        self.start = int(options["start"]) if "start" in options else None
        self.end = int(options["end"]) if "end" in options else None

    def feed(self) -> Feed:
        return Feed(self.urls, self.wait, self.tries, self.timeout)

    def now(self) -> int:
        feed = self.feed()
        try:
            return feed.now()
        finally:
            feed.close()

    def slices(self, start: int, end: int) -> list[Slice]:
        return [Slice(s, a, min(a + self.slice - 1, end)) for s in self.symbols for a in range(start, end + 1, self.slice)]

    def read(self, part: Slice) -> Iterator[tuple]:
        feed = self.feed()
        try:
            yield from feed.ticks(part.symbol, part.start, part.end, self.page)
        finally:
            feed.close()


class History(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self) -> list[Slice]:
        end = self.settings.end if self.settings.end is not None else self.settings.now()
        return self.settings.slices(self.settings.start or 0, end)

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.settings.read(partition)


class Live(DataSourceStreamReader):
    """Offsets are times: a batch has the ticks after its start up to and with its end, ``lag`` seconds before the service's
    time, when a second has all its ticks."""

    def __init__(self, settings: _Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return {"epoch": self.settings.start - 1 if self.settings.start is not None else self.settings.now() - self.settings.lag}

    def latestOffset(self) -> dict:
        return {"epoch": self.settings.now() - self.settings.lag}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self.settings.slices(start["epoch"] + 1, end["epoch"])

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.settings.read(partition)

    def commit(self, end: dict) -> None:
        """The service keeps its history; there is nothing to let go."""


class TickFeed(DataSource):
    """Options: urls, symbols (both separated by commas), start and end (seconds), slice (seconds of a partition), lag, wait,
    tries, timeout (seconds), page."""

    @classmethod
    def name(cls) -> str:
        return "tick_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> History:
        return History(_Settings(self.options))

    def streamReader(self, schema) -> Live:
        return Live(_Settings(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TickFeed)
