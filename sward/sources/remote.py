"""A CSV file behind a URL as a Spark data source: tasks fetch byte ranges, the driver only the header."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "sward_remote_csv"
# Bytes of one task's range, and of one read from a stream.
RANGE_BYTES = 32 * 1024**2
CHUNK_BYTES = 1024**2


def remote_size(url: str) -> int | None:
    """Bytes of the file, None where the server does not tell."""
    if urlsplit(url).scheme == "file":
        return os.path.getsize(unquote(urlsplit(url).path))
    with urlopen(Request(url, method="HEAD")) as response:  # noqa: S310 - the caller names the address
        length = response.headers.get("Content-Length")
    return None if length is None else int(length)


def remote_bytes(url: str, start: int) -> Iterator[bytes]:
    """The file's bytes from ``start`` on, in chunks; the caller stops when it has enough."""
    if urlsplit(url).scheme == "file":
        with open(unquote(urlsplit(url).path), "rb") as stream:
            stream.seek(start)
            while chunk := stream.read(CHUNK_BYTES):
                yield chunk
        return
    request = Request(url, headers={"Range": f"bytes={start}-"} if start else {})
    with urlopen(request) as response:  # noqa: S310
        # a server that knows no ranges sends the file from its beginning
        skip = start if start and response.status != 206 else 0
        while chunk := response.read(CHUNK_BYTES):
            if skip < len(chunk):
                yield chunk[skip:]
            skip = max(0, skip - len(chunk))


def lines_from(url: str, start: int, end: int | None) -> Iterator[str]:
    """Lines whose first byte is in [start, end); a line that begins before the range is not in it."""
    at = max(0, start - 1)  # the byte before the range tells whether a line begins with it
    rest, skipping = b"", start > 0
    for chunk in remote_bytes(url, at):
        parts = (rest + chunk).split(b"\n")
        rest = parts.pop()
        for part in parts:
            begin, at = at, at + len(part) + 1
            if skipping:
                skipping = False
                continue
            if end is not None and begin >= end:
                return
            yield part.decode("utf-8").rstrip("\r")
        if skipping and len(rest) > CHUNK_BYTES:
            at, rest = at + len(rest), b""  # what is skipped need not be kept
    if rest and not skipping and (end is None or at < end):
        yield rest.decode("utf-8").rstrip("\r")


class _Range(InputPartition):
    def __init__(self, start: int, end: int | None):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.step = options["url"], int(options.get("rangebytes", RANGE_BYTES))
        self.columns = json.loads(options["columns"])

    def _header(self) -> list[str]:
        first = next(lines_from(self.url, 0, 1), "")
        return next(csv.reader([first.removeprefix("﻿")]), [])

    def partitions(self) -> list[InputPartition]:
        missing = [c for c in self.columns if c not in self._header()]
        if missing:
            raise ValueError(f"columns missing from {self.url}: {missing}")
        size = remote_size(self.url)
        if size is None:
            return [_Range(0, None)]
        return [_Range(at, min(size, at + self.step)) for at in range(0, max(size, 1), self.step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        places = [self._header().index(c) for c in self.columns]
        lines = lines_from(self.url, partition.start, partition.end)
        if partition.start == 0:
            next(lines, None)
        for line in lines:
            if line:
                cells = next(csv.reader([line]))
                yield tuple(
                    cells[i] if i < len(cells) and cells[i] not in ("", "NA") else None for i in places
                )


class RemoteCsv(DataSource):
    """Options: ``url``, ``columns`` (JSON list of names), ``rangeBytes``. All columns are text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> DataSourceReader:
        return _Reader({key.lower(): value for key, value in self.options.items()})
