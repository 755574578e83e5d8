"""Statistics that Parquet files carry: exact null counts and extrema from footers, distinct candidates from dictionaries.

Reads footers and dictionary pages only, never data pages.  Dictionaries of fixed-width columns are decoded from their
page: a compact-protocol page header, then plain little-endian values.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import numpy as np

_PLAIN = {"FLOAT": np.dtype("<f4"), "DOUBLE": np.dtype("<f8"), "INT32": np.dtype("<i4"), "INT64": np.dtype("<i8")}
_DICTIONARY = {"PLAIN_DICTIONARY", "RLE_DICTIONARY"}


class _Compact:
    """Just enough of the compact protocol to walk a page header."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            n = self.varint()
            return (n >> 1) ^ -(n & 1)
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            return None
        if kind in (9, 10):
            head = self.byte()
            n, inner = head >> 4, head & 15
            if n == 15:
                n = self.varint()
            return [self.byte() if inner in (1, 2) else self.value(inner) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"compact type {kind}")

    def struct(self) -> dict[int, object]:
        out: dict[int, object] = {}
        field = 0
        while (head := self.byte()) != 0:
            if head >> 4:
                field += head >> 4
            else:
                n = self.varint()
                field = (n >> 1) ^ -(n & 1)
            out[field] = self.value(head & 15)
        return out


def file_system(uri: str):
    """(file system of Arrow, path) for a path as Spark names it (``file:/...`` with escapes, or another file system)."""
    import pyarrow.fs as pafs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return pafs.FileSystem.from_uri(uri)


def open_file(uri: str):
    fs, path = file_system(uri)
    return fs.open_input_file(path)


def dictionary(source, chunk) -> np.ndarray | None:
    """All distinct values of a column chunk, or None where its dictionary does not cover every value."""
    import pyarrow as pa

    kind = _PLAIN.get(chunk.physical_type)
    if kind is None or not chunk.has_dictionary_page or chunk.dictionary_page_offset is None:
        return None
    start = chunk.dictionary_page_offset
    source.seek(start)
    data = source.read(min(chunk.total_compressed_size, max(64, chunk.data_page_offset - start)))
    reader = _Compact(data)
    head = reader.struct()
    if head.get(1) != 2:  # not a dictionary page
        return None
    body = data[reader.at : reader.at + head[3]]
    if chunk.compression not in ("UNCOMPRESSED", ""):
        body = pa.Codec(chunk.compression.lower()).decompress(body, decompressed_size=head[2]).to_pybytes() if head[2] else b""
    return np.frombuffer(body, kind, count=head[7][1])


def covered(source, chunk) -> bool:
    """Whether every data page of the chunk points into its dictionary.  Writers that overflow a dictionary go on with plain
    pages; the footer's list of encodings does not tell that apart, so the page headers are read (not the pages)."""
    at, end, seen = chunk.data_page_offset, chunk.data_page_offset, 0
    start = chunk.dictionary_page_offset or chunk.data_page_offset
    end = start + chunk.total_compressed_size
    while seen < chunk.num_values and at < end:
        source.seek(at)
        reader = _Compact(source.read(min(4096, end - at)))
        try:
            head = reader.struct()
        except IndexError:
            return False  # a page header longer than what was read
        page = head.get(5) or head.get(8)
        if not page:
            return False
        encoding = page.get(2) if 5 in head else page.get(4)
        if encoding not in (2, 8):
            return False
        seen += page[1]
        at += reader.at + head[3]
    return seen >= chunk.num_values


def chunk_facts(source, metadata, group: int, column: int, dictionaries: bool = True) -> dict:
    """nulls, low, high (None where the footer has no valid ones) and values (None where no dictionary covers the chunk).

    Extrema of floating point chunks leave NaN out; only a covering dictionary tells whether there is one.
    """
    chunk = metadata.row_group(group).column(column)
    stats = chunk.statistics if chunk.is_stats_set else None
    nulls = stats.null_count if stats is not None and stats.has_null_count else None
    low = high = None
    if stats is not None and stats.has_min_max and stats.min == stats.min and stats.max == stats.max:
        low, high = stats.min, stats.max
    values = None
    if dictionaries and chunk.physical_type in _PLAIN and chunk.has_dictionary_page and covered(source, chunk):
        values = dictionary(source, chunk)
    return {"nulls": nulls, "low": low, "high": high, "values": values}
