"""Paragraphs of binary documents: compound files with compressed record streams, and ZIP packages of XML sections.

Files are read by Spark (``binaryFile``, so any store that Spark reads) and decoded in Arrow batches, a file at a time. A damaged file gives a row with
``error`` and no paragraphs, never a failed job.
"""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.fields import detect_format

#: Fixed values of the compound file format and of the record streams in it.
OLE_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END_OF_CHAIN = 0xFFFFFFFA
PARA_TEXT = 67
COMPRESSED = 1
SIGNATURE, LOCKS = b"HWP Document File", {2: "encrypted", 4: "for distribution only"}
#: Control characters that stand alone; every other one below 32 is followed by seven more units.
SINGLE_UNITS = frozenset([0, 10, 13, *range(24, 32)])
SCHEMA = "path string, format string, paragraphs array<struct<level int, tag int, text string>>, record_count long, para_text_count long, decompressed_bytes long, error string"


class CompoundFile:
    """Streams of a compound file by path (parts joined by /)."""

    def __init__(self, data: bytes):
        if data[:8] != OLE_MAGIC or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        sector_shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.sector, self.mini_sector = 1 << sector_shift, 1 << mini_shift
        directory, self.mini_cutoff, mini_fat, _, difat, _ = struct.unpack_from("<I4xIIIII", data, 48)
        tables = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while difat < END_OF_CHAIN and difat not in seen:  # the table of tables goes on in sectors of its own
            seen.add(difat)
            *more, difat = struct.unpack(f"<{self.sector // 4}I", self._sector(difat))
            tables += more
        self.fat = [x for t in tables if t < END_OF_CHAIN for x in struct.unpack(f"<{self.sector // 4}I", self._sector(t))]
        listing = self._chain(directory)
        entries = [listing[i : i + 128] for i in range(0, len(listing) - 127, 128)]
        mini = self._chain(mini_fat)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        self.streams: dict[str, tuple[int, int]] = {}
        self.root = b""
        if entries:
            first, size = struct.unpack_from("<IQ", entries[0], 116)
            self.root = self._chain(first)[:size] if size else b""
            self._walk(entries, struct.unpack_from("<I", entries[0], 76)[0], "", set())

    def _sector(self, i: int) -> bytes:
        at = (i + 1) * self.sector
        if at + self.sector > len(self.data) + self.sector - 1:
            raise ValueError("sector beyond the end")
        return self.data[at : at + self.sector].ljust(self.sector, b"\0")

    def _chain(self, i: int) -> bytes:
        out, seen = [], set()
        while i < END_OF_CHAIN:
            if i in seen or i >= len(self.fat):
                raise ValueError("broken chain")
            seen.add(i)
            out.append(self._sector(i))
            i = self.fat[i]
        return b"".join(out)

    def _walk(self, entries: list[bytes], top: int, prefix: str, seen: set[int]) -> None:
        todo = [(top, prefix)]
        while todo:
            i, prefix = todo.pop()
            if i >= len(entries) or i in seen:
                continue
            seen.add(i)
            e = entries[i]
            length, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = struct.unpack_from("<III", e, 68)
            path = prefix + e[: max(0, length - 2)].decode("utf-16-le", "replace")
            if kind == 2:
                self.streams[path] = struct.unpack_from("<IQ", e, 116)
            todo += [(left, prefix), (right, prefix), (child, path + "/")]

    def read(self, path: str) -> bytes:
        first, size = self.streams[path]
        if size >= self.mini_cutoff:
            return self._chain(first)[:size]
        out, seen = [], set()
        while first < END_OF_CHAIN:
            if first in seen or first >= len(self.mini_fat):
                raise ValueError("broken chain")
            seen.add(first)
            out.append(self.root[first * self.mini_sector : (first + 1) * self.mini_sector])
            first = self.mini_fat[first]
        return b"".join(out)[:size]


def raw_inflate(data: bytes) -> bytes:
    """Deflate without a header. A stream that ends early is refused, and so is one of over MOST_BYTES."""
    inflater = zlib.decompressobj(-15)
    out = inflater.decompress(data, MOST_BYTES)
    if not inflater.eof:
        raise ValueError("the compressed stream is too long" if inflater.unconsumed_tail else "the compressed stream ends early")
    return out


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, content); a record that runs over the end is left out."""
    at = 0
    while at + 4 <= len(data):
        head = struct.unpack_from("<I", data, at)[0]
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                return
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        if at + size > len(data):
            return
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


def unit_text(data: bytes) -> str:
    """Text of UTF-16 units with control characters: line ends and tabs stay, other controls go with the units that belong to them."""
    units = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if u >= 32:
            out.append(u)
        elif u in (10, 13):
            out.append(10)
        elif u == 9:
            out.append(9)
        i += 1 if u >= 32 or u in SINGLE_UNITS else 8
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace").strip()


def _number(name: str) -> int:
    return int((re.findall(r"\d+", name) or ["0"])[-1])


def _flags(ole: CompoundFile) -> int:
    """The flags of the file's header; a file without the header or its signature, or that can't be read without a key, is refused."""
    header = ole.read("FileHeader") if "FileHeader" in ole.streams else b""
    if len(header) < 40 or not header.startswith(SIGNATURE):
        raise ValueError("no header of this format")
    flags = struct.unpack_from("<I", header, 36)[0]
    if locked := [name for bit, name in LOCKS.items() if flags & bit]:
        raise ValueError(f"the document is {locked[0]}")
    return flags


def decode_hwp(data: bytes) -> dict:
    ole = CompoundFile(data)
    flags = _flags(ole)
    out = {"paragraphs": [], "record_count": 0, "para_text_count": 0, "decompressed_bytes": 0}
    for name in sorted((s for s in ole.streams if re.fullmatch(r"BodyText/Section\d+", s)), key=_number):
        body = raw_inflate(ole.read(name)) if flags & COMPRESSED else ole.read(name)
        out["decompressed_bytes"] += len(body)
        for tag, level, content in records(body):
            out["record_count"] += 1
            if tag == PARA_TEXT:
                out["para_text_count"] += 1
                if text := unit_text(content):
                    out["paragraphs"].append({"level": level, "tag": tag, "text": text})
    return out


#: What elements inside a paragraph stand for.
MARKS = {"lineBreak": "\n", "tab": "\t", "nbSpace": " ", "fwSpace": " ", "hyphen": "-"}
#: The most bytes that an entry of a package or a stream may become.
MOST_BYTES = 1 << 28


def decode_hwpx(data: bytes) -> dict:
    """Texts of the p elements of each section, sections by number; a p inside another is a paragraph of its own."""
    out = {"paragraphs": [], "record_count": 0, "para_text_count": 0, "decompressed_bytes": 0}
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def text_of(e: ET.Element) -> str:
        parts = []
        for child in e:
            if local(child) == "p":
                continue
            kind = local(child)
            parts.append(MARKS[kind] if kind in MARKS else run_of(child) if kind == "t" else text_of(child))
        return "".join(parts)

    def run_of(t: ET.Element) -> str:
        """A run's text with the marks inside it."""
        inside = [MARKS.get(local(e)) or run_of(e) for e in t]
        return (t.text or "") + "".join(x + (e.tail or "") for x, e in zip(inside, t, strict=True))

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=_number):
            if z.getinfo(name).file_size > MOST_BYTES:
                raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
            body = z.read(name)
            out["decompressed_bytes"] += len(body)
            if b"<!DOCTYPE" in body:
                raise ValueError("document types are refused")
            depth = [(ET.fromstring(body), 0)]
            while depth:
                e, level = depth.pop()
                inside = local(e) == "p"
                if inside:
                    out["record_count"] += 1
                    out["para_text_count"] += 1
                    if text := text_of(e).strip():
                        out["paragraphs"].append({"level": level, "tag": 0, "text": text})
                depth += [(c, level + inside) for c in reversed(e)]
    return out


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A row per file (SCHEMA), read in parallel. An unknown or undecodable format is an error of its row; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = files.select("path", "content", detect_format(F.col("content"), F.col("path")).alias("format"))
    decoders = {"hwp": decode_hwp, "hwpx": decode_hwpx}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content, kind in zip(pdf["path"], pdf["content"], pdf["format"], strict=True):
                try:
                    got, error = (decoders[kind](content), None) if kind in decoders else ({}, f"no decoder for {kind}")
                except (ValueError, struct.error, zlib.error, KeyError, IndexError, zipfile.BadZipFile, ET.ParseError, NotImplementedError, RuntimeError) as e:
                    got, error = {}, f"{type(e).__name__}: {e}"
                rows.append((p, kind, got.get("paragraphs", []), got.get("record_count", 0), got.get("para_text_count", 0), got.get("decompressed_bytes", 0), error))
            yield pd.DataFrame(rows, columns=["path", "format", "paragraphs", "record_count", "para_text_count", "decompressed_bytes", "error"])

    return files.mapInPandas(decode, SCHEMA)


def document_text(paragraphs):
    """Column: paragraphs joined by a blank line."""
    return F.array_join(F.transform(paragraphs, lambda p: p["text"]), "\n\n")
