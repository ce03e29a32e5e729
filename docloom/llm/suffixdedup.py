"""Exact removal of repeated byte strings: a byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller doc_id.

1. Filter. Each string of LENGTH bytes has one anchor, the ``WIDE``-byte string in it with the least hash (the leftmost of equal ones), which
   depends on its bytes alone. Anchors are dealt by their hash; a string whose anchor is in one document only is in one document only and leaves.
2. Dealing. What stays is anchored again, by ``GRAM`` bytes. Neighbouring strings with one anchor form an entry, at most LENGTH - GRAM + 1 strings,
   stored as the bytes they cover. Entries are dealt by their anchor, so all copies of a string meet in one bucket; nothing is sampled.
3. In a bucket, equal entries become one, which keeps the least doc_id of its copies. Strings whose hash no other entry, or no other document, has
   are decided by that. A suffix array of the distinct runs of the others is made by linear grouping construction (gsaca.py). Its intervals with common prefixes of LENGTH or more are the classes of equal strings; the
   least doc_id of a class keeps its strings. (``windows`` finds the classes by hashes and byte comparison instead; both give the same rows.)
4. The spans found go back to their documents, where what stays is put together.

Hot passages: a task that cuts texts collapses equal anchors and equal entries first, so a passage that very many documents share reaches its bucket
once per task, about ``BLOCK`` or ``TEXT_BYTES`` of text, not once per document; what is decided on the spot travels by any bucket. Whole copies of a text with a
smaller doc_id are known by digest and don't take part, so a large group of copies costs one text.

Defined results: a null text is empty. A document without id neither removes from others nor loses anything. Documents with one id don't remove
from each other; rows equal in id and text get equal results. Ids must be integers (others are refused: their order would not be defined). An empty
table gives an empty one. A very long text is anchored in blocks; its home holds it whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, table, text_key
from .gsaca import suffix_array

LENGTH = 50
GRAM = 12
WIDE = 20
BUCKET_BYTES = 2_000_000
#: Bytes of text whose anchors one bucket of the filter holds.
FILTER_BYTES = 32_000_000
TEXT_BYTES = 8_000_000
#: Bytes whose equal anchors and entries are collapsed at once.
BLOCK = 1 << 22
#: Strings that are hashed at once; positions among them take 24 bits.
_STRINGS = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashes(b: np.ndarray, length: int) -> np.ndarray:
    """Hash of b[i : i + length] for each i, from hashes of lengths that double."""
    with np.errstate(over="ignore"):
        h, p, width = b.astype(np.uint64) + np.uint64(1), _ODD, 1
        full, have = (h, 1) if length & 1 else (None, 0)
        while 2 * width <= length:
            h, p, width = h[:-width] * p + h[width:], p * p, 2 * width
            if length & width:
                full, have = (h, width) if full is None else (full[: len(b) - have - width + 1] * p + h[have:], have + width)
        return _mix(full)


def entries(b: np.ndarray, ends: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents joined into b: first string, number of strings and anchor hash of each entry."""
    w = LENGTH - gram + 1
    if len(b) < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    strings = len(b) - LENGTH + 1
    ok = np.ones(len(b), dtype=bool)
    for e in ends.tolist():
        ok[max(0, e - LENGTH + 1) : e] = False
    first, at, hashes = [], [], []
    for lo in range(0, strings, _STRINGS):
        h = _hashes(b[lo : lo + _STRINGS + LENGTH - 1], gram)
        m = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= w:
            m, width = np.minimum(m[:-width], m[width:]), 2 * width
        if width < w:
            m = np.minimum(m[: len(m) - (w - width)], m[w - width :])
        anchor = np.where(ok[lo : lo + len(m)], (m & np.uint64(0xFFFFFF)).astype(np.int64), -1)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        anchor = anchor[new]
        first.append(new + lo)
        at.append(np.where(anchor < 0, -1, anchor + lo))
        hashes.append(h[anchor])
    first, at, h = np.concatenate(first), np.concatenate(at), np.concatenate(hashes)
    new = np.concatenate([[True], at[1:] != at[:-1]])  # an entry may go on in the next part
    first, at, h = first[new], at[new], h[new]
    count = np.diff(np.append(first, strings))
    use = at >= 0
    return first[use], count[use], h[use]


def _compress(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a).tobytes())


def _expand(x: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=dtype)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal values."""
    if not len(key):
        return (np.zeros(0, dtype=np.int64),) * 2
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return new, np.append(new[1:], len(key))


def _stack(rows: pd.DataFrame, **kinds) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, dtype=t), *[_expand(x, t) for x in rows[c]]]) for c, t in kinds.items()]


def _blobs(columns: list[str], deal: np.ndarray, *arrays: np.ndarray, extra: tuple = ()) -> list[tuple]:
    """A row (bucket, n, *extra, *compressed arrays) for each value of deal; the arrays keep their order in a bucket."""
    order = np.argsort(deal, kind="stable")
    deal, arrays = deal[order], [a[order] for a in arrays]
    return [(int(deal[lo]), int(hi - lo), *extra, *[_compress(a[lo:hi]) for a in arrays]) for lo, hi in zip(*_runs(deal), strict=True)]


def _extremes(number: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, number, low)
    np.maximum.at(most, number, high)
    return least, most


#: kind 0: ask about (hash, doc, row, start, count); 1: it is known that other documents have it, pass it on; 2: (hash, doc) of documents that need no answer.
ASKED = "bucket long, n long, kind int, hash binary, doc binary, row binary, start binary, count binary"
FOUND = "home long, n long, strings long, doc binary, row binary, start binary, count binary"


def _anchors(buckets: int):
    """ASKED rows of whole texts."""
    names = [c.split()[0] for c in ASKED.split(", ")]

    def flush(parts: list) -> pd.DataFrame:
        b = np.concatenate([p[0] for p in parts])
        ends = np.cumsum([len(p[0]) for p in parts])
        starts = ends - [len(p[0]) for p in parts]
        first, count, h = entries(b, ends, WIDE)
        part = np.searchsorted(ends, first, "right")
        doc, row, offset = (np.array([p[k] for p in parts], dtype=np.int64)[part] for k in (1, 2, 3))
        start, count = (first - starts[part] + offset).astype(np.uint32), count.astype(np.uint8)
        kinds, number = np.unique(h, return_inverse=True)
        least, most = _extremes(number, len(kinds), doc, doc)
        known = (least != most)[number]
        short = (h >> np.uint64(32)).astype(np.uint32)
        bucket = (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        ask, told = ~known, least != most
        out = _blobs(names, bucket[ask].astype(np.int64), short[ask], doc[ask], row[ask], start[ask], count[ask], extra=(0,))
        none = np.zeros(0, dtype=np.uint32)
        if known.any():
            out += [(k, n, kind, _compress(none), *rest) for k, n, kind, *rest in _blobs(names, (row[known].view(np.uint64) % np.uint64(buckets)).astype(np.int64), doc[known], row[known], start[known], count[known], extra=(1,))]
            e = kinds[told]
            two = np.repeat(e, 2), np.stack([least[told], most[told]], axis=1).ravel()
            out += [(*x, *[_compress(none)] * 3) for x in _blobs(names, ((two[0] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64), (two[0] >> np.uint64(32)).astype(np.uint32), two[1], extra=(2,))]
        return pd.DataFrame(out, columns=names)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for pdf in batches:
            for doc, row, text in zip(pdf["doc"].tolist(), pdf["row"].tolist(), pdf["text"], strict=True):
                b = np.frombuffer(text, dtype=np.uint8)
                for s in range(0, max(1, len(b) - LENGTH + 1), BLOCK):
                    piece = b[s : s + BLOCK + LENGTH - 1]
                    parts.append((piece, doc, row, s))
                    size += len(piece)
                    if size >= BLOCK:
                        yield flush(parts)
                        parts, size = [], 0
        if parts:
            yield flush(parts)

    return emit


def _filter(homes: int):
    """FOUND rows: the entries whose anchor other documents have too."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = {"hash": np.uint32, "doc": np.int64, "row": np.int64, "start": np.uint32, "count": np.uint8}
        ask, known, told = (pdf[pdf["kind"] == k] for k in (0, 1, 2))
        h, doc, row, start, count = _stack(ask, **kinds)
        h2, doc2 = _stack(told, hash=np.uint32, doc=np.int64)
        values, number = np.unique(np.concatenate([h, h2]), return_inverse=True)
        docs = np.concatenate([doc, doc2])
        least, most = _extremes(number, len(values), docs, docs)
        hit = (least != most)[number[: len(h)]]
        _, *passed = _stack(known, **kinds)
        doc, row, start, count = (np.concatenate([a[hit], p]) for a, p in zip((doc, row, start, count), passed, strict=True))
        order = np.lexsort([start, row])
        doc, row, start, count = doc[order], row[order], start[order], count[order]
        home = (row.view(np.uint64) % np.uint64(homes)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sums = np.add.reduceat(count[order].astype(np.int64), _runs(home[order])[0]) if len(home) else []
        return pd.DataFrame([(k, n, int(z), *rest) for (k, n, *rest), z in zip(_blobs(names, home, doc, row, start, count), sums, strict=True)], columns=names)

    return run


#: kind 0: entries to be compared; 1: spans already known to go (size in count).
DEALT = "bucket long, n long, kind int, doc binary, row binary, start binary, count binary, bytes binary"


def _deal(buckets: int):
    """DEALT rows of one home: texts, and the entries of its texts that passed the filter."""
    names = [c.split()[0] for c in DEALT.split(", ")]

    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        if not len(found) or not len(texts):
            return pd.DataFrame([], columns=names)
        doc, row, start, count = _stack(found, doc=np.int64, row=np.int64, start=np.uint32, count=np.uint8)
        order = np.lexsort([start, row, doc])
        doc, row, start, count = doc[order], row[order], start[order].astype(np.int64), count[order].astype(np.int64)
        whole = np.flatnonzero((np.diff(doc, prepend=doc[0] - 1) != 0) | (np.diff(row, prepend=row[0] - 1) != 0))
        at = {(int(doc[lo]), int(row[lo])): (lo, hi) for lo, hi in zip(whole, np.append(whole[1:], len(doc)), strict=True)}
        expand, out, parts, size, seen = zstandard.ZstdDecompressor(), [], [], 0, set()
        for d, r, packed in zip(texts["doc"].tolist(), texts["row"].tolist(), texts["packed"], strict=True):
            if (d, r) not in at or (d, r) in seen:  # rows equal in id and text are one document
                continue
            seen.add((d, r))
            b = np.frombuffer(expand.decompress(packed), dtype=np.uint8)
            lo, hi = at[d, r]
            s, e = start[lo:hi], start[lo:hi] + count[lo:hi]
            head = np.flatnonzero(np.concatenate([[True], s[1:] > np.maximum.accumulate(e)[:-1]]))
            for x, y in zip(s[head].tolist(), np.maximum.reduceat(e, head).tolist(), strict=True):
                for z in range(x, y, BLOCK):
                    piece = b[z : min(y, z + BLOCK) + LENGTH - 1]
                    parts.append((piece, d, r, z))
                    size += len(piece)
                    if size >= BLOCK:
                        out += deal(parts)
                        parts, size = [], 0
        if parts:
            out += deal(parts)
        return pd.DataFrame(out, columns=names)

    def deal(parts: list) -> list[tuple]:
        b = np.concatenate([p[0] for p in parts])
        ends = np.cumsum([len(p[0]) for p in parts])
        starts = ends - [len(p[0]) for p in parts]
        first, count, h = entries(b, ends, GRAM)
        part = np.searchsorted(ends, first, "right")
        doc, row, offset = (np.array([p[k] for p in parts], dtype=np.int64)[part] for k in (1, 2, 3))
        start = (first - starts[part] + offset).astype(np.uint32)
        bucket = ((h >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
        size = count + LENGTH - 1
        number = _same(b, first, size)
        least, _ = _extremes(number, number.max() + 1 if len(number) else 0, doc, doc)
        gone = doc > least[number]  # decided on the spot
        out = []
        if gone.any():
            any_bucket = (row[gone].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            out += [(*x, _compress(np.zeros(0, dtype=np.uint8))) for x in _blobs(names, any_bucket, doc[gone], row[gone], start[gone], size[gone].astype(np.uint8), extra=(1,))]
        stay = np.flatnonzero(~gone)
        stay = stay[np.lexsort([h[stay], bucket[stay]])]
        for lo, hi in zip(*_runs(bucket[stay]), strict=True):
            k = stay[lo:hi]
            n = size[k]
            at = np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((int(bucket[k[0]]), len(k), 0, _compress(doc[k]), _compress(row[k]), _compress(start[k]), _compress(count[k].astype(np.uint8)), _compress(b[at])))
        return out

    return run


def _same(b: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each piece b[begin : begin + size]; equal pieces, and only these, have equal numbers."""
    data, seen = b.tobytes(), {}
    return np.fromiter((seen.setdefault(data[s : s + n], len(seen)) for s, n in zip(begin.tolist(), size.tolist(), strict=True)), dtype=np.int64, count=len(begin))


def _by_windows(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A class number for each string b[at : at + LENGTH]."""
    key = np.empty(len(at), dtype=np.uint64)
    for lo in range(0, len(at), _STRINGS):
        part = at[lo : lo + _STRINGS]
        key[lo : lo + _STRINGS] = _hashes(b[part[0] : part[-1] + LENGTH], LENGTH)[part - part[0]]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    number = np.empty(len(at), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    head = at[order[new]][number]
    other = np.flatnonzero(head != at)
    wrong = np.zeros(len(at), dtype=bool)
    for k in range(0, LENGTH, 8):
        o = min(k, LENGTH - 8)
        v = np.lib.stride_tricks.sliding_window_view(b, 8)
        wrong[other] |= (v[at[other] + o] != v[head[other] + o]).any(axis=1)
    if wrong.any():  # two strings with one hash: tell the strings of that hash apart by their bytes
        odd = np.flatnonzero(np.isin(number, number[wrong]))
        names: dict = {}
        for i in odd.tolist():
            number[i] = names.setdefault(b[at[i] : at[i] + LENGTH].tobytes(), number.max() + 1 + len(names))
    return number


def _by_grouping(b: np.ndarray, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same classes from the suffix array of the distinct pieces b[begin : begin + size], each ended by a least symbol. Strings are in pieces; at is in order."""
    names = _same(b, begin, size)
    _, rep = np.unique(names, return_index=True)
    n = size[rep] + 1
    base = np.cumsum(n) - n
    text = np.zeros(n.sum(), dtype=np.uint16)
    inside = np.repeat(begin[rep] - base, size[rep])
    where = np.concatenate([np.arange(x, x + k) for x, k in zip(base.tolist(), size[rep].tolist(), strict=True)]) if len(rep) else np.zeros(0, dtype=np.int64)
    text[where] = b[inside + where].astype(np.uint16) + 1
    switched = gc.isenabled()
    gc.disable()  # nothing here is in a cycle, and the lists are long
    try:
        order = np.array(suffix_array(text), dtype=np.int64)
    finally:
        if switched:
            gc.enable()
    left = np.repeat(base + n, n) - np.arange(len(text))  # symbols up to the piece's end
    order = order[left[order] > LENGTH]
    v = np.lib.stride_tricks.sliding_window_view(text, 10) if len(order) else None
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for k in range(0, LENGTH, 10):
            new[1:] |= (v[order[1:] + k] != v[order[:-1] + k]).any(axis=1)
    name = np.zeros(len(text), dtype=np.int64)
    name[order] = np.cumsum(new) - 1
    piece = np.searchsorted(begin, at, "right") - 1
    return name[base[names[piece]] + at - begin[piece]]


def _shared(b: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which strings b[at : at + LENGTH] of distinct entries have a hash that another one has too, in more than one document. low, high: least and most doc of the string's entry."""
    key = np.empty(len(at), dtype=np.uint64)
    for lo in range(0, len(at), _STRINGS):
        part = at[lo : lo + _STRINGS]
        key[lo : lo + _STRINGS] = _hashes(b[part[0] : part[-1] + LENGTH], LENGTH)[part - part[0]]
    order = np.argsort(key, kind="stable")
    head, _ = _runs(key[order])
    size = np.diff(np.append(head, len(key)))
    hit = np.zeros(len(at), dtype=bool)
    if len(head):
        hit[order] = np.repeat((size > 1) & (np.minimum.reduceat(low[order], head) != np.maximum.reduceat(high[order], head)), size)
    return hit


SPAN = "home long, n long, doc binary, row binary, start binary, size binary"


def _resolve(homes: int, construction: str):
    names = [c.split()[0] for c in SPAN.split(", ")]

    def spans(doc, row, start, size) -> list[tuple]:
        order = np.lexsort([start, row])
        doc, row, start, size = doc[order], row[order], start[order], size[order]
        return _blobs(names, (row.view(np.uint64) % np.uint64(homes)).astype(np.int64), doc, row, start.astype(np.uint32), size.astype(np.uint8))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = {"doc": np.int64, "row": np.int64, "start": np.uint32, "count": np.uint8}
        out = spans(*_stack(pdf[pdf["kind"] == 1], **kinds))
        doc, row, start, count, b = _stack(pdf[pdf["kind"] == 0], **kinds, bytes=np.uint8)
        if not len(doc):
            return pd.DataFrame(out, columns=names)
        start, count = start.astype(np.int64), count.astype(np.int64)
        size = count + LENGTH - 1
        begin = np.cumsum(size) - size
        # equal entries become one
        entry = _same(b, begin, size)
        _, rep = np.unique(entry, return_index=True)
        least, most = _extremes(entry, len(rep), doc, doc)
        n, of = count[rep], np.repeat(np.arange(len(rep)), count[rep])
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = b[np.repeat(begin[rep] - (np.cumsum(size[rep]) - size[rep]), size[rep]) + np.arange(size[rep].sum())]
        base = np.cumsum(size[rep]) - size[rep]
        at = base[of] + within
        keep = _shared(text, at, least[of], most[of])
        best = least[of]  # per string the least doc that has it: that of its entry, unless other entries have it
        if keep.any():
            k = np.flatnonzero(keep)
            if construction == "windows":
                number = _by_windows(text, at[k])
            else:  # pieces: runs of the strings that stay
                head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1] + 1) | (of[k][1:] != of[k][:-1])]))
                length = np.diff(np.append(head, len(k)))
                number = _by_grouping(text, at[k], at[k[head]], length + LENGTH - 1)
            low, _ = _extremes(number, number.max() + 1, least[of[k]], least[of[k]])
            best[k] = low[number]
        # back to the occurrences
        begin_of = np.cumsum(n) - n
        occ = np.repeat(np.arange(len(doc)), count)
        inner = np.arange(len(occ)) - np.repeat(np.cumsum(count) - count, count)
        gone = np.flatnonzero(doc[occ] > best[begin_of[entry[occ]] + inner])
        if len(gone):
            head = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (occ[gone][1:] != occ[gone][:-1])]))
            length = np.diff(np.append(head, len(gone)))
            o = occ[gone[head]]
            out += spans(doc[o], row[o], start[o] + inner[gone[head]], length + LENGTH - 1)
        return pd.DataFrame(out, columns=names)

    return resolve


RESULT = "doc long, row long, n_bytes long, n_removed long, n_spans long, kept binary"


def _apply(keep_text: bool):
    def apply(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        out = []
        found: dict = {}
        if len(spans):
            doc, row, start, size = _stack(spans, doc=np.int64, row=np.int64, start=np.uint32, size=np.uint8)
            order = np.lexsort([start, row, doc])
            doc, row, start, size = doc[order], row[order], start[order].astype(np.int64), size[order].astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
            for lo, hi in zip(cut, np.append(cut[1:], len(doc)), strict=True):
                found[int(doc[lo]), int(row[lo])] = start[lo:hi], size[lo:hi]
        expand = zstandard.ZstdDecompressor()
        for d, r, packed in zip(texts["doc"].tolist(), texts["row"].tolist(), texts["packed"], strict=True):
            text = expand.decompress(packed)
            edge = np.zeros(len(text) + 1, dtype=np.int64)
            if (d, r) in found:
                s, z = found[d, r]
                np.add.at(edge, s, 1)
                np.add.at(edge, s + z, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if gone.any() else text
            out.append((d, r, len(text), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0, kept if keep_text else hashlib.sha256(kept).digest()))
        return pd.DataFrame(out, columns=["doc", "row", "n_bytes", "n_removed", "n_spans", "kept"])

    return apply


def _pack_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for pdf in batches:
        yield pdf.assign(packed=[z.compress(t) for t in pdf["text"]])[["home", "doc", "row", "packed"]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", construction: str = "grouping", keep_text: bool = False, bucket_bytes: int = BUCKET_BYTES, filter_bytes: int = FILTER_BYTES, home_bytes: int = TEXT_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row; kept: the bytes that stay if keep_text, else their SHA-256."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), text_key(F.col(text_col)).alias("k"))
    size = F.octet_length("text")
    total = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
    firsts = materialize(rows.groupBy("k").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    small = firsts.limit(200_001).count() <= 200_000
    marked = rows.join(F.broadcast(firsts) if small else firsts, "k", "left")
    marked = marked.withColumn("row", F.expr("conv(hex(substring(k, 1, 7)), 16, 10)").cast("long"))
    copy = F.coalesce((F.col("doc") > F.col("first")) & (size >= LENGTH), F.lit(False))
    alone = F.col("doc").isNull() | (size < LENGTH)
    searched = marked.where(~copy & ~alone)
    homes, filters = max(1, -(-total // home_bytes)), max(1, -(-total // filter_bytes))
    texts = searched.select(F.pmod("row", F.lit(homes)).alias("home"), "doc", "row", "text").mapInPandas(_pack_texts, "home long, doc long, row long, packed binary")

    asked = searched.select("doc", "row", "text").mapInPandas(_anchors(filters), ASKED)
    found = materialize(asked.groupBy("bucket").applyInPandas(_filter(homes), FOUND), "found")
    strings = found.agg(F.sum("strings")).first()[0] or 0
    # an entry's bytes are some four times its strings
    buckets = max(1, -(-4 * strings // bucket_bytes))
    dealt = texts.groupBy("home").cogroup(found.groupBy("home")).applyInPandas(_deal(buckets), DEALT)
    spans = materialize(dealt.groupBy("bucket").applyInPandas(_resolve(homes, construction), SPAN), "spans")
    discard(found)
    judged = texts.groupBy("home").cogroup(spans.groupBy("home")).applyInPandas(_apply(keep_text), RESULT)
    as_kept = (lambda c: c) if keep_text else (lambda c: F.unhex(F.sha2(c, 256)))
    rest = marked.where(copy | alone).select("doc", F.lit(0).cast("long").alias("row"), size.cast("long").alias("n_bytes"), F.when(copy, size).otherwise(0).cast("long").alias("n_removed"), F.when(copy, 1).otherwise(0).cast("long").alias("n_spans"), as_kept(F.when(copy, F.lit("").cast("binary")).otherwise(F.col("text"))).alias("kept"))
    return judged.union(rest).select(F.col("doc").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
