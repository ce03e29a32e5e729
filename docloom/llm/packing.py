"""Packing by vector bin packing under simultaneous limits on tokens, segments and loss-bearing tokens.

A document is tokenised whole and ends with an end id. It is cut into pieces of at most ``max_tokens`` ids and of at most
``max_loss`` loss-bearing ids. In a plain text all ids bear loss; instruction data come as parts (``parts_col``: text, loss), of which
those with loss bear it, and the end id. A full piece is a sequence of its own. The others are items of a vector bin packing: a sequence is opened with
the largest item left, then takes, again and again, the fitting item whose demand has the largest dot product with what
is left of the three limits, until none fits. Items of equal demand are interchangeable, so a choice is made among kinds
of demand, at most a few thousand, not among items.

Items are dealt into groups of about ``GROUP_ITEMS`` by a hash of (doc_id, start, number), each packed by itself in canonical
order; each group leaves one short sequence or so, which is the price of not packing in one task. The number is the piece's place in the
task that cut it, so equal rows, even a third of the table, are spread. It is written with the piece, so a recomputed task repeats the packing;
over another partitioning of the input the same pieces may be packed together otherwise.

Defined results: a null or empty text, and a null or empty list of parts, is the end id alone. Rows may repeat, each is packed; ties go by
(doc_id, start). Texts of any length are tokenised whole. An empty table gives no sequence. Ids pass through Python as strings, so null and
large ids come back as they were. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

MAX_TOKENS = 1024
MAX_SEGMENTS = 256
END_ID = 0
GROUP_ITEMS = 1 << 15
SCHEMA = "doc_id string, start long, length long, loss long, ids_crc32 long, doc_tokens long, number long"


class ByteBpe:
    """Ids of byte_bpe_50k, as tokenizers gives them with add_special_tokens=False.

    A text is encoded in one call, whatever its words. The string of the vocabulary's one special token becomes that token wherever it
    stands. Tests hold it against tokenizers. The pattern's engine gives up on runs of about a million blanks, so a text is cut inside each long run: all
    blanks of a run but the last one before a word, and all of them before a special token or the end, are one match of the pattern; that match is encoded
    as the one piece it is.
    """

    SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
    LONG_RUN = 10_000
    #: Unicode's White_Space, as the pattern means it.
    BLANKS = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={self.SPECIAL: self.SPECIAL_ID})

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for run in self.BLANKS.finditer(text) if len(text) >= self.LONG_RUN else ():
            end = run.end() if run.end() == len(text) or text.startswith(self.SPECIAL, run.end()) else run.end() - 1
            parts += [self._encoded(text[at : run.start()]), np.array(self.encoding._encode_single_piece(text[run.start() : end]), dtype="<u4")]
            at = end
        return np.concatenate([*parts, self._encoded(text[at:])]) if parts else self._encoded(text)

    def _encoded(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special={self.SPECIAL}).astype("<u4", copy=False)


def byte_bpe() -> ByteBpe:
    """Made on each worker; the vocabulary is where the tokenizer package is installed."""
    import public_tokenizers

    return ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _ids_and_loss(tok, text, parts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a document, and before each of them (and after the last) the number of those that bear loss."""
    if parts is None:
        ids = np.append(tok.encode(text), np.uint32(end_id)) if text else np.array([end_id], dtype="<u4")
        return ids, np.arange(len(ids) + 1)
    encoded = [(tok.encode(p["text"]), bool(p["loss"])) for p in parts if p is not None and p["text"]]
    encoded.append((np.array([end_id]), True))
    ids = np.concatenate([x for x, _ in encoded]).astype("<u4")
    return ids, np.concatenate([[0], np.cumsum(np.repeat([bears for _, bears in encoded], [len(x) for x, _ in encoded]))])


def _at_least_one(**limits: int | None) -> None:
    if bad := [k for k, v in limits.items() if v is not None and v < 1]:
        raise ValueError(f"a piece needs room for one id: {bad}")


def cut_pieces(docs: DataFrame, tokenizer: Callable[[], object] = byte_bpe, max_tokens: int = MAX_TOKENS, max_loss: int | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts_col: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows of SCHEMA (and ``ids``, if asked for): the pieces of each document. parts_col: array of (text string, loss boolean), read instead of the text."""
    _at_least_one(max_tokens=max_tokens, max_loss=max_loss)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, number = tokenizer(), TaskContext.get().partitionId() << 33
        for pdf in batches:
            out: list[tuple] = []
            kept = []
            for doc_id, text, parts in zip(pdf["doc_id"], pdf["text"], pdf["parts"] if parts_col else [None] * len(pdf), strict=True):
                ids, loss = _ids_and_loss(tok, text, (parts if parts is not None else []) if parts_col else None, end_id)
                s = 0
                while s < len(ids):
                    e = min(s + max_tokens, len(ids))
                    if max_loss is not None:
                        e = min(e, int(np.searchsorted(loss, loss[s] + max_loss, "right")) - 1)
                    out.append((doc_id, s, e - s, int(loss[e] - loss[s]), zlib.crc32(ids[s:e]), len(ids), number))
                    if with_ids:
                        kept.append(ids[s:e].astype(np.int32))
                    s, number = e, number + 1
            pieces = pd.DataFrame(out, columns=["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens", "number"])
            yield pieces.assign(ids=kept) if with_ids else pieces

    text = F.lit(None).cast("string") if parts_col else F.col(text_col)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text.alias("text"), *([F.col(parts_col).alias("parts")] if parts_col else []))
    return rows.mapInPandas(cut, SCHEMA + (", ids array<int>" if with_ids else ""))


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and order in the bin for each row of demand (items, 3), by the dot-product heuristic. Each item fits alone."""
    kinds, kind = np.unique(demand, axis=0, return_inverse=True)
    kind = kind.ravel()
    queue = np.argsort(kind, kind="stable")
    nexts = np.searchsorted(kind[queue], np.arange(len(kinds)))
    stop = np.append(nexts[1:], len(queue))
    share = kinds / limits
    size = share.sum(axis=1)
    bins, order = np.empty(len(demand), dtype=np.int64), np.empty(len(demand), dtype=np.int64)
    alive = np.arange(len(kinds))
    b = 0
    while len(alive):
        left, among, n = limits.astype(np.float64).copy(), alive, 0
        while len(among):
            score = size[among] if n == 0 else share[among] @ (left / limits)
            k = among[score.argmax()]
            i = queue[nexts[k]]
            bins[i], order[i] = b, n
            nexts[k] += 1
            n += 1
            left -= kinds[k]
            among = among[(kinds[among] <= left).all(axis=1) & (nexts[among] < stop[among])]
        alive = alive[nexts[alive] < stop[alive]]
        b += 1
    return bins, order


def pack(pieces: DataFrame, n_groups: int, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """pieces (SCHEMA, ids) with sequence_id and offset. sequence_id: unique; offset: ids before the piece in its sequence."""
    _at_least_one(max_tokens=max_tokens, max_segments=max_segments, max_loss=max_loss)
    limits = np.array([max_tokens, max_segments, max_loss or max_tokens], dtype=np.int64)

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "loss", "doc_id", "start", "ids_crc32", "number"], ignore_index=True)
        bins = np.empty(len(pdf), dtype=np.int64)
        order = np.empty(len(pdf), dtype=np.int64)
        at = 0
        for s in range(0, len(pdf), 4 * group_items):  # a group is never packed in one go when a hash has failed to spread it
            part = pdf.iloc[s : s + 4 * group_items]
            demand = np.stack([part["length"], np.ones(len(part), dtype=np.int64), part["loss"]], axis=1)
            bins[s : s + len(part)], order[s : s + len(part)] = place(demand, limits)
            bins[s : s + len(part)] += at
            at = bins[s : s + len(part)].max() + 1
        pdf["sequence_id"] = bins * n_groups + pdf["g"].iloc[0]
        pdf = pdf.iloc[np.lexsort([order, bins])]
        before = pdf["length"].cumsum() - pdf["length"]
        pdf["offset"] = before - before.groupby(pdf["sequence_id"]).transform("min")
        return pdf[out_cols]

    ids = [c for c in pieces.columns if c == "ids"]
    cols = ["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens", "number", *ids]
    out_cols = [*cols, "sequence_id", "offset"]
    grouped = pieces.select(*cols, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "number"), F.lit(n_groups)).alias("g"))
    return grouped.groupBy("g").applyInPandas(pack_group, SCHEMA + (", ids array<int>" if ids else "") + ", sequence_id long, offset long").drop("number")


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, tokenizer: Callable[[], object] = byte_bpe, id_col: str = "doc_id", text_col: str = "text", parts_col: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack. Unless with_ids asks for them, token ids stay where they are read and the shuffle moves numbers only."""
    pieces = materialize(cut_pieces(docs, tokenizer, max_tokens, max_loss, id_col=id_col, text_col=text_col, parts_col=parts_col, with_ids=with_ids), "pieces")
    n_groups = max(1, -(-pieces.count() // GROUP_ITEMS))
    out = pack(pieces, n_groups, max_tokens, max_segments, max_loss)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc_id", id_col)


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
