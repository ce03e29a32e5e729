"""Calls of a model from the cluster's tasks: batched, stored by key so that none is repeated, errors as rows; repair of what doesn't pass."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Makes, in a task, the function that answers a list of requests (dicts) with as many replies.
Client = Callable[[], Callable[[list[dict]], list[Any]]]
_ROW, _TYPES = "request_key string, reply string, error string, attempts int", (pa.string(), pa.string(), pa.string(), pa.int32())


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _answered(answer: Callable, requests: list[dict], tries: int) -> list[tuple[str | None, str | None, int]]:
    """(reply as JSON, error, attempts) of each request: the batch as a whole first, then, where that fails, each by itself."""
    def ask(some: list[dict]) -> list[Any]:
        got = answer(some)
        if len(got) != len(some):
            raise ValueError(f"{len(got)} replies to {len(some)} requests")
        return [json.dumps(x, ensure_ascii=False) for x in got]

    try:
        return [(x, None, 1) for x in ask(requests)]
    except Exception:
        out = []
        for r in requests:
            for n in range(2, max(tries, 2) + 1):
                try:
                    out.append((ask([r])[0], None, n))
                    break
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
            else:
                out.append((None, error, n))
        return out


def call_model(df: DataFrame, request: Column, client: Client, store: str, reply: str = "string", batch: int = 32, tries: int = 3, write: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """df with ``reply`` (of the given type), ``error`` and ``attempts``. ``request``: a struct, what is asked for a row; a null request has no reply.

    Equal requests are one call. A batch's replies are in the store, a folder that all tasks reach, before its task goes on: a task that is run again, and a later run
    with the same store, read them there instead of asking again. A batch is told by its requests' digests, and so that the same batches come up again requests are written (by
    ``write``) in a fixed order first. A request that fails ``tries`` times is a row with an error; it is asked again only with another store.
    """
    asked = df.withColumn("__request", F.when(request.isNotNull(), F.to_json(request, {"ignoreNullFields": "false"}))).withColumn("__key", F.sha2("__request", 256))
    todo = asked.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.first("__request").alias("__request"))
    todo = write(todo.repartition(F.col("__key")).sortWithinPartitions("__key"), "requests")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = None
        files, root = _store(store)
        files.create_dir(root, recursive=True)
        for part in parts:
            # requests become Python's a batch at a time; what Spark hands over at once stays in Arrow's memory
            order = pc.sort_indices(part.column("__key"))
            for at in range(0, len(order), batch):
                own = part.take(order.slice(at, batch))
                keys = own.column("__key").to_pylist()
                name = f"{root}/{hashlib.sha256(''.join(keys).encode()).hexdigest()}.json"
                if files.get_file_info(name).type == fs.FileType.File:
                    with files.open_input_stream(name) as f:
                        rows = json.loads(f.read())
                else:
                    answer = answer or client()
                    got = _answered(answer, [json.loads(r) for r in own.column("__request").to_pylist()], tries)
                    rows = [[k, *g] for k, g in zip(keys, got, strict=True)]
                    with files.open_output_stream(f"{name}.{id(own)}.new") as f:
                        f.write(json.dumps(rows, ensure_ascii=False).encode())
                    files.move(f"{name}.{id(own)}.new", name)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], ["request_key", "reply", "error", "attempts"])

    replies = write(todo.mapInArrow(run, _ROW), "replies").withColumnRenamed("request_key", "__key")
    read = F.get_json_object(F.concat(F.lit('{"r":'), "reply", F.lit("}")), "$.r") if reply == "string" else F.from_json(F.concat(F.lit('{"r":'), "reply", F.lit("}")), f"r {reply}")["r"]
    return asked.join(replies.withColumn("reply", read), "__key", "left").drop("__key", "__request")


def embed(df: DataFrame, text: Column, client: Client, store: str, batch: int = 64, **options) -> DataFrame:
    """df with ``reply``, the text's vector at length 1 (a vector of zeros stays), ``error`` and ``attempts``."""
    found = call_model(df, F.when(text.isNotNull(), F.struct(text.alias("text"))), client, store, "array<double>", batch, **options)
    length = F.sqrt(F.aggregate("reply", F.lit(0.0), lambda a, x: a + x * x))
    return found.withColumn("__length", length).withColumn("reply", F.when(F.col("__length") > 0, F.transform("reply", lambda x: x / F.col("__length"))).otherwise(F.col("reply"))).drop("__length")


def repaired(df: DataFrame, key: str, draft: str, faults: Callable[[Column], Column], repair: Callable[[DataFrame], DataFrame], fallback: Column, appendix: Column, attempts: int, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """df with ``content``, ``method`` and ``faults``: drafts that pass, at once or after at most so many repairs, with their appendix; else the fallback and what was wrong.

    ``faults`` gives an array of what is wrong with a draft; ``repair`` takes rows with ``faults`` and returns them with a new draft. Only rows that don't pass are repaired, and
    each round is written once.
    """
    now = write(df.withColumn("faults", faults(F.col(draft))), "drafts")
    for k in range(1, attempts + 1):
        bad = F.size("faults") > 0
        again = repair(now.where(bad)).withColumn("faults", faults(F.col(draft)))
        now = write(now.where(~bad).unionByName(again.select(now.columns)), f"drafts-{k}")
    failed = F.size("faults") > 0
    record = F.concat(fallback, F.lit("\n\n## "), F.lit(FAILED), F.lit("\n\n- "), F.array_join("faults", "\n- "))
    return now.withColumn("content", F.when(failed, record).otherwise(F.concat(F.col(draft), F.lit("\n\n---\n\n"), appendix))).withColumn("method", F.when(failed, "fallback").otherwise("model"))


#: Fixed value: the heading over what a model failed at.
FAILED = "LLM 생성 실패 기록"
