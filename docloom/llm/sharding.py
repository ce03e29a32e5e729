"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass 1 scatters whole rows uniformly into buckets of about ``BUCKET_MEMORY`` bytes by a seeded hash of the row and writes the buckets out. The same hash cuts a bucket
into parts of about ``bucket_rows`` rows and ``bucket_bytes`` bytes at most. Pass 2 runs a seeded Fisher-Yates shuffle over each part of a bucket in canonical
order; as rows fall to parts uniformly too, the bucket as a whole is in uniform order, and its work is in proportion to its rows (a Fisher-Yates in
expressions costs the square of what it runs over). A row's place in the whole order is its bucket's first place plus its place in the bucket; place p goes to shard ``p mod
shards``, slot ``p div shards``, so shard sizes differ by at most one row (law ``rows``). Whole rows are shuffled once. The buckets' first places come from counts made before; they
are a table that is merged with the rows by bucket, in the same partitioning, and is never broadcast by us. The number of partitions follows the bytes.

The result depends on the rows, the seed, the row count and the parameters, never on partitions or on the order of
input, so a recomputed task repeats it. Equal rows would meet in one bucket; they are numbered, ``COPIES`` at a
time, and the number takes part in the hash, so a row that makes up a third of the table is spread like any other. Rows are first counted by a
64-bit key: a row whose key occurs once has no equal and goes straight to its bucket, the others are counted by all their columns. The input is read
three or four times and has to be the same each time. Nulls are values like others; texts of any length move with their row. An empty table gives an
empty result. Columns named shard or slot, or with a name that begins with ``__``, are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, table

BUCKET_ROWS = 64
BUCKET_BYTES = 1 << 20
#: Bytes of a bucket, in memory, and of the buckets of one task.
BUCKET_MEMORY = 1 << 24
TASK_MEMORY = 1 << 28
#: Keys of repeated rows that are sent to all tasks; with more of them, all rows are counted by their columns.
LOOKUP = 100_000
#: Equal rows that one task numbers.
COPIES = 10_000
#: Buckets whose first places are summed up together; the sums over such runs form a short table.
RUN = 4096


def _fisher_yates(n, seed: int, bucket):
    """1..n permuted: for i = n..2 swap entry i with entry j, j uniform in 1..i by a seeded hash of (bucket, i)."""
    swap = lambda acc, i: F.transform(
        F.array(acc),
        lambda a: F.transform(a, lambda x, k: F.when(k + 1 == i, F.element_at(a, (1 + F.pmod(F.xxhash64(F.lit(seed), bucket, i), i)).cast("int"))).when(k == F.pmod(F.xxhash64(F.lit(seed), bucket, i), i), F.element_at(a, i)).otherwise(x)),
    )[0]
    steps = F.when(n > 1, F.sequence(n, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(1), n), swap)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes a value takes."""
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        value = F.to_json(value)
    elif not isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(8).cast("long")
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8


def _numbered(df: DataFrame) -> DataFrame:
    """df's rows with ``__copy``: equal rows are numbered from 1."""
    row = [F.col(f"`{c}`") for c in df.columns]
    copies = df.groupBy(*row).agg(F.count(F.lit(1)).alias("__n"))
    chunks = copies.select(*row, "__n", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPIES))).alias("__chunk")).repartition(F.xxhash64(*row, "__chunk"))
    low, high = F.col("__chunk") * COPIES + 1, F.least((F.col("__chunk") + 1) * COPIES, F.col("__n"))
    return chunks.select(*row, F.explode(F.sequence(low, high)).alias("__copy"))


def assign_shards(df: DataFrame, n_shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, lookup: int = LOOKUP) -> DataFrame:
    """df's rows with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    cols = df.columns
    if taken := [c for c in cols if c in ("shard", "slot") or c.startswith("__")]:
        raise ValueError(f"columns named like the result's: {taken}")
    row = [F.col(f"`{c}`") for c in cols]
    size = sum((_bytes(c, f.dataType) for c, f in zip(row, df.schema.fields, strict=True)), F.lit(0).cast("long"))
    keyed = df.withColumn("__key", F.xxhash64(*row))
    keys = materialize(keyed.select("__key", size.alias("__bytes")).groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.sum("__bytes").alias("__bytes")), "shuffle-keys")
    total = keys.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("__bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("__n") > 1).alias("repeated")).first()
    n_parts = max(1, -(-total.rows // bucket_rows), -(-total.bytes // bucket_bytes))
    per_bucket = max(1, n_parts * BUCKET_MEMORY // max(total.bytes, 1))
    n_tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total.bytes // TASK_MEMORY))

    once = F.lit(1).cast("long").alias("__copy")
    if not total.repeated:
        rows = df.select(*row, once)
    elif total.repeated <= lookup:
        repeated = F.broadcast(keys.where(F.col("__n") > 1).select("__key"))
        rows = keyed.join(repeated, "__key", "left_anti").select(*row, once).union(_numbered(keyed.join(repeated, "__key", "left_semi").select(*row)))
    else:
        rows = _numbered(df)
    h = F.xxhash64(F.lit(seed), *row, F.col("__copy"))
    part = F.pmod(h, F.lit(n_parts))
    bucket = F.floor(part / per_bucket).alias("__bucket")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(rows.select(bucket).groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size")).withColumn("__run", F.floor(F.col("__bucket") / RUN)), "shuffle-sizes")
    runs = sizes.groupBy("__run").agg(F.sum("__size").alias("__total"))
    runs = runs.select("__run", F.coalesce(F.sum("__total").over(before(Window.orderBy("__run"))), F.lit(0)).alias("__base"))
    firsts = sizes.select("__bucket", "__run", F.coalesce(F.sum("__size").over(before(Window.partitionBy("__run").orderBy("__bucket"))), F.lit(0)).alias("__within"))
    firsts = firsts.join(runs, "__run").select("__bucket", (F.col("__base") + F.col("__within")).alias("__base"))

    scattered = rows.select(bucket, part.alias("__part"), F.struct(h.alias("__h"), F.struct(*row).alias("__row")).alias("__item")).repartition(n_tasks, "__bucket")
    based = scattered.join(firsts.repartition(n_tasks, "__bucket").hint("merge"), "__bucket")
    parts = based.groupBy("__bucket", "__base", "__part").agg(F.count(F.lit(1)).alias("__size"), F.array_sort(F.collect_list("__item")).alias("__items"))
    within = F.coalesce(F.sum("__size").over(before(Window.partitionBy("__bucket").orderBy("__part"))), F.lit(0))
    gathered = materialize(parts.select("__part", (F.col("__base") + within).alias("__first"), "__items"), "shuffle-buckets")
    discard(keys, sizes)

    order = _fisher_yates(F.size("__items"), seed, F.col("__part"))
    placed = gathered.select("__first", F.posexplode(F.transform(order, lambda i: F.element_at("__items", i)["__row"])).alias("__pos", "__row"))
    place = F.col("__first") + F.col("__pos")
    return placed.select("__row", F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot")).select("__row.*", "shard", "slot")


def write_shards(df: DataFrame, path: str, n_shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> None:
    """Pass 2's files: Parquet under ``path/shard=k``, each shard in slot order; a shard may have several files."""
    out = assign_shards(df, n_shards, seed, bucket_rows)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are shuffled, all their columns in one, so that no name can clash; the digests are those of the rows that come out."""
    out = assign_shards(table(spark, sf_dir, "documents").select(F.struct("*").alias("document")), 40, seed=20)
    text = F.coalesce("document.text", F.lit(""))
    digests = [(F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    return out.select("document.doc_id", *digests, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
