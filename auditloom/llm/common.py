"""Shared pieces of the training-data operators: scratch tables and vectorised text hashing.

Texts are handled as UTF-8 byte buffers straight from Arrow, a bounded number of
bytes at a time (a single text longer than the bound is handled alone).
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 20

#: The white space of every contract here: space and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WORD = "[^\\x20\\x09-\\x0D]+"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[int, np.ndarray] = {}
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset, in local mode alone (tests), a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = got.get() if got.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='auditloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, paths: list[str]) -> None:
    try:
        sc = spark.sparkContext
        for p in paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may have ended already; the folder is scratch
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for a table, which is removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/auditloom/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_remove, spark, _made[app])
    _made[app].append(path)
    return path


def materialise(df: DataFrame, label: str, keep: bool = True) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, survives lost executors.

    The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Removes a table of materialise() that nothing reads any more."""
    paths = {f.rpartition("/")[0] for f in df.inputFiles()}
    _remove(df.sparkSession, [p for p in paths if "/auditloom/" in p])


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: idle workers stay, and with them what they once held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not every C library has it


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(df: DataFrame, names: tuple[str, str] | None = None) -> tuple[DataFrame, str, str]:
    """df with two last columns that tell each row from all others in every scan, and their names: its file and its place there.

    A table that isn't read from files is written to the shared folder first. names: df has these columns already.
    """
    if names:
        return df, *names
    file, at = unused(df, "in_file"), unused(df, "at_row")

    def columns(x: DataFrame) -> DataFrame:
        scan = x.metadataColumn("_metadata")  # also where the table has a column of that name
        return x.select("*", F.xxhash64(scan.getField("file_path")).alias(file), scan.getField("row_index").alias(at))

    try:
        return columns(df), file, at
    except AnalysisException:
        return columns(materialise(df, "rows")), file, at


def text_of(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash_share(column: Column, parts: int) -> Column:
    """crc32 of the value as text, modulo parts; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def buffers(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about step bytes."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    kept = texts.buffers()
    offsets = np.frombuffer(kept[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(kept[2], dtype=np.uint8) if kept[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n + 1 of each."""
    if len(_powers.get(0, ())) <= n:
        size = max(n + 1, STEP_BYTES * 2)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _K1
    x ^= x >> np.uint64(33)
    x *= _K2
    x ^= x >> np.uint64(33)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hashes() takes the hash of any span."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of the spans [start, end); equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _K2)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words don't cross rows."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def ngram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every n-gram of words within a row."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    out = words[:count].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : k + count])
    at = np.flatnonzero(rows[:count] == rows[n - 1 :])
    return at, out[at]


def to_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Groups into which the rows of one file are dealt, and those of a table without files.
SPLITS, SPLITS_WITHOUT_FILE = 16, 64


def routed(documents: DataFrame, first: int | None = None) -> DataFrame:
    """g, doc_id, text: g is the same for a row in every scan, and a task of a scan meets few of them.

    So a task can ask other tasks about what its rows hold, and the answers find the rows again.
    first: give only so many groups of each file.
    """
    file, h = F.input_file_name(), F.xxhash64(F.col("doc_id").cast("long"))
    split = F.when(file == "", F.pmod(h, F.lit(SPLITS_WITHOUT_FILE))).otherwise(F.pmod(h, F.lit(SPLITS)))
    out = documents.select(F.xxhash64(file, split).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), split.alias("split"))
    return (out if first is None else out.where(F.col("split") < first)).drop("split")


#: A run of rows of one group on its way: compressed column by column.
PACKED = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, doc_id, text) to (g, kind 1, payload): the rows of a batch that share g in one, compressed."""
    for batch in batches:
        g = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
        order = np.argsort(g, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], g[order][1:] != g[order][:-1]))) if len(g) else np.zeros(0, np.int64)
        payloads = []
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(g)], strict=True):
            own = pa.array(order[lo:hi])
            rows = pa.record_batch([batch.column(1).take(own), batch.column(2).cast(pa.large_string()).take(own)], schema=PACKED)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            payloads.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(g[order[edges]], pa.int64()), pa.array(np.ones(len(edges), np.int32)), pa.array(payloads, pa.binary())], names=["g", "kind", "payload"])


def with_answers(rows: DataFrame, answers: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (g, doc_id, text), packed, and answers (g, payload) dealt by g among parts tasks: (g, kind, payload), within a group the answers first."""
    both = rows.mapInArrow(pack, "g long, kind int, payload binary").unionByName(answers.select("g", F.lit(0).alias("kind"), "payload"))
    return both.repartition(parts or partitions(rows.sparkSession), "g").sortWithinPartitions("g", "kind")


def by_group(batches: Iterator[pa.RecordBatch], prepare: Callable[[list[bytes]], object], step: Callable[[object, int, pa.Array, pa.Array], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Runs over with_answers() rows: step(prepare(the group's answers), g, doc ids, texts) for each run of a group's rows."""
    group, payloads, ready = None, [], None
    for batch in batches:
        for g, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if g != group:
                group, payloads, ready = g, [], None
            if kind == 0:
                payloads.append(payload.as_py())
                continue
            if ready is None:
                ready = (prepare(payloads),)
                payloads = []
            with pa.ipc.open_stream(payload.as_buffer()) as held:
                for rows in held:
                    yield from step(ready[0], g, rows.column(0), rows.column(1))


def ids_of(column: pa.Array) -> np.ndarray:
    """doc ids as int64; null is the largest, after all others."""
    return np.asarray(column.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False), dtype=np.int64)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the least node reachable. Large-star and small-star by turns.

    A large star hands each node but to its least neighbour, so no node's neighbours are paired with each other.
    """
    spark = links.sparkSession
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialise(small, "edges")
        # the edges stand still when no other star operation changes them: compared by count and sum of hashes
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        old, edges = edges, new
        discard(old)
        if now == seen:
            break
        seen = now
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct()
    release(spark)
    return found.unionByName(roots.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
