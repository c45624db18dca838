"""What the operators share: staged tables, chunks of documents, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one chunk: what a task holds at a time besides its tables.
CHUNK_BYTES = 8 << 20

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough for long texts (a batch of 10,000 whole texts can be very large)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the files of shuffles that nothing refers to any more, by a collection on the driver."""
    spark.sparkContext._jvm.java.lang.System.gc()


def release_executors(spark: SparkSession) -> None:
    """Collects on the executors, which give back to the system what heap they don't need: of itself a JVM keeps what it had at most."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


#: Folders of staged tables that are not dropped yet, in order.
STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    Nothing needs the shuffles behind it any more (release). The folder goes when the application's
    file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STAGED.append(path)
    release(spark)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in tables:
        drop_folders(df.sparkSession, {x.rsplit("/", 1)[0] for x in df.inputFiles()})


def drop_folders(spark: SparkSession, folders) -> None:
    """Deletes folders of staged tables."""
    jvm = spark.sparkContext._jvm
    for f in folders:
        where = jvm.org.apache.hadoop.fs.Path(f)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if (name := f.rsplit("/", 1)[-1]) in (known := {x.rsplit("/", 1)[-1]: x for x in STAGED}):
            STAGED.remove(known[name])


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lean() -> None:
    """Returns freed memory to the system between chunks: glibc keeps it otherwise, and the workers of an executor add up.

    Python looks for cycles less often from then on: operators make none, and each look goes over all that they hold.
    """
    gc.set_threshold(200_000, 50, 1000)
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Batch by batch, without state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            if b.num_rows:
                yield fn(b)
        lean()

    return df.mapInArrow(run, schema)


def stage_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents as rows (chunk, blob): a blob is a compressed Arrow table (key, text) of about chunk_bytes of text.

    No shuffle: a chunk holds neighbours of one input partition. The table is staged, so
    that a chunk keeps its documents in every later pass. A longer document is alone in its chunk.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        n, held, size = TaskContext.get().partitionId() << 24, [], 0

        def blob() -> pa.RecordBatch:
            table, sink = pa.Table.from_batches(held), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "blob"])

        for b in batches:
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0))
            start = 0
            for i, x in enumerate(lengths.tolist()):
                if size and size + x > chunk_bytes:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    yield blob()
                    n, held, size, start = n + 1, [], 0, i
                size += x
            held.append(b.slice(start))
        if any(h.num_rows for h in held):
            yield blob()
        lean()

    return stage(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "chunk long, blob binary"), "chunks")


def open_chunk(blob: bytes) -> tuple[list[int | None], list[bytes]]:
    """The keys and the texts (null: empty) of a chunk."""
    with pa.ipc.open_stream(blob) as r:
        t = r.read_all().combine_chunks()
    keys, texts = t.column(0).to_pylist(), t.column(1).cast(pa.binary()).to_pylist()
    return keys, [x or b"" for x in texts]


class Memory:
    """A dictionary of bounded size in two generations: what is used stays, what is not goes when the young one is full.

    Keys longer than LONG are not remembered, so the size bounds bytes too.
    """

    LONG = 64

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def find(self, keys: list) -> list:
        """The known values (None: unknown) of keys."""
        out = list(map(self.young.get, keys))
        if None in out:
            old = self.old
            for i, x in enumerate(out):
                if x is None and (y := old.get(keys[i])) is not None:
                    out[i] = self.young[keys[i]] = y
        return out

    def get(self, key):
        if (x := self.young.get(key)) is None and (x := self.old.get(key)) is not None:
            self.young[key] = x
        return x

    def put(self, key, value) -> None:
        if len(key) > self.LONG:
            return
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Pieces:
    """Texts cut where a pattern's matches end for sure, and a memory of what each piece gives.

    Texts are cut at single spaces between two characters that are not white space. Pieces at whose edge
    more white space stands are taken together with their neighbours there, so only they are done at length.
    """

    EDGE = (-1,)

    def __init__(self, of: Callable[[str], tuple], size: int) -> None:
        """of: the value, a tuple other than EDGE, of a piece."""
        self.of = of
        self.seen, self.runs = Memory(size), Memory(size // 8)

    def cut(self, text: str) -> list[tuple]:
        """The values of a text's pieces, in order."""
        pieces = text.split(" ")
        pieces[1:] = [" " + p for p in pieces[1:]]
        parts = self.seen.find(pieces)
        if None in parts:
            fresh: dict[str, tuple] = {}
            for i, x in enumerate(parts):
                if x is None:
                    p = pieces[i]
                    if (x := fresh.get(p)) is None:
                        x = fresh[p] = self.EDGE if self._white(p) or p[-1].isspace() else self.of(p)
                        self.seen.put(p, x)
                    parts[i] = x
        return self._together(pieces, parts) if self.EDGE in parts else parts

    @staticmethod
    def _white(piece: str) -> bool:
        """Whether white space or nothing follows a piece's own space."""
        own = piece[:1] == " "
        return len(piece) == own or piece[own].isspace()

    def _together(self, pieces: list[str], parts: list[tuple]) -> list[tuple]:
        white = list(map(self._white, pieces))
        ends = [w and len(p) < 2 or p[-1:].isspace() for w, p in zip(white, pieces, strict=True)]
        out, i = [], 0
        while i < len(pieces):
            j = i + 1
            while j < len(pieces) and (ends[j - 1] or white[j]):
                j += 1
            if j == i + 1 and parts[i] != self.EDGE:
                out.append(parts[i])
            elif run := "".join(pieces[i:j]):
                if (x := self.runs.get(run)) is None:
                    x = self.of(run)
                    self.runs.put(run, x)
                out.append(x)
            i = j
        return out


class UnionFind:
    """Least member as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of links i-j those that join two groups of label; label is brought up to date."""
    out: list[tuple[int, int]] = []
    while True:
        p, q = label[i], label[j]
        k = np.flatnonzero(p != q)
        if not len(k):
            return out
        # For each group the link to its least other group: forests of such links have no cycle but of two.
        lo, hi = np.minimum(p[k], q[k]), np.maximum(p[k], q[k])
        order = np.lexsort((lo, hi))
        first = order[np.unique(hi[order], return_index=True)[1]]
        up = np.arange(len(label))
        up[hi[first]] = lo[first]
        out += list(zip(i[k[first]].tolist(), j[k[first]].tolist(), strict=True))
        while (up[up] != up).any():
            up = up[up]
        label[:] = up[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one block of edges as links to the least member; blocks bound the memory."""
    block, seen = UnionFind(), 0

    def out() -> pa.RecordBatch:
        pairs = [(x, block.find(x)) for x in list(block.up)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            block.join(x, y)
        seen += b.num_rows
        if len(block.up) > 500_000:
            yield out()
            block, seen = UnionFind(), 0
    if seen:
        yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links between long ids: rows (node, root), root the least id reachable.

    Only nodes that have a link to another node occur, each but its root once. Blocks of
    links are contracted first; then large-star and small-star steps alternate, each a
    join of links with a pre-aggregated least neighbour, until nothing changes. Nothing is
    collected but two sums for each round, and each round is staged.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = stage(e.mapInArrow(_contract, "u long, v long").distinct(), "links")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        paired = large.join(least, "u")
        small = paired.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(paired.where("v = m").select("u", "v"))
        nxt = stage(small.where("u <> v").distinct(), "links")
        drop_staged(e)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
