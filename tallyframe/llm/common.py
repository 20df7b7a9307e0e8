"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without one (tests) gets a temporary one; on a
    cluster that would lose rows, so it is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them again: lineage ends there and executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5: rows no model may learn from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def give_back(collect: bool = True) -> None:
    """Returns what this Python worker no longer uses to the machine. Workers outlive their tasks, and memory that they
    keep is missing to the stages that come after."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives memory back once it is through."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A group's function, of one table or two, that gives memory back after each group."""

    def one(rows: pa.Table) -> pa.Table:
        found = run(rows)
        give_back(collect=False)
        return found

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        found = run(left, right)
        give_back(collect=False)
        return found

    return one if len(inspect.signature(run).parameters) == 1 else two


class Flat:
    """The values of an Arrow binary or string column as one byte array with offsets, without copying."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
        wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        n = len(column)
        kind = np.int64 if wide else np.int32
        self.offsets = np.zeros(1, kind) if offsets is None else np.frombuffer(offsets, kind, n + 1 + column.offset)[column.offset :]
        self.data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
        self.n = n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]

    def runs(self, size: int) -> Iterator[tuple[int, int]]:
        """Index ranges whose bytes come to about `size`; a longer value is a range of its own."""
        lo = 0
        while lo < self.n:
            hi = int(np.searchsorted(self.offsets, self.offsets[lo] + size, "right")) - 1
            hi = min(max(hi, lo + 1), self.n)
            yield lo, hi
            lo = hi


def binary_column(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), pa.binary())


class PieceCache(dict):
    """What a task knows about strings it has met. Once `cap` strings are kept, later ones stay for one batch only, so
    memory is bounded whatever the texts hold; `fill` gets the unknown strings of a batch and returns their values."""

    def __init__(self, fill: Callable[[list[str]], Iterable], cap: int = 250_000):
        super().__init__()
        self.fill, self.cap, self.young = fill, cap, []

    def know(self, strings: Iterable[str]) -> None:
        if self.young:
            for s in self.young:
                del self[s]
            self.young = []
        new = [s for s in set(strings) if s not in self]
        if not new:
            return
        if len(self) + len(new) > self.cap:
            self.young = new[max(0, self.cap - len(self)) :]
        self.update(zip(new, self.fill(new), strict=True))


_RARE_SPACE = re.compile(r"[^\S \n]")


def rare_space(text: str) -> bool:
    """Whether a text has white space other than spaces and line ends."""
    if text.isascii():
        return any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
    return _RARE_SPACE.search(text) is not None


def odd_space(text: str) -> bool:
    """Whether a text has runs of white space that a tokenizer may treat as one, or strings like special tokens."""
    return (
        "  " in text
        or "<|" in text
        or any(run in text for run in ("\n\n\n", "\n\n ", " \n\n", "\n \n", " \n "))
        or text[-2:].isspace()
        or rare_space(text)
    )
