"""What the operators of this subpackage share.

Text operators see a text as bytes of its UTF-8 form.  Work on words is done
once per distinct word and Python worker (``WordTable``), so a text costs a
split and a table look-up per word, whatever the model behind the word is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows and bytes of text that a Python worker holds at a time.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ship the package and keep the Arrow batches that go to Python small: texts can be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def remainder(col: str, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % by, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which executors and driver share.

    Where a local session names none (a test) one below the warehouse is set, which
    it shares with itself.  On a cluster that would be a folder of each machine's
    own, so there the setting is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[[^\]]*\])?$", master):
            raise RuntimeError(f"spark.checkpoint.dir isn't set, and {master or 'this master'} is no local session")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: what is lost with an executor is read from the folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path  # type: ignore[attr-defined]
    return out


def discard(*settled: DataFrame) -> None:
    """Delete tables that ``settle`` wrote and nobody reads any more."""
    for df in settled:
        path = getattr(df, "_tessera_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def byte_texts(column) -> list[bytes]:
    """An Arrow string column as bytes; null reads as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def portions(texts: Sequence[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def offsets(lengths: Sequence[int]) -> np.ndarray:
    """0 and the running sums of ``lengths``."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(np.asarray(lengths, dtype=np.int64), out=out[1:])
    return out


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]`` along the first axis; empty ranges give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=np.float64)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=np.float64)
    return out


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTable:
    """Numbers of words, computed once per distinct word.

    ``compute`` maps a list of new words to an array with a row for each.  The
    table is emptied before a call that finds over ``cap`` words in it, which bounds
    memory and changes no result.
    """

    def __init__(self, compute: Callable[[list], np.ndarray], cap: int = 300_000):
        self.compute, self.cap = compute, cap
        self.ids = Numbers()
        self.rows: np.ndarray | None = None

    def lookup(self, words: Sequence) -> np.ndarray:
        """Row numbers in ``rows`` of ``words``, in order; valid until the next call."""
        if len(self.ids) > self.cap:
            self.ids = Numbers()
        used = len(self.ids)
        found = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        new, self.ids.new = self.ids.new, []
        if new:
            rows = self.compute(new)
            need = used + len(new)
            if self.rows is None or need > len(self.rows):
                grown = np.zeros((max(need, 4096, int(1.6 * used)), *rows.shape[1:]), dtype=rows.dtype)
                if self.rows is not None:
                    grown[:used] = self.rows[:used]
                self.rows = grown
            self.rows[used:need] = rows
        elif self.rows is None:
            self.rows = self.compute([])
        return found


def packed_words(words: list[bytes], lead: bytes, tail: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``lead + word + tail`` one after the other, and where each begins (and the end)."""
    flat = np.frombuffer(b"".join([lead + w + tail for w in words]), dtype=np.uint8)
    extra = len(lead) + len(tail)
    return flat, offsets([len(w) + extra for w in words])


def hash_sample(df: DataFrame, key: str, rate: float, salt: str) -> DataFrame:
    """Rows whose salted key hash falls in the lowest ``rate`` of the range."""
    if rate >= 1:
        return df
    cut = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1_000_000))
    return df.where(cut < int(rate * 1_000_000))
