"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: White space of all word definitions: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

def map_arrow(df: DataFrame, run, schema: str, columns: list[str] | None = None) -> DataFrame:
    """df.mapInArrow, with this package at hand. columns: those of df that come before the schema's."""
    ship(df.sparkSession)
    fields = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in columns or ()] + [schema])
    return df.mapInArrow(run, fields)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends, a lost executor costs nothing.
    rows: at most how many; a file holds 100,000 of them or so, not a few."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // 100_000)))
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column | str) -> Column:
    """The words of a text as an array, without regex captures; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), GAP), lambda w: w != "")


def let(value: Column, use):
    """use(value) with value computed once a row, however often use mentions it within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def split_words(text: str) -> list[str]:
    """Words by the six white space characters only; str.split() knows more of them."""
    if not OTHER_SPACE.search(text):
        return text.split()
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def array_parts(arrays: list[np.ndarray], part: int, slice_rows: int = 1 << 12):
    """Arrays of one length in slices, a row each, for sum_parts()."""
    for k, at in enumerate(range(0, len(arrays[0]), slice_rows)):
        own = np.concatenate([np.ascontiguousarray(a[at : at + slice_rows], np.float64).ravel() for a in arrays])
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k], pa.int64()), pa.array([zlib.compress(own.astype("<f8").tobytes(), 1)], pa.binary())], names=["part", "slice", "data"])


PARTS = "part long, slice long, data binary"


def sum_parts(rows: DataFrame, parts: int, fan: int = 32) -> DataFrame:
    """Sums by slice of what array_parts() gave in each of `parts` tasks. At most `fan` arrays meet in a task."""

    def fold(table: pa.Table) -> pa.Table:
        total = None
        for x in table["data"]:
            own = np.frombuffer(zlib.decompress(x.as_py()), "<f8")
            total = own.copy() if total is None else np.add(total, own, out=total)
        return pa.table({"part": table["part"].slice(0, 1), "slice": table["slice"].slice(0, 1), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    while True:
        parts = -(-parts // fan)
        rows = rows.withColumn("part", F.floor(F.col("part") / fan).cast("long")).groupBy("slice", "part").applyInArrow(fold, PARTS)
        if parts <= 1:
            return rows


def summed(rows: DataFrame, parts: int, widths: list[int], length: int, slice_rows: int = 1 << 12) -> list[np.ndarray]:
    """The summed arrays on the driver; widths and length fix their size, whatever the input's."""
    out = [np.zeros((length, w)) for w in widths]
    for row in sum_parts(rows, parts).toLocalIterator():
        at, n = row["slice"] * slice_rows, min(slice_rows, length - row["slice"] * slice_rows)
        data, done = np.frombuffer(zlib.decompress(row["data"]), "<f8"), 0
        for a, w in zip(out, widths):
            a[at : at + n] = data[done : done + n * w].reshape(n, w)
            done += n * w
    return out
