"""Removal of lines that other documents hold too.

The keys of all lines, a digest each, are split by hash range into slices of at most about `slice_keys` keys, as many
as the lines need, so that the bits a key stay the same at any size. Each task turns its keys into fragments of two Bloom
filters a slice, seen once and seen twice; a slice's fragments merge (twice |= other.twice | once & other.once). The
digests meet the filter of their slice, and only those that may be in the second one, the suspected repeats, are
shuffled to confirm the repeat and find the smallest id. Digests are 128 bits of BLAKE2b: two lines are one if their
digests are. Documents are shuffled once, to meet the digests they lose. Slices and keys that hold very many
documents are split by salts, so no key's documents meet in one task.

Edge cases: null and empty texts are one empty line; a null id counts as the largest, and rows with it as one
document; rows with equal ids are one document (each row is cleaned, and a key that only they hold stays); equal keys
within a document are kept or dropped together; columns named n_lines or n_dropped are replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, cut, map_arrow, read

#: Shortest key; keys a slice is meant for, and bits of its filter (32 a key); documents of a slice or key a task
#: takes; filters a file holds.
MIN_CHARS, SLICE_KEYS, SLICE_BITS, SALT_ROWS, FILE_SLICES = 10, 1 << 13, 18, 1 << 16, 32
NO_ID = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()  # bytes.lower() changes A-Z only


def eligible(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def doc_keys(text: bytes | None, least: int) -> set[bytes]:
    return {k for k in map(line_key, (text or b"").split(b"\n")) if eligible(k, least)}


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Three places of each 64-bit hash in a filter of 2**bits bits."""
    step = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) | np.uint64(1)
    return ((hashes[None] + np.arange(3, dtype=np.uint64)[:, None] * step[None]) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _packed(at: np.ndarray) -> bytes:
    return zlib.compress(at.astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4")


def _digests(texts: pa.Array, least: int) -> tuple[list[int], list[bytes], np.ndarray]:
    """Row, digest and hash of each key of each text."""
    rows, found = [], []
    for i, text in enumerate(texts):
        own = [digest(k) for k in doc_keys(text.as_py(), least)]
        found += own
        rows += [i] * len(own)
    return rows, found, np.frombuffer(b"".join(found), "<i8")[::2]


def line_digests(df: DataFrame, text_col: str, least: int) -> DataFrame:
    """holder, sub, digest and its hash of each key of each row of df, which has holder and sub."""

    def run(batches):
        for batch in batches:
            rows, found, hashes = _digests(batch.column(2), least)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.binary()), pa.array(hashes)], names=["holder", "sub", "digest", "hash"])

    return map_arrow(df.select("holder", "sub", F.col(text_col).cast("binary")), run, "holder long, sub long, digest binary, hash long")


def _slice(hashed: Column, slices: int) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(hashed, 32) * F.lit(slices).cast("long"), 32)


def filters(keys: DataFrame, slices: int, bits: int, least: int | None = None) -> DataFrame:
    """(slice, n, data): how many keys a slice has, repeats included, and its filter of keys seen twice. The first column of
    keys is their hash or, with `least`, texts. A task holds its own hashes and then a slice at a time; merging holds the
    fragments of a slice: a key is in it once a task at most."""

    def fragments(batches):
        found = [(batch.column(0).to_numpy() if least is None else _digests(batch.column(0), least)[2]).copy().view(np.uint64) for batch in batches]
        if not found:
            return
        own, n = np.unique(np.concatenate(found), return_counts=True)
        of = (own >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(own) else np.zeros(0, int)
        for a in range(0, len(at), 1024):
            rows = []
            for i, j in zip(at[a : a + 1024], [*at[a + 1 : a + 1025], len(own)][: len(at[a : a + 1024])]):
                p = places(own[i:j], bits)
                rows.append((int(of[i]), int(n[i:j].sum()), _packed(np.unique(p)), _packed(np.unique(p[:, n[i:j] > 1]))))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["slice", "n", "once", "twice"])

    def fold(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for a, b in zip(table["once"], table["twice"]):
            own = _unpacked(a.as_py())
            twice[_unpacked(b.as_py())] = True
            twice[own[once[own]]] = True
            once[own] = True
        return pa.table({"slice": table["slice"].slice(0, 1), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "data": pa.array([_packed(np.flatnonzero(twice))], pa.binary())})

    parts = map_arrow(keys.select(keys.columns[0]), fragments, "slice long, n long, once binary, twice binary")
    return parts.groupBy("slice").applyInArrow(fold, "slice long, n long, data binary")


def suspected(keys: DataFrame, n: int, slice_keys: int = SLICE_KEYS, bits: int = SLICE_BITS, salt_rows: int = SALT_ROWS, texts: DataFrame | None = None, least: int = MIN_CHARS) -> DataFrame:
    """The rows (holder, sub, digest) of keys whose digest may be in two rows or more; few others. n: the keys, or a bound on
    their number; texts: what the keys are of, so that the filters need no second step in Python."""
    slices = max(1, -(-n // slice_keys))
    made = filters(keys.select("hash"), slices, bits) if texts is None else filters(texts, slices, bits, least)
    made = cut(made.coalesce(-(-slices // FILE_SLICES)), "filters")
    # slices above salt_rows keys, few by their number, are split, and each part has a copy of the filter
    large = made.where(F.col("n") > salt_rows).select("slice", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("holder", "sub"), F.col("salts")), F.lit(0)).cast("int")
    rows = keys.select("holder", "sub", "digest", _slice(F.col("hash"), slices).alias("slice")).join(large, "slice", "left").withColumn("salt", salt)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)).alias("salt")
    copies = made.join(large, "slice", "left").select("slice", "data", every)
    none = lambda kind: F.lit(None).cast(kind)
    met = rows.select("slice", "salt", "holder", "sub", "digest", none("binary").alias("data")).unionByName(copies.select("slice", "salt", none("long").alias("holder"), none("long").alias("sub"), none("binary").alias("digest"), "data"))
    met = met.repartition("slice", "salt").sortWithinPartitions("slice", "salt", F.col("data").isNull())

    def probe(batches):
        twice, of = np.zeros(1 << bits, bool), None
        for batch in batches:
            data, number = batch.column(3), batch.column(4).to_numpy()
            heads = np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False)).tolist()
            hit = np.zeros(batch.num_rows, bool)
            for a, b in zip([-1, *heads], [*heads, batch.num_rows]):
                if a >= 0:
                    of, at = number[a], _unpacked(data[a].as_py())
                    twice[:] = False
                    twice[at] = True
                if b > a + 1:
                    assert (number[a + 1 : b] == of).all()  # a slice's filter comes before its keys
                    hashes = np.frombuffer(b"".join(batch.column(2).slice(a + 1, b - a - 1).to_pylist()), "<u8")[::2]
                    hit[a + 1 : b] = twice[places(hashes, bits)].all(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(hit)) for i in range(3)], names=["holder", "sub", "digest"])

    return map_arrow(met.select("holder", "sub", "digest", "data", "slice"), probe, "holder long, sub long, digest binary")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, filter_bits: int = SLICE_BITS, slice_keys: int = SLICE_KEYS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """df with the kept lines in text_col, and n_lines and n_dropped of each text."""
    df = df.drop("n_lines", "n_dropped")
    # rows without an id are one holder, told apart by their text where they meet what they lose
    holder = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    sub = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0)).cast("long")
    keys = line_digests(df.select(holder.alias("holder"), sub.alias("sub"), text_col), text_col, min_chars)
    lines = df.agg(F.sum(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    suspects = cut(suspected(keys, lines, slice_keys, filter_bits, salt_rows, df.select(F.col(text_col).cast("binary")), min_chars), "suspects", lines)
    owners = cut(suspects.groupBy("digest").agg(F.min("holder").alias("first"), F.max("holder").alias("last"), F.count("*").alias("n")).where("first < last").select("digest", "first", "n"), "owners", suspects.count())
    hot = owners.where(F.col("n") > salt_rows).select("digest", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    dealt = suspects.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("holder", "sub"), salts).cast("int"))
    every = owners.join(hot, "digest", "left").select("digest", "first", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    lost = dealt.join(every, ["digest", "salt"]).where("holder <> first")
    drops = lost.groupBy(F.col("holder").alias("__holder"), F.col("sub").alias("__sub")).agg(F.collect_set("digest").alias("__drops"))
    columns, at = df.columns, df.columns.index(text_col)

    def rebuild(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(batch.column(at), batch.column(len(columns))):
                text, drop = text.as_py() or "", drop.as_py()
                if not drop:
                    texts.append(text), lines.append(text.count("\n") + 1), dropped.append(0)
                    continue
                own, drop = text.encode().split(b"\n"), set(drop)
                kept = [x for x in own if not (eligible(k := line_key(x), min_chars) and digest(k) in drop)]
                texts.append(b"\n".join(kept).decode()), lines.append(len(own)), dropped.append(len(own) - len(kept))
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    joined = df.withColumns({"__holder": holder, "__sub": sub}).join(drops, ["__holder", "__sub"], "left").select(*columns, "__drops")
    return map_arrow(joined, rebuild, "n_lines long, n_dropped long", columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM doc),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
own AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.pos, k.line, o.first IS NOT NULL AND o.first <> k.doc_id AS gone FROM keyed k LEFT JOIN own o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
