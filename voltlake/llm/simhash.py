"""SimHash fingerprints and near-duplicate groups.

Distinct fingerprints are dealt to tiles and compared exactly within a tile: numpy exclusive-or and bit counts
over blocks sorted by population count, skipping blocks whose counts differ beyond the radius. Two
fingerprints within `radius` bits agree in `m` whole bands of any radius + m bands, so the tiles are keyed by the
values of m bands and no link is lost; m grows with the number of fingerprints, so that a tile's expected
size stays the same. A tile above `tile_rows` is dealt to sub-tiles by population count and a salt, which meet in
pairs. A tile emits a spanning forest of its links, not all pairs; star contraction joins the forests.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any other; texts under four words are
one shingle; a null id counts as the largest (component_id is null if a group has no other); repeated rows stay;
columns named fingerprint or component_id are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, read

SHINGLE, SEED, RADIUS, TILE_ROWS, BLOCK = 4, 42, 4, 8192, 256
#: 64-bit words of a wide fingerprint.
WIDE_WORDS = 8
#: Documents of one fingerprint that a task takes; more are split by salts.
SALT_ROWS = 1 << 16
NO_ID = (1 << 63) - 1


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    buffer, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([digest(buffer, seed)], np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in found]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-size])]
    return np.fromiter((digest(buffer[a:b], seed) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(found) - size + 1)


def simhash(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is in over half of the hashes."""
    hashes = shingle_hashes(text, size, seed)
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with the 64-bit fingerprint of text_col as a signed long, `__fp`."""
    keep = [c for c in keep or df.columns if c != "__fp"]

    def run(batches):
        for batch in batches:
            found = np.fromiter((simhash(x.as_py(), shingle) for x in batch.column(len(keep))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*keep, "__fp"])

    return map_arrow(df.select(*keep, F.col(text_col).alias("__text")), run, "__fp long", keep)


def link_forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct values, as (smallest of the tree, other)."""
    count = np.bitwise_count(values)
    order = np.argsort(count, kind="stable")
    x, count = values[order], count[order].astype(np.int64)
    low, high = np.searchsorted(count, count - radius, "left"), np.searchsorted(count, count + radius, "right")
    near = np.zeros(len(x), bool)
    for a in range(0, len(x), BLOCK):
        b = min(a + BLOCK, len(x))
        lo, hi = low[a], high[b - 1]
        hit = np.bitwise_count(x[a:b, None] ^ x[None, lo:hi]) <= radius
        near[a:b] |= hit.sum(axis=1) > 1
    x, count = x[near], count[near]
    low, high = np.searchsorted(count, count - radius, "left"), np.searchsorted(count, count + radius, "right")
    left, tops, others = np.ones(len(x), bool), [], []
    for i in range(len(x)):
        if not left[i]:
            continue
        left[i], tree = False, [i]
        for j in tree:
            window = slice(low[j], high[j])
            found = low[j] + np.flatnonzero(left[window] & (np.bitwise_count(x[window] ^ x[j]) <= radius))
            left[found] = False
            tree += found.tolist()
        own = x[tree].view(np.int64)
        top = own.min()
        others.append(own[own != top])
        tops.append(np.full(len(own) - 1, top))
    return (np.concatenate(tops), np.concatenate(others)) if tops else (np.zeros(0, np.int64),) * 2


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) among a table of distinct longs `fp` that join the same groups as all links do."""
    rows = distinct.count()
    m = 1
    while (64 // (radius + m)) * m < np.log2(max(rows, 1) / (tile_rows / 2)) and m < 4:
        m += 1
    bands = radius + m
    edges = [64 * i // bands for i in range(bands + 1)]
    fits = max(0, int(np.ceil(np.log2(max(rows, 1) / (tile_rows / 2)))))  # bits of a key that tiles of this size need
    keys = []
    for k, chosen in enumerate(combinations(range(bands), m)):
        need, parts = min(fits, (64 // bands) * m), []
        for i, band in enumerate(chosen):
            width = min(edges[band + 1] - edges[band], -(-need // m))
            parts.append(F.shiftleft(F.shiftrightunsigned(F.col("fp"), edges[band]).bitwiseAND((1 << width) - 1), i * 16))
        key = parts[0]
        for part in parts[1:]:
            key = key.bitwiseOR(part)
        keys.append(F.struct(F.lit(k).alias("band"), key.alias("key")))
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("t")).select("fp", "t.band", "t.key")
    large = cut(dealt.groupBy("band", "key").count().where(F.col("count") > tile_rows).select("band", "key", F.ceil(F.col("count") / (tile_rows // 2)).cast("int").alias("salts")), "large")
    dealt = dealt.join(large, ["band", "key"], "left").withColumns({"bits": F.bit_count("fp"), "salt": F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")})
    # a sub-tile is (bits, salt); sub-tiles whose bit counts are within the radius meet, the smaller named first
    me = F.struct(F.col("bits").alias("bits"), F.col("salt").alias("salt"))
    others = F.transform(F.sequence(F.greatest(F.col("bits") - radius, F.lit(0)), F.least(F.col("bits") + radius, F.lit(64))), lambda b: F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(b.alias("bits"), s.alias("salt"))))
    meets = F.when(F.col("salts").isNull(), F.array(F.struct(F.lit(None).cast("struct<bits:int,salt:int>").alias("p"), F.lit(None).cast("struct<bits:int,salt:int>").alias("q")))).otherwise(F.transform(F.flatten(others), lambda o: F.struct(F.least(me, o).alias("p"), F.greatest(me, o).alias("q"))))
    tiles = dealt.select("fp", "band", "key", F.explode(meets).alias("meet"))

    def compare(table: pa.Table) -> pa.Table:
        a, b = link_forest(table["fp"].to_numpy().view(np.uint64), radius)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return tiles.groupBy("band", "key", "meet").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) of each node with a link; root: the smallest node reachable. Large-star and small-star rounds."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before, n = None, 2 * edges.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, name, n)
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(tops, "u")
        edges = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = cut(edges, name, n)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile_rows: int = TILE_ROWS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """id_col, `__fp` and component_id of each row of df: the smallest id within reach."""
    docs = cut(fingerprints(df, text_col, shingle, [id_col]), "fingerprints")
    holder = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    distinct = cut(docs.groupBy(F.col("__fp").alias("fp")).agg(F.min(holder).alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius, tile_rows))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    n = distinct.count()
    groups = cut(rooted, "rooted", n)
    least = groups.groupBy("root").agg(F.min("first").alias("least"))
    named = cut(groups.join(least, "root").select(F.col("fp").alias("__fp"), "n", F.nullif("least", F.lit(NO_ID)).alias("component_id")), "components", n)
    # fingerprints of very many documents, few by their number, are split, and each part meets a copy of the name
    hot = named.where(F.col("n") > salt_rows).select("__fp", F.ceil(F.col("n") / salt_rows).cast("int").alias("__salts"))
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    dealt = docs.join(hot, "__fp", "left").withColumn("__salt", F.pmod(F.xxhash64(id_col), salts).cast("int"))
    every = named.join(hot, "__fp", "left").select("__fp", "component_id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"))
    return dealt.join(every, ["__fp", "__salt"]).select(id_col, "__fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of df whose id is the smallest of their group; one row of those with equal ids."""
    found = near_duplicates(df, id_col, text_col, radius, shingle)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    keep = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(key.alias("__key")).distinct()
    # one shuffle of the texts serves the join and the choice among rows with equal ids
    return df.withColumn("__key", key).join(keep.hint("merge"), "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


# --- near-duplicates by a likeness of shingle sets, for which 64 bits are too few


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, size))


def wide_simhash(hashes: np.ndarray, words: int = WIDE_WORDS) -> np.ndarray:
    """64 * words bits: those of `words` hashes derived from each hash, by majority over the set."""
    total, steps = np.zeros(64 * words, np.int64), np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 2048):
        x = hashes[at : at + 2048, None] + steps[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        total += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).view(np.uint64)


def wide_radius(similarity: float, bits: int, sigmas: float = 3.0) -> tuple[float, int]:
    """(share of bits in which two sets of that Jaccard likeness and equal size differ, a radius that few of them exceed)."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return share, int(np.ceil(bits * share + sigmas * np.sqrt(bits * share * (1 - share))))


def nearest_forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (places in x) of a forest of least distances among wide fingerprints (n, words) within the radius."""
    count = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    order = np.argsort(count, kind="stable")
    x, count = x[order], count[order]
    low, high = np.searchsorted(count, count - radius, "left"), np.searchsorted(count, count + radius, "right")
    near = np.zeros(len(x), bool)
    for a in range(0, len(x), BLOCK):
        b = min(a + BLOCK, len(x))
        off = sum(np.bitwise_count(x[a:b, None, k] ^ x[None, low[a] : high[b - 1], k]).astype(np.int16) for k in range(x.shape[1]))
        near[a:b] = (off <= radius).sum(axis=1) > 1
    x, order = x[near], order[near]
    left, best, parent, links = np.ones(len(x), bool), np.full(len(x), radius + 1), np.zeros(len(x), int), []
    for _ in range(len(x)):
        i = int(np.where(left, best, 1 << 30).argmin())
        if best[i] <= radius:
            links.append((parent[i], i))
        left[i] = False
        off = np.bitwise_count(x ^ x[i]).sum(axis=1, dtype=np.int64)
        closer = left & (off < best)
        best[closer], parent[closer] = off[closer], i
    pairs = np.array(links, int).reshape(-1, 2)
    return order[pairs[:, 0]], order[pairs[:, 1]]


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, missed: float = 0.005, tile_rows: int = 1024) -> DataFrame:
    """The rows of df whose id is the smallest of their group, one row of those with equal ids. Groups are what links of a
    Jaccard likeness of shingle sets of `similarity` or more join. Candidates are near in wide fingerprints: distinct sets are
    dealt to tiles by as many bands of sampled bits as leave a pair at that very likeness out with probability `missed`
    (closer pairs: far less), a tile is compared exactly and gives a forest of its least distances, and each link is
    confirmed on the sets. Texts of no words are alike; a null id counts as the largest."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))

    def sets(batches):
        for batch in batches:
            found = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            grams = [np.unique(h.astype(np.uint32)).tobytes() for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary()), pa.array([wide_simhash(h).tobytes() for h in found], pa.binary()), pa.array(grams, pa.binary())], names=["holder", "sig", "wide", "grams"])

    rows = map_arrow(df.select(key.alias("holder"), text_col), sets, "holder long, sig binary, wide binary, grams binary")
    rows = cut(rows.withColumn("node", F.monotonically_increasing_id()), "sets")
    distinct = cut(rows.groupBy("sig").agg(F.min("node").alias("node"), F.min("holder").alias("first"), F.first("wide").alias("wide")).drop("sig"), "distinct")
    n, bits = distinct.count(), 64 * WIDE_WORDS
    share, radius = wide_radius(similarity, bits)
    width = min(24, max(1, int(np.ceil(np.log2(max(2, n) / tile_rows)))))
    bands = int(np.ceil(np.log(missed) / np.log1p(-((1 - share) ** width))))
    places = [np.random.default_rng(k).choice(bits, width, replace=False) for k in range(bands)]

    def deal(batches):
        for batch in batches:
            flags = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
            for k, at in enumerate(places):
                keys = flags[:, at].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, k, np.int32)), pa.array(keys), *batch.columns], names=["band", "key", "node", "wide"])

    dealt = map_arrow(distinct.select("node", "wide"), deal, "band int, key long, node long, wide binary")
    large = dealt.groupBy("band", "key").count().where(F.col("count") > TILE_ROWS).select("band", "key", F.ceil(F.col("count") / (TILE_ROWS // 2)).cast("int").alias("salts"))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    dealt = dealt.join(large, ["band", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), salts - 1), lambda o: F.struct(F.least("salt", o).alias("p"), F.greatest("salt", o).alias("q")))
    tiles = dealt.select("band", "key", "node", "wide", F.explode(meets).alias("meet"))

    def compare(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        a, b = nearest_forest(np.frombuffer(b"".join(table["wide"].to_pylist()), np.uint64).reshape(len(node), -1), radius)
        return pa.table({"a": pa.array(np.minimum(node[a], node[b])), "b": pa.array(np.maximum(node[a], node[b]))})

    links = cut(tiles.groupBy("band", "key", "meet").applyInArrow(compare, "a long, b long").distinct(), "links")
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    known = cut(rows.select("node", "grams").join(ends, "node", "left_semi"), "known")

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], names=["a", "b"])

    pairs = links.join(known.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    roots = components(map_arrow(pairs.select("a", "b", "x", "y"), confirm, "a long, b long"))
    grouped = distinct.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("__key"))
    keep = cut(grouped.select("__key").distinct(), "keep")
    return df.withColumn("__key", key).join(keep.hint("merge"), "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")
