"""Document fingerprints by a threshold-scaled sketch.

The sketch of a text is every 64-bit hash of its word shingles below a fixed fraction of the hash range. Sketches of
very unequal documents stay comparable, and the sketch of a union is the union of sketches, so both the Jaccard
likeness and the containment can be estimated. A text none of whose hashes is below the threshold keeps its smallest
hash: its sketch would be empty otherwise, and all such texts alike. On sf0.01, at a fraction of 1/2, the mean error of
the likeness of a text to its edited text is 0.05 with the smallest hash and 0.13 without it among texts of under 20
shingles (0.22 and 1.0 at worst), and the same among all others.

Edge cases: null, empty and blank texts have the empty fingerprint, and two empty fingerprints are alike (1.0); texts
of fewer words than a shingle are one shingle; ids order ascending, null last, ties by text; repeated rows stay; a
table of one row is its own next document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read, words

SHINGLE, SCALE, PART_ROWS = 5, 8, 2000
#: The query keeps one hash in so many, and writes so many hexadecimal digits of each.
QUERY_SCALE, QUERY_DIGITS = 2, 8
#: Ranges of ids at most (beyond, a range grows and its sort spills), and ids sampled a range to place their bounds.
MAX_PARTS, PART_SAMPLE = 16_384, 128


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sorted distinct hashes of a text's shingles that are in the lowest 1/scale of the signed range."""
    threshold = -(1 << 63) + (1 << 64) // scale

    def of(w: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle))))
        hashes = F.when(F.size(w) >= shingle, rolled).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return let(hashes, lambda h: let(F.filter(h, lambda x: x < threshold), lambda low: F.when((F.size(low) > 0) | (F.size(h) == 0), F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(h)))))

    return let(words(text), of)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda x: x < -(1 << 63) + (1 << 64) // scale)
    return F.when((F.size(low) > 0) | (F.size(both) == 0), F.array_sort(low)).otherwise(F.array(F.array_min(both)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sketches, 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common.cast("double"), F.size(a) + F.size(b) - common), F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """The share of a that is in b, 0 to 1."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a)), F.lit(1.0))


def encoded(hashes: Column, digits: int = 16) -> Column:
    """The first digits of each hash, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(F.shiftrightunsigned(h, 64 - 4 * digits) if digits < 16 else h)), digits, "0")), "")


def with_next(df: DataFrame, id_col: str, text_col: str, extra: dict, part_rows: int = PART_ROWS) -> DataFrame:
    """id, text, `extra` and next: a struct of text and extra of the row after it by id; the first after the last.
    One shuffle: rows go to ranges of ids, and the first row of a range to the range before too. The bounds are ids of
    a sample by hash, MAX_PARTS at most whatever the table's size; any bounds give the same result."""
    n = df.count()
    parts = min(MAX_PARTS, max(1, n // part_rows))
    unit = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    picked = F.when(unit < PART_SAMPLE * parts / max(1, n), F.col(id_col))
    least, found = df.agg(F.min(id_col), F.percentile_approx(picked, [i / parts for i in range(parts)], 100_000)).first()
    firsts = sorted({least, *(found or [])} - {None})
    last, top = max(0, len(firsts) - 1), 1 << max(0, len(firsts) - 1).bit_length()
    bounds = F.array(*map(F.lit, firsts)) if firsts else F.lit(None).cast("array<bigint>")
    powers = [F.lit(top >> i) for i in range(top.bit_length())]
    # the last bound that is no larger than the id, by bisection
    place = F.aggregate(F.array(*powers), F.lit(0), lambda lo, s: F.when((lo + s <= last) & (F.get(bounds, lo + s) <= F.col("id")), lo + s).otherwise(lo))
    part = F.when(F.col("id").isNull(), last).otherwise(place)
    is_first = F.coalesce(F.col("id") == F.get(bounds, F.col("part")), F.lit(not firsts))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("part", part)
    own = F.struct(F.col("part").alias("p"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1).alias("p"), F.when(F.col("part") == 0, 2).otherwise(1).alias("ghost"))
    rows = rows.withColumn("to", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own)))).select("id", "text", "to.p", "to.ghost")
    rows = rows.repartition("p").withColumns(extra)
    order = Window.partitionBy("p").orderBy("ghost", F.col("id").asc_nulls_last(), "text")
    return rows.withColumn("next", F.lead(F.struct("text", *extra)).over(order)).where("ghost = 0").drop("p", "ghost")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", {"sketch": sketch(F.col("text"), scale=QUERY_SCALE)})
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 4)))"), F.expr("substring(next.text, 1, int(floor(char_length(text) / 4)))"))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), scale=QUERY_SCALE).alias("edited_sketch"), F.col("next.sketch").alias("next_sketch"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", encoded(F.col("sketch"), QUERY_DIGITS).alias("fingerprint"), encoded(F.col("edited_sketch"), QUERY_DIGITS).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
