"""Best-fit packing of documents into token sequences.

Hierarchical residual packing: items are dealt to leaves of bounded size, each leaf packs best-fit
decreasing, bins that are full but for `slack` tokens are closed, and the open bins of `fan` leaves
meet as items of the next round until one node is left.

Edge cases: a null or empty text is one piece that holds only the end id; rows with equal or null
doc_id are packed one by one; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, read

CAPACITY, END_ID, SLACK, LEAF_ROWS, FAN = 1024, 2, 8, 65_536, 8
_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The byte-level BPE of a rank file; its ids are those of the same vocabulary in the JSON file beside it, whose added
    tokens are found in texts."""
    if path not in _encoders:
        import base64
        import json
        from pathlib import Path

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        beside = Path(path).with_suffix(".json")
        added = json.loads(beside.read_text(encoding="utf-8"))["added_tokens"] if beside.exists() else []
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are matched as they are only")
        special = {x["content"]: x["id"] for x in added}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    if n <= capacity:
        return [(0, n)]
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, and with_ids the ids themselves."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        own = encoder(vocabulary)
        added = own.special_tokens_set
        for batch in batches:
            rows, pieces, starts, lengths, crcs, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.array([*own.encode(text.as_py() or "", allowed_special=added, disallowed_special=()), end_id], "<u4")
                for k, (s, n) in enumerate(piece_bounds(len(tokens), capacity)):
                    part = tokens[s : s + n]
                    rows.append(i), pieces.append(k), starts.append(s), lengths.append(n), crcs.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=["d", "p", "s", "l", "c", "i"][: 5 + with_ids])

    schema = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(df.select(F.col(id_col), F.col(text_col)), run, schema, [id_col])


def best_fit(fills: np.ndarray, names: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Best-fit decreasing. For each item its bin's name (that of the bin's first item) and place; the bins' free space."""
    free: dict[int, list[int]] = defaultdict(list)
    mask, into, shift, left = 0, np.empty_like(names), np.zeros(len(names), np.int64), {}
    for i in np.lexsort((names, -fills)).tolist():
        size = int(fills[i])
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            name = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, name = capacity, int(names[i])
        into[i], shift[i], left[name] = name, capacity - room, room - size
        if room > size:
            free[room - size].append(name)
            mask |= 1 << (room - size)
    return into, shift, left


def _pack_node(table: pa.Table, capacity: int, slack: int, keep: int) -> pa.Table:
    """One round at one node. Two bins over half full never meet, and at most `keep` bins that are not can still
    reach this node's bins: of the bins over half full with one fill, more than that are closed at once."""
    names, first, inverse = np.unique(table["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
    into, shift, left = best_fit(table["fill"].to_numpy()[first], names, capacity)
    carried: dict[int, int] = defaultdict(int)
    is_closed = {}
    for name, room in sorted(left.items()):
        carried[room] += room > slack
        is_closed[name] = room <= slack or 2 * room < capacity and carried[room] > keep
    seq, put = into[inverse], {
        "sequence_id": into[inverse], "offset": table["offset"].to_numpy() + shift[inverse],
        "fill": capacity - np.array([left[x] for x in into.tolist()], np.int64)[inverse], "closed": np.array([is_closed[x] for x in into.tolist()], bool)[inverse],
    }
    assert len(seq) == table.num_rows
    return pa.table({c: pa.array(put[c]) if c in put else table[c] for c in table.column_names})


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with a `length` of 1 to capacity."""
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset", "fill", "closed", "node")]
    pieces = cut(pieces.select(*columns).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "fill": F.col("length").cast("long"), "closed": F.col("length") >= capacity}), "pieces")
    nodes = max(1, math.ceil(pieces.where(~F.col("closed")).count() / leaf_rows))
    done, still = [pieces.where("closed")], pieces.where("not closed").withColumn("node", F.pmod(F.xxhash64("sequence_id"), F.lit(nodes)))
    while True:
        levels = math.ceil(math.log(nodes, fan) - 1e-9) if nodes > 1 else 0
        keep = max(1, fan * levels)

        def work(table: pa.Table) -> pa.Table:
            return _pack_node(table, capacity, slack, keep)

        packed = still.groupBy("node").applyInArrow(work, still.schema)
        if nodes == 1:
            done.append(packed.drop("node"))
            break
        packed = cut(packed, "packed")
        done.append(packed.where("closed").drop("node"))
        nodes = math.ceil(nodes / fan)
        still = packed.where("not closed").withColumn("node", F.floor(F.col("node") / fan).cast("long"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces tokenized with_ids: sequence_id, ids. A group is one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenize(read(spark, sf_dir, "documents")))
