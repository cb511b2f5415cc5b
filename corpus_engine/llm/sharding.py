"""Sharding by histogram sort: refine key boundaries on exact byte counts, then exchange once.

The key of a row is (crc32 of the text, hash of the id), packed into one long: a pseudo-random order, good for
training, in which equal texts are neighbours; only a splitter inside a large group of copies parts them.
Candidate boundaries (probes) split the key range; one aggregation gives the exact bytes below each, and only cells
that hold a wanted splitter are refined, until it is within the tolerance or the cell is a single key.
What the driver holds grows with the number of splitters only: some counts a splitter and round, and at most PROBES
counts where there are fewer. Shards of more than PIECE_ROWS rows are sorted in pieces, a splitter for so many rows, so
that no task sorts a whole shard; the pieces' offsets (12 bytes for PIECE_ROWS rows) are broadcast.

Null text: size 16 and the crc of the empty text. Null id: hashed like any other value. Empty table: no rows.
Repeated rows: same key, kept all, in one shard unless the shard ends among them.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD = 16
#: Rows of one unit of the final sort; a shard of more rows is cut into several.
PIECE_ROWS = 250_000
#: Probes that one aggregation may return to the driver.
PROBES = 1 << 15


def histogram_splitters(df: DataFrame, n: int, tolerance: float, key: str = "k", weight: str = "w") -> tuple[list[int], int]:
    """n - 1 ascending keys cutting df into parts of near equal weight, and the number of rounds it took.

    A part's bounds are within tolerance x (total / n) of the ideal unless one key alone outweighs that.
    """
    from corpus_engine.llm.common import one_of

    low, high, total = df.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if low is None or n <= 1:
        return [], 0
    wanted = [total * (i + 1) / n for i in range(n - 1)]
    allowed = tolerance * total / n
    shift = max(0, (int(high) - int(low)).bit_length())
    offset = F.col(key) - F.lit(int(low))
    cells = {0: (0, total)}  # prefix of an open cell: weight below it, weight in it
    inside = dict.fromkeys(range(n - 1), 0)  # open splitter: its cell's prefix
    found: dict[int, int] = {}
    rounds = 0
    while inside:
        rounds += 1
        bits = min(shift, max(1, (PROBES // len(cells)).bit_length() - 1))
        step = shift - bits
        rows = df if rounds == 1 else df.where(one_of(F.shiftright(offset, shift), sorted(cells)))
        counts: dict[int, list[tuple[int, int]]] = {}
        for p, w in sorted((int(p), int(w)) for p, w in rows.groupBy(F.shiftright(offset, step)).agg(F.sum(weight)).collect()):
            counts.setdefault(p >> bits, []).append((p, w))
        fresh: dict[int, tuple[int, int]] = {}
        by_cell: dict[int, list[int]] = {}
        for i, cell in inside.items():
            by_cell.setdefault(cell, []).append(i)
        inside = {}
        for cell, members in by_cell.items():
            below, probes, at = cells[cell][0], counts[cell], 0
            for i in sorted(members):
                while at < len(probes) - 1 and below + probes[at][1] < wanted[i]:
                    below += probes[at][1]
                    at += 1
                p, w = probes[at]
                under, over = wanted[i] - below, below + w - wanted[i]
                if step == 0 or min(abs(under), abs(over)) <= allowed:
                    found[i] = (p if under <= over else p + 1) << step
                else:
                    inside[i], fresh[p] = p, (below, w)
        cells, shift = fresh, step
    return [int(low) + found[i] for i in range(n - 1)], rounds


def shard_key(text: Column, doc_id: Column) -> Column:
    return F.shiftleft(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), 31).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit(0x7FFFFFFF)))


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with (size, text_crc32, shard, slot); columns of those names in docs are replaced.

    Law: sizes near equal. Slots run from 0 without gaps in each shard, in key order (ties: id, then crc).
    """
    from corpus_engine.llm.common import P, cell_of, written

    text, key, piece = F.coalesce(F.col(text_col), F.lit("")), f"{P}k", f"{P}piece"
    size = (F.octet_length(text) + F.lit(OVERHEAD)).cast("long")
    keyed = docs.withColumns({key: shard_key(F.col(text_col), F.col(id_col)), "size": size, "text_crc32": F.crc32(text.cast("binary"))})
    small = written(keyed.select(F.col(key).alias("k"), F.col("size").alias("w")), "shard_keys")
    rows = small.count()
    per_shard = max(1, -(-rows // (shards * PIECE_ROWS)))
    cuts, _ = histogram_splitters(small, shards * per_shard, tolerance)
    placed = keyed.withColumn(piece, cell_of(F.col(key), cuts))
    order = Window.partitionBy(piece).orderBy(key, id_col, "text_crc32")
    slot = F.row_number().over(order).cast("long") - 1
    if per_shard == 1:
        out = placed.withColumns({"shard": F.col(piece), "slot": slot})
    else:
        held = {int(p): int(n) for p, n in small.groupBy(cell_of(F.col("k"), cuts)).count().collect()}
        start, before = [], 0
        for p in range(shards * per_shard):
            before = 0 if p % per_shard == 0 else before
            start.append((p, before))
            before += held.get(p, 0)
        offsets = F.broadcast(docs.sparkSession.createDataFrame(start, f"{piece} int, {P}start long"))  # a row a piece
        out = placed.withColumn("slot", slot).join(offsets, piece).withColumns({"shard": F.expr(f"{piece} div {per_shard}").cast("int"), "slot": F.col("slot") + F.col(f"{P}start")}).drop(f"{P}start")
    return out.drop(key, piece)
