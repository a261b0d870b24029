"""Sharding by histogram sort: near-equal bytes, sorted, with a single exchange.

Rows are ordered by (hash of the text, id, number), so equal texts are neighbours. Splitters
cut this order at equal shares of all bytes. They are found without moving a row: each round
counts the exact bytes in cells between candidate boundaries, over all partitions at once,
and keeps for each splitter the one cell that its share falls into; the next round divides
that cell. When a cell has come down to one hash, a splitter whose share is within
`tolerance` of a shard from either end of that text's copies goes there, so that a text's
copies stay together; otherwise the search goes on inside the copies, by id and then by
number, and ends at the nearest row. A text with a third of all rows is thus cut like any
other stretch of the order. The driver sees a bounded number of counts a round (`CELLS` for
the first, `FAN` for each open splitter later).

The same search cuts each shard into `parts` stretches of equal bytes, whatever the keys.
Rows then are exchanged once, by stretch, and sorted there; their slots are their numbers in
the stretch plus the sizes of the stretches before it. No task holds a whole shard.

Only built-in functions run. A row's size is the bytes of its text plus `OVERHEAD`; null
texts count as empty, but differ from empty ones in the order. Null ids come first. Equal
rows are rows of their own. A table without rows gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatwise.llm.work import stored

OVERHEAD = 8
#: Bits of the hash in the first round; cells of an open splitter in later ones.
CELL_BITS, FAN = 12, 256
#: Hashes have 60 bits.
KEY_BITS = 60
LEVELS = ("_key", "_id", "_number")
SHIFT = KEY_BITS - CELL_BITS


@dataclass
class Search:
    """One splitter: rows below it have `target` bytes, as nearly as rows allow."""

    target: float
    loose: float  # bytes within which a boundary between different texts will do
    level: int = 0
    prefix: tuple[int, ...] = ()
    low: int = 0
    high: int = (1 << KEY_BITS) - 1
    below: int = 0  # bytes of rows before `low`
    found: tuple[int, ...] | None = None  # rows from this key on lie above the splitter


def key_of(text: Column) -> Column:
    """60 bits of the MD5 of a text; nulls sort first."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1))


def _advance(s: Search, cells: list[tuple[int, int, int]]) -> None:
    """`cells`: (least value, greatest value, bytes) of the rows in the open cell, ascending."""
    at = s.below
    for i, (low, high, size) in enumerate(cells):
        if at + size > s.target or i == len(cells) - 1:
            break
        at += size
    s.below, s.low, s.high = at, low, high
    if low < high:
        return
    end, last = at + size, s.level == len(LEVELS) - 1
    first, second = s.target - at, end - s.target
    limit = s.loose if s.level == 0 else 0
    after = (*s.prefix, low + 1)
    if last or min(first, second) <= limit:
        s.found = (*s.prefix, low) if first <= second else after
    else:
        s.level, s.prefix = s.level + 1, (*s.prefix, low)
        s.low, s.high = -(1 << 63), (1 << 63) - 1


def splitters(rows: DataFrame, targets: list[tuple[float, float]]) -> list[tuple[int, ...]]:
    """Boundary keys (prefixes of LEVELS) for (target bytes, loose bytes), ascending.

    `rows` has the columns of LEVELS and `size`, and is read once a round.
    """
    searches = [Search(t, loose) for t, loose in targets]
    if not searches:
        return []
    first = rows.groupBy(F.shiftright("_key", SHIFT).alias("cell")) \
        .agg(F.min("_key"), F.max("_key"), F.sum("size")).orderBy("cell").collect()
    cells = [tuple(r)[1:] for r in first]
    for s in searches:
        _advance(s, cells)
    while open_ := [s for s in searches if s.found is None]:
        # Splitters in one cell share its counts.
        same: dict[tuple, list[Search]] = {}
        for s in open_:
            same.setdefault((s.level, s.prefix, s.low, s.high), []).append(s)
        spark = rows.sparkSession
        asked = [(i, level, (prefix[0] if prefix else low) >> SHIFT, *(*prefix, None, None)[:2], low, high)
                 for i, (level, prefix, low, high) in enumerate(same)]
        cells_df = spark.createDataFrame(
            asked, "i int, level int, cell long, p0 long, p1 long, low long, high long")
        value = F.when(F.col("level") == 0, F.col("_key")).when(F.col("level") == 1, F.col("_id")) \
            .otherwise(F.col("_number"))
        # A cell of the first round holds few open splitters: this join has no large group.
        near = rows.join(F.broadcast(cells_df), F.shiftright("_key", SHIFT) == F.col("cell")) \
            .where(F.col("p0").isNull() | (F.col("p0") == F.col("_key"))) \
            .where(F.col("p1").isNull() | (F.col("p1") == F.col("_id"))) \
            .withColumn("v", value).where("v BETWEEN low AND high")
        wide = "decimal(38,0)"
        place = F.floor((F.col("v").cast(wide) - F.col("low").cast(wide)) * FAN
                        / (F.col("high").cast(wide) - F.col("low").cast(wide) + 1))
        counted = near.groupBy("i", place.cast("long").alias("place")) \
            .agg(F.min("v"), F.max("v"), F.sum("size")).orderBy("i", "place").collect()
        by_cell: dict[int, list[tuple[int, int, int]]] = {}
        for r in counted:
            by_cell.setdefault(r["i"], []).append(tuple(r)[2:])
        for i, group in enumerate(same.values()):
            for s in group:
                _advance(s, by_cell[i])
    return [s.found for s in searches]


def _above(bound: Column) -> Column:
    """Whether a row lies at or above a boundary (struct k0, k1, k2; null where it ends)."""
    key, id_, number = (F.col(c) for c in LEVELS)
    return (key > bound["k0"]) | ((key == bound["k0"]) & (
        bound["k1"].isNull() | (id_ > bound["k1"]) | ((id_ == bound["k1"]) & (
            bound["k2"].isNull() | (number >= bound["k2"])))))


def histogram_shards(docs: DataFrame, n_shards: int, text: str = "text", key: str = "doc_id",
                     tolerance: float = 0.02, parts: int = 16, carry: list[str] | None = None,
                     shard: str = "shard", slot: str = "slot", size: str = "size") -> DataFrame:
    """The columns `carry` of `docs` (all) with `size`, `shard` and `slot`, replacing such.

    Rows are sorted by (hash, id, number) in a shard, and slots follow that order.
    """
    spark = docs.sparkSession
    keep = [c for c in carry or docs.columns if c not in (size, shard, slot)]
    rows = stored(docs.select(
        F.struct(*(F.col(c) for c in keep)).alias("row"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        key_of(F.col(text)).alias("_key"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.monotonically_increasing_id().alias("_number")), "rows")
    slim = rows.select("size", *LEVELS)
    total = slim.agg(F.sum("size")).first()[0] or 0
    cut = n_shards * parts
    targets = [(total * k / cut, tolerance * total / n_shards if k % parts == 0 else 0)
               for k in range(1, cut)] if total else []
    found = splitters(slim, targets)
    # By first-round cell: how many stretches and shards begin before it, and the boundaries in it.
    of_cell: dict[int, list] = {}
    for k, b in enumerate(found, 1):
        of_cell.setdefault(b[0] >> SHIFT, []).append((*(*b, None, None)[:3], k % parts == 0))
    table, begun, shards_begun = [], 0, 0
    for cell in range(-1, 1 << CELL_BITS):
        inside = of_cell.get(cell, [])
        table.append((cell, begun, shards_begun, inside))
        begun, shards_begun = begun + len(inside), shards_begun + sum(x[3] for x in inside)
    lookup = spark.createDataFrame(
        table, "cell long, begun int, shards_begun int, "
        "inside array<struct<k0: long, k1: long, k2: long, whole: boolean>>")
    placed = rows.join(F.broadcast(lookup), F.shiftright("_key", SHIFT) == F.col("cell")) \
        .withColumn("passed", F.filter("inside", _above)) \
        .select("row", "size", *LEVELS,
                (F.col("begun") + F.size("passed")).alias("_part"),
                (F.col("shards_begun") + F.size(F.filter("passed", lambda b: b["whole"]))).alias("_shard"))
    sizes = placed.groupBy("_shard", "_part").agg(F.count("*").alias("n"))
    # As many rows as stretches.
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("_part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*LEVELS)) - 1
    return placed.withColumn("at", number).join(F.broadcast(bases), F.col("_part") == F.col("p")) \
        .select(*(F.col("row")[c].alias(c) for c in keep), F.col("size").alias(size),
                F.col("_shard").alias(shard), (F.col("base") + F.col("at")).alias(slot))
