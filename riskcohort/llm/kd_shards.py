"""Shards of near equal bytes by k-d tree partitioning, with DataFrame operations only.

Points are groups of equal texts, weighted by their bytes. All cells of a level of the tree are split at once: along the
dimension that is widest in the cell, at the weighted median (or the share of leaves on either side), until every leaf is
one shard. A median is found by histograms of ever smaller intervals that hold it; the last one, of few groups, is put in
order of size, so that small groups fill the gap. What reaches the driver is a few rows per cell.

A group stays in one shard unless it is heavy: then the cut goes through it, so that copies that hold a third of all
bytes spread over a third of the shards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskcohort.session import cut_lineage

OVERHEAD = 16
BINS = 256
# An interval with no more groups is put in order by one task.
INTERVAL = 1 << 16
# Groups of more than this part of a shard may be cut.
PART = 256
# Rows of a shard that one task numbers.
BLOCK = 1 << 16
DIMENSIONS = ("at_id", "at_size", "at_source", "at_lang")
# What an interval is cut by once its values of the dimension are one.
TIES = ("tie_size", "tie_key")


def _code(name: str, columns: list[str]) -> Column:
    """A number that orders strings by their first six bytes; 0 for null and for a column that is not there."""
    if name not in columns:
        return F.lit(0.0)
    head = F.rpad(F.hex(F.substring(F.encode(F.col(f"`{name}`").cast("string"), "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(0.0))


@dataclass
class _Cut:
    """How a cell is split: intervals of its dimension and of ties, narrowed around the cut; then a group in order."""

    leaves: int
    left: int
    dimension: str
    wanted: float
    intervals: list[tuple[str, float, float]] = field(default_factory=list)
    below: int = 0
    open: bool = True
    size: int = 0
    key: int = 0
    start: int = 0
    taken: int = 0

    def inside(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.intervals:
            out = out & F.col(name).between(low, high)
        return out

    def before(self) -> Column:
        """Whether a row lies left of the cut; rows of the cut group itself are taken by number."""
        last = (F.col("size") < self.size) | (F.col("size") == self.size) & (
            (F.col("key") < self.key) | (F.col("key") == self.key) & (F.col("start") < self.start))
        for name, low, high in reversed(self.intervals):
            last = (F.col(name) < low) | (F.col(name) <= high) & last
        return last

    def here(self) -> Column:
        return self.inside() & (F.col("size") == self.size) & (F.col("key") == self.key) & (F.col("start") == self.start)


def _by_cell(cuts: dict[int, _Cut], value: Callable[[_Cut], Column | float], otherwise: object = None) -> Column:
    out = None
    for cell, cut in cuts.items():
        out = (F.when if out is None else out.when)(F.col("cell") == cell, value(cut))
    return out.otherwise(otherwise)


def _narrowed(groups: DataFrame, cuts: dict[int, _Cut]) -> None:
    """Narrows the intervals of all cuts until each holds at most INTERVAL groups, or equal ones."""
    while going := {k: c for k, c in cuts.items() if c.open}:
        at = _by_cell(going, lambda c: F.col(c.intervals[-1][0]))
        width = _by_cell(going, lambda c: F.lit((c.intervals[-1][2] - c.intervals[-1][1]) or 1.0))
        low = _by_cell(going, lambda c: F.lit(c.intervals[-1][1]))
        rows = groups.filter(_by_cell(going, _Cut.inside, F.lit(False))).withColumn("at", at)
        binned = rows.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("at") - low) / width * BINS)).cast("int"))
        bins = binned.groupBy("cell", "bin").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"),
                                                 F.min("at").alias("low"), F.max("at").alias("high"))
        upto = F.sum("bytes").over(Window.partitionBy("cell").orderBy("bin"))
        gap = _by_cell(going, lambda c: F.lit(c.wanted - c.below))
        # BINS rows a cell before the filter, one after it.
        for r in bins.withColumn("upto", upto).filter((F.col("upto") > gap) & (F.col("upto") - F.col("bytes") <= gap)).collect():
            cut = going[r.cell]
            name = cut.intervals[-1][0]
            cut.below += r.upto - r.bytes
            cut.intervals[-1] = (name, r.low, r.high)
            if r.n <= INTERVAL:
                cut.open = False
            elif r.low == r.high:
                following = (cut.dimension, *TIES).index(name) + 1
                if following > len(TIES):
                    cut.open = False  # as good as equal keys
                else:
                    cut.intervals.append((TIES[following - 1], float("-inf"), float("inf")))
        unbounded = {k: c for k, c in going.items() if c.open and c.intervals[-1][1] == float("-inf")}
        if unbounded:
            rows = groups.filter(_by_cell(unbounded, _Cut.inside, F.lit(False)))
            at = _by_cell(unbounded, lambda c: F.col(c.intervals[-1][0]))
            for r in rows.groupBy("cell").agg(F.min(at).alias("low"), F.max(at).alias("high")).collect():
                cut = unbounded[r.cell]
                cut.intervals[-1] = (cut.intervals[-1][0], r.low, r.high)


def _level(groups: DataFrame, cells: dict[int, int], ranges: dict[str, float], whole: float) -> tuple[DataFrame, dict[int, int]]:
    """All cells with several leaves split in two."""
    split = F.col("cell").isin([k for k, n in cells.items() if n > 1])
    wide = [(F.max(d) - F.min(d)).alias(f"w_{d}") for d in DIMENSIONS]
    cuts: dict[int, _Cut] = {}
    for r in groups.filter(split).groupBy("cell").agg(F.sum("bytes").alias("bytes"), *wide, *[F.min(d).alias(d) for d in DIMENSIONS],
                                                      *[F.max(d).alias(f"m_{d}") for d in DIMENSIONS]).collect():
        widest = max(DIMENSIONS, key=lambda d: r[f"w_{d}"] / (ranges[d] or 1.0))
        left = cells[r.cell] // 2
        cuts[r.cell] = _Cut(cells[r.cell], left, widest, r.bytes * left / cells[r.cell], [(widest, r[widest], r[f"m_{widest}"])])
    below = {k: n for k, n in cells.items() if n == 1}
    below |= {k: c.left for k, c in cuts.items()} | {k + c.left: c.leaves - c.left for k, c in cuts.items()}
    if not cuts:
        return groups, below
    _narrowed(groups, cuts)
    rows = groups.filter(_by_cell(cuts, _Cut.inside, F.lit(False)))
    order = Window.partitionBy("cell").orderBy("size", "key", "start")
    placed = rows.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    gap = _by_cell(cuts, lambda c: F.lit(c.wanted - c.below))
    first = placed.filter(F.col("upto") > gap).groupBy("cell").agg(F.min(F.struct("upto", "bytes", "size", "key", "start", "stop")).alias("r"))
    for r in first.select("cell", "r.*").collect():
        cut = cuts[r.cell]
        rest = cut.wanted - cut.below - (r.upto - r.bytes)
        n = r.stop - r.start
        cut.size, cut.key, cut.start = r.size, r.key, r.start
        cut.taken = min(n, round(rest / r.size)) if r.bytes > whole else n * (rest >= r.bytes / 2)
    middle = F.col("start") + _by_cell(cuts, lambda c: F.lit(c.taken), 0)
    right = F.col("cell") + _by_cell(cuts, lambda c: F.lit(c.left), 0)

    def part(cell: Column, start: Column, stop: Column) -> Column:
        return F.struct(cell.cast("int").alias("cell"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))

    both = F.filter(F.array(part(F.col("cell"), F.col("start"), middle), part(right, middle, F.col("stop"))),
                    lambda p: p["stop"] > p["start"])
    one = F.array(part(F.when(_by_cell(cuts, _Cut.before, F.lit(True)), F.col("cell")).otherwise(right), F.col("start"), F.col("stop")))
    parts = F.explode(F.when(_by_cell(cuts, _Cut.here, F.lit(False)), both).otherwise(one)).alias("p")
    kept = [c for c in groups.columns if c not in ("cell", "start", "stop", "bytes")]
    out = groups.select(*kept, parts).select(*kept, "p.*").withColumn("bytes", (F.col("stop") - F.col("start")) * F.col("size"))
    return cut_lineage(out), below


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id",
           text_col: str = "text", source_col: str = "source", lang_col: str = "lang", carry: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` (and ``carried``) of every row of ``docs``.

    Give the number of ``shards``, or ``target_bytes`` for as many as that takes. ``size`` is the UTF-8 bytes of the text and
    16 more; a null text is empty. Shards have near equal bytes: what a cut misses its share by is at most half the group it
    meets, and groups of more than 1/256 of a shard are cut between rows. Dimensions are id, logarithm of the size, source and
    language (by their first bytes), of a group its smallest ones; null and missing columns count as 0. ``slot`` numbers
    the rows of a shard from 0 without gaps. Rows that repeat are rows each; an empty table gives no rows; with fewer
    groups than shards some shards may stay empty.

    Runs several small jobs for each level of the tree; points and groups are checkpointed. A group that many rows share
    meets its shard by a broadcast of at most 10 PART groups.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source, lang = _code(source_col, docs.columns), _code(lang_col, docs.columns)
    points = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), source.alias("at_source"), lang.alias("at_lang"),
        F.monotonically_increasing_id().alias("row"), *([] if carry is None else [carry.alias("carried")]))
    points = cut_lineage(points)  # so that row numbers stay as they are
    groups = points.groupBy("key", "size").agg(
        F.count("*").alias("stop"), F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("at_id"),
        F.min("at_source").alias("at_source"), F.min("at_lang").alias("at_lang"))
    groups = cut_lineage(groups.withColumns({
        "at_size": F.log2("size"), "tie_size": F.col("size").cast("double"), "tie_key": F.col("key").cast("double"),
        "start": F.lit(0).cast("long"), "cell": F.lit(0), "bytes": F.col("stop") * F.col("size")}))
    found = groups.agg(F.sum("bytes").alias("bytes"), F.sum("stop").alias("n"),
                       *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first()
    total, n = found["bytes"] or 0, found["n"] or 0
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    shards = shards or max(1, -(-total // target_bytes))
    cells = {0: shards}
    ranges = {d: found[d] or 0.0 for d in DIMENSIONS}
    while max(cells.values(), default=1) > 1:
        groups, cells = _level(groups, cells, ranges, total / shards / PART)
    placed = groups.select("key", "size", "start", "stop", F.col("cell").alias("shard"))
    # Fewer than 10 PART groups hold more than this many rows, and every cut makes two parts of one.
    crowded = F.broadcast(placed.groupBy("key", "size").agg(F.sum(F.col("stop") - F.col("start")).alias("n"), F.count("*").alias("parts"))
                          .filter((F.col("n") > max(1, n // (10 * PART))) | (F.col("parts") > 1)).select("key", "size"))
    few = points.join(crowded, ["key", "size"], "left_anti").join(placed.drop("start", "stop"), ["key", "size"])
    many = points.join(crowded, ["key", "size"]).withColumn("piece", F.shiftright("row", 33))
    # Numbers inside a group: per partition of the points, and one row for each of these before it.
    pieces = many.groupBy("key", "size", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("key", "size", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("key", "size", "piece").orderBy("row")
    numbered = (many.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["key", "size", "piece"])
                .withColumn("place", F.col("place") + F.col("offset")))
    ranges_of = F.broadcast(placed.join(crowded, ["key", "size"]).withColumnsRenamed({"key": "key_", "size": "size_"}))
    met = (F.col("key") == F.col("key_")) & (F.col("size") == F.col("size_")) & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("stop"))
    columns = ["doc_id", "size", "text_crc32", "row", "shard", *([] if carry is None else ["carried"])]
    sharded = cut_lineage(few.select(*columns).unionByName(numbered.join(ranges_of, met).select(*columns)))
    blocks = 1 + n // (shards * BLOCK)
    sharded = sharded.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    counted = sharded.groupBy("shard", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "block").orderBy("row")
    slot = (F.row_number().over(own) - 1).cast("long")
    return (sharded.withColumn("slot", slot).join(starts, ["shard", "block"]).withColumn("slot", F.col("slot") + F.col("offset"))
            .drop("row", "block", "offset"))


def write(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, files: int = 1, **columns: str) -> None:
    """Writes all columns of ``docs`` as Parquet folders ``shard=k`` of ``files`` files each."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = assign(docs, shards, target_bytes, carry=row, **columns)
    out = out.select(F.struct("shard", "slot").alias("place"), F.col("carried").alias("document"))
    dealt = out.withColumn("file", F.pmod("place.slot", F.lit(files))).withColumn("shard", F.col("place.shard"))
    dealt.repartition("shard", "file").select("document", F.col("place.slot").alias("slot"), "shard").write.partitionBy("shard").parquet(path)
