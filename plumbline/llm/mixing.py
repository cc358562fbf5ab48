"""Mixing sources to target weights by Pfair scheduling.

Sources have integer weights with sum A. A source's documents form blocks; block j of a source with
weight a has the release time floor(j A / a) and the deadline ceil((j + 1) A / a), and each slot goes to
the released block with the earliest deadline (ties: the
shorter wait for the following deadline, then the source). After any
number of slots, every source is less than one block from its target share. Weights are exact: those
that are not integers are scaled to integers by the common denominator of their fractions, never rounded.

A source that runs out leaves the mix and the others go on in a new phase with their own weights, so
all documents get a place; ``phase`` 0 is the stretch that holds the target weights of all sources.

The schedule is made by a task that holds a row for each source and yields slots batch by batch, in pieces:
each piece is written to the shared folder, and what it holds tells where the next one begins, so a lost
executor costs one piece. Whole frames of A slots are repeated as arrays where they are short.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.warc import shared_folder
from plumbline.session import ship

#: Blocks up to which the schedule is broadcast (some 40 bytes each).
BROADCAST_ROWS = 200_000
#: Slots of a piece of the schedule, of a batch, and of a frame that is repeated as an array.
PIECE, BATCH, FRAME = 20_000_000, 1 << 16, 1 << 16
#: Bits of the hash that orders a source's documents.
HASH_BITS = 60


def exact_weights(weights: dict[str, float]) -> dict[str, int]:
    """The least integers in exactly the proportions of the weights."""
    if not weights or any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive")
    parts = {k: Fraction(w) for k, w in weights.items()}
    scale = math.lcm(*(p.denominator for p in parts.values()))
    whole = {k: int(p * scale) for k, p in parts.items()}
    common = math.gcd(*whole.values())
    return {k: w // common for k, w in whole.items()}


def slots(weights: dict[str, int], taken: dict[str, int] | None = None, slot: int = 0):
    """(source, block) of each slot from ``slot`` on, without end: earliest deadline first among released blocks.

    ``taken`` are the blocks that went before; with the slot they are the whole state.
    """
    total = sum(weights.values())

    def window(source: str, j: int) -> tuple[int, int, int, str, int]:
        a = weights[source]
        deadline = -(-(j + 1) * total // a)
        return j * total // a, deadline, -(-(j + 2) * total // a) - deadline, source, j

    waiting = [window(s, (taken or {}).get(s, 0)) for s in weights]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    while True:
        while waiting and waiting[0][0] <= slot:
            _, *rest = heapq.heappop(waiting)
            heapq.heappush(ready, tuple(rest))
        deadline, _, source, j = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        yield source, j
        slot += 1
        heapq.heappush(waiting, window(source, j + 1))


class Mix:
    """The state of a mix: blocks of each source, taken in all and before this phase, and the slots so far."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, int], taken: dict[str, int] | None = None, first: dict[str, int] | None = None, slot: int = 0, start: int = 0, phase: int = 0) -> None:
        self.blocks, self.weights = blocks, weights
        self.taken = dict.fromkeys(blocks, 0) | (taken or {})
        self.first = dict.fromkeys(blocks, 0) | (first or {})
        self.slot, self.start, self.phase = slot, start, phase

    def _active(self) -> dict[str, int]:
        """Weights of the sources of this phase: those that had a block left when it began."""
        return {s: self.weights[s] for s, n in self.blocks.items() if self.first[s] < n}

    def run(self, most: int):
        """Arrays (source names, blocks, slots, phase) of the next ``most`` slots or of all that are left.

        A phase ends in front of the first slot that would go to a source with no block left.
        """
        end = self.slot + most
        while self.slot < end and any(self.taken[s] < n for s, n in self.blocks.items()):
            own = self._active()
            total = sum(own.values())
            whole = min(((self.blocks[s] - self.taken[s]) // a for s, a in own.items()), default=0)
            whole = min(whole, (end - self.slot) // total)
            if total <= FRAME and whole and (self.slot - self.start) % total == 0:
                yield from self._frames(own, total, whole)
                continue
            names, blocks, at = [], [], self.slot
            over = False
            for source, j in slots(own, {s: self.taken[s] - self.first[s] for s in own}, self.slot - self.start):
                if self.first[source] + j >= self.blocks[source]:
                    over = True
                    break
                names.append(source)
                blocks.append(self.first[source] + j)
                self.taken[source] += 1
                self.slot += 1
                if len(names) == BATCH or self.slot == end:
                    yield names, np.array(blocks, np.int64), np.arange(at, self.slot), self.phase
                    names, blocks, at = [], [], self.slot
                    if self.slot == end:
                        break
            if names:
                yield names, np.array(blocks, np.int64), np.arange(at, self.slot), self.phase
            if over:
                self.phase, self.start, self.first = self.phase + 1, self.slot, dict(self.taken)

    def _frames(self, own: dict[str, int], total: int, whole: int):
        """``whole`` frames from here on, each like the first."""
        order = [pair for pair, _ in zip(slots(own), range(total), strict=False)]
        names, inner, step = [s for s, _ in order], np.array([j for _, j in order], np.int64), np.array([own[s] for s, _ in order], np.int64)
        base = np.array([self.taken[s] for s, _ in order], np.int64)
        many = max(1, BATCH // total)
        for at in range(0, whole, many):
            frames = np.arange(at, min(at + many, whole), dtype=np.int64)[:, None]
            yield names * len(frames), (base + inner + frames * step).ravel(), self.slot + (frames * total + np.arange(total)).ravel(), self.phase
        self.slot += whole * total
        for s, a in own.items():
            self.taken[s] += whole * a


SCHEDULE = "s string, block long, slot long, phase int"


def schedule(spark: SparkSession, blocks: dict[str, int], weights: dict[str, int], *, piece: int = PIECE) -> DataFrame:
    """(s, block, slot, phase) of every block; the driver holds a row for each source alone."""
    ship(spark)
    folder, mix, number = shared_folder(spark, "mix"), Mix(blocks, weights), 0
    end = sum(blocks.values())

    def task(state: Mix):
        def run(batches):
            for _ in batches:
                pass
            for names, own, at, phase in state.run(piece):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(own), pa.array(at), pa.array(np.full(len(at), phase, np.int32))], names=["s", "block", "slot", "phase"])

        return run

    while mix.slot < end:
        # A phase may end within the piece; the rows of its last phase tell where that one began.
        spark.range(1).repartition(1).mapInArrow(task(mix), SCHEDULE).write.parquet(f"{folder}/{number}")
        written = spark.read.schema(SCHEDULE).parquet(f"{folder}/{number}")
        last = written.agg(F.max("phase")).first()[0]
        now, taken, first = F.col("phase") == last, dict(mix.taken), dict(mix.first)
        facts = written.groupBy("s").agg((F.max("block") + 1).alias("taken"), F.min(F.when(now, F.col("block"))).alias("first"), F.min(F.when(now, F.col("slot"))).alias("start"), F.count("*").alias("n")).collect()  # a row for each source
        for r in facts:
            taken[r["s"]] = r["taken"]
        start = mix.start
        if last > mix.phase:
            first = {s: next((r["first"] for r in facts if r["s"] == s and r["first"] is not None), taken[s]) for s in blocks}
            start = min(r["start"] for r in facts if r["start"] is not None)
        mix = Mix(blocks, weights, taken, first, mix.slot + sum(r["n"] for r in facts), start, last)
        number += 1
    found = spark.read.schema(SCHEDULE).parquet(*(f"{folder}/{k}" for k in range(number)))
    return F.broadcast(found) if end <= BROADCAST_ROWS else found


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 8, buckets: int | None = None, carry: bool = False) -> DataFrame:
    """(id, source, position, slot, block, phase) of every row of ``docs``: its place in the mix.

    Documents of a source are taken in the order of 60 bits of their id's MD5, then of the id, ``block_rows`` to
    a block (the last block of a source may be short). Without ``weights`` a source weighs the square
    root of its rows; sources that ``weights`` does not name weigh the least weight named. A null source is a source of its own (named
    by an empty text, apart from a source with that name only in the output). Null ids and repeated rows
    each get a place; an empty table gives an empty result; other columns are ignored, or with ``carry``
    come along in a struct ``row`` of all columns of ``docs``, so that each row gets its own place; rows
    with a null id are then spread by a hash of the row.

    Ranks within a source come from counts of (source, bucket), buckets being ranges of the hash, so a source with
    most rows is spread over all buckets; the driver gets one row for each source, of any number.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *row)
    digest = lambda text: F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")
    whole = F.xxhash64("row", F.lit(7)) if carry else F.lit(0)
    rows = rows.withColumn("h", F.when(F.col("id").isNull(), digest(whole.cast("string"))).otherwise(digest(F.col("id").cast("string"))))
    bucket = F.least(F.floor(F.col("h") / F.lit(float(1 << HASH_BITS) / buckets)), F.lit(buckets - 1)).cast("int")
    rows = rows.withColumn("s", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))).withColumn("bucket", bucket)
    sizes = rows.groupBy("s", "bucket").agg(F.count("*").alias("n"))
    by_source = {r["s"]: r["n"] for r in sizes.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    empty = f"{id_col} {kind}, source string, position long, slot long, block long, phase int" + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    if not by_source:
        return spark.createDataFrame([], empty)
    named = {("-" if k is None else f"+{k}"): w for k, w in (weights or {}).items()}
    least = min(named.values(), default=0)
    shares = exact_weights({s: named.get(s, least) if named else math.sqrt(by_source[s]) for s in sorted(by_source)})
    plan = schedule(spark, {s: -(-n // block_rows) for s, n in by_source.items()}, shares)

    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("s", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("s", "bucket").orderBy("h", "id", *([whole] if carry else []))
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(before, ["s", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows)).withColumn("offset", F.col("rank") % block_rows)
    placed = ranked.join(plan, ["s", "block"])
    return placed.select(F.col("id").alias(id_col), "source", (F.col("slot") * block_rows + F.col("offset")).alias("position"), "slot", "block", "phase", *(["row"] if carry else []))
