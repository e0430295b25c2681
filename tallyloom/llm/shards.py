"""Sharded stores and resharding by minimum-cost flow.

A store is a folder of blocks, each one Parquet file of one shard, and manifests, one a generation:

    <path>/data-<g>/shard=<s>/block=<b>/   rows (row, size, crc32, slot), `row` being the document with all its columns
    <path>/schema                          no rows
    <path>/manifest-<g>                    rows (generation, shard, block, first, rows, bytes), one a block

Resharding reads the manifest only to plan: old shard sizes and new capacities are the supplies and demands of a flow whose arcs cost
nothing within a shard and one a byte between shards. Each old shard's line of blocks is then cut where its flows end. Blocks
that lie wholly in what stays are left as they are; the others are the affected files, and only they are read and written. The new manifest
is written last, so a reader sees one generation or the other. Stages are written tables and every order is by content, so lost
executors recompute the same rows.

Sizes are UTF-8 bytes of text plus 8. Blocks are ranges of a hash of doc_id and text, so none grows with a source or a key; only rows that are equal
in both share one. A block's rows have consecutive slots.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a block aims at, and blocks that a shard has at least, so that what stays of it is mostly whole blocks.
BLOCK_BYTES, LEAST_BLOCKS = 128 << 20, 4
ROW_BYTES = 8
STORED = "size long, crc32 long, slot long, shard int, block long"


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def _tight_path(source: int, sink: int, leaving: dict[int, list[int]], nextarc: dict[int, int], tight: Callable[[int], bool], to: list[int]) -> list[int]:
    """A path of tight arcs that still have room, each node's used-up arcs being passed over once for all."""
    path, at, on = [], source, {source}
    while at != sink:
        arcs = leaving[at]
        while nextarc[at] < len(arcs) and not (tight(arcs[nextarc[at]]) and to[arcs[nextarc[at]]] not in on):
            nextarc[at] += 1
        if nextarc[at] < len(arcs):
            path.append(arcs[nextarc[at]])
            at = to[path[-1]]
            on.add(at)
        elif not path:
            return []
        else:
            on.discard(at)
            at = to[path.pop() ^ 1]
            nextarc[at] += 1
    return path


def cheapest_flow(supply: list[int], demand: list[int]) -> dict[tuple[int, int], int]:
    """(from, to) -> bytes, of the cheapest flow from old shards of these sizes to new ones of these capacities; shards of one number are the same.

    Supplies and demands have one sum. All bytes that move pass one relay, so arcs grow with shards and not with pairs of them. Rounds of
    Dijkstra give the potentials, and paths of arcs tight under these are filled before the next round."""
    if sum(supply) != sum(demand):
        raise ValueError("supplies and demands differ")
    n, m = len(supply), len(demand)
    source, sink, relay = n + m, n + m + 1, n + m + 2
    to, room, cost, leaving = [], [], [], defaultdict(list)

    def arc(a: int, b: int, bytes_: int, price: int) -> None:
        for x, y, r, c in ((a, b, bytes_, price), (b, a, 0, -price)):
            leaving[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        if i < m:
            arc(i, n + i, s, 0)
        arc(i, relay, s, 1)
    for j, d in enumerate(demand):
        arc(relay, n + j, sum(supply), 0)
        arc(n + j, sink, d, 0)
    potential, left = [0] * (n + m + 3), sum(supply)
    while left:
        far = {source: 0}
        queue, done = [(0, source)], set()
        while queue:
            d, a = heapq.heappop(queue)
            if a in done:
                continue
            done.add(a)
            for e in leaving[a]:
                b = to[e]
                if room[e] and b not in done and d + cost[e] + potential[a] - potential[b] < far.get(b, 1 << 60):
                    far[b] = d + cost[e] + potential[a] - potential[b]
                    heapq.heappush(queue, (far[b], b))
        for a in range(len(potential)):
            potential[a] += far.get(a, far[sink])
        nextarc = dict.fromkeys(range(len(potential)), 0)
        while path := _tight_path(source, sink, leaving, nextarc, lambda e: room[e] and cost[e] + potential[to[e ^ 1]] == potential[to[e]], to):
            some = min(left, *(room[e] for e in path))
            for e in path:
                room[e] -= some
                room[e ^ 1] += some
            left -= some
            if not left:
                break
    flow: dict[tuple[int, int], int] = {}
    through, wanted = [], []
    for e in range(0, len(to), 2):
        a, b, moved = to[e ^ 1], to[e], room[e ^ 1]
        if not moved:
            continue
        if a < n and b == relay:
            through.append([a, moved])
        elif a < n and n <= b < n + m:
            flow[a, b - n] = moved
        elif a == relay:
            wanted.append([b - n, moved])
    while through:  # the relay's bytes, in order of shards
        some = min(through[0][1], wanted[0][1])
        flow[through[0][0], wanted[0][0]] = some
        for side in (through, wanted):
            side[0][1] -= some
            if not side[0][1]:
                side.pop(0)
    return flow


def capacities(total: int, n: int) -> list[int]:
    """Bytes for each of n shards, at most one byte apart."""
    return [total * (k + 1) // n - total * k // n for k in range(n)]


def manifest(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The blocks of a generation, the latest if none is given."""
    return spark.read.parquet(f"{path}/manifest-{latest(spark, path) if generation is None else generation}")


def latest(spark: SparkSession, path: str) -> int:
    """The last generation whose manifest is complete."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return max(int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found)


def _write(rows: DataFrame, path: str, generation: int) -> DataFrame:
    """Write rows (row, size, crc32, slot, shard, block) as a file a block; their part of the manifest."""
    rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "slot").write.partitionBy("shard", "block").parquet(f"{path}/data-{generation}")
    made = rows.sparkSession.read.schema(STORED).parquet(f"{path}/data-{generation}").groupBy("shard", "block").agg(F.min("slot").alias("first"), F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return made.select(F.lit(generation).alias("generation"), "shard", "block", "first", "rows", "bytes")


def _read(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """The rows of these blocks, with their generation. Only their files are opened; their names go by the driver, as with any scan."""
    folders = defaultdict(list)
    for b in blocks.select("generation", "shard", "block").collect():
        folders[b["generation"]].append(f"{path}/data-{b['generation']}/shard={b['shard']}/block={b['block']}")
    schema = spark.read.parquet(f"{path}/schema").schema
    out = spark.createDataFrame([], schema).withColumn("generation", F.lit(0))
    for g in sorted(folders):
        some = spark.read.schema(schema).option("basePath", f"{path}/data-{g}").parquet(*folders[g]).withColumn("generation", F.lit(g))
        out = some if g == min(folders) else out.unionByName(some)
    return out


def write_shards(docs: DataFrame, path: str, n: int, block_bytes: int = BLOCK_BYTES) -> None:
    """Write docs (doc_id, text, further columns of any name) as generation 0 of a store of n shards, by a hash of doc_id and text.

    Slots count a shard's rows from 0 in order of that hash. Null ids and texts are values like others, rows that repeat get a slot each, an
    empty table gives a store without blocks."""
    spark, h = docs.sparkSession, F.xxhash64("doc_id", "text")
    rows = docs.select(F.struct("*").alias("row"), text_size().alias("size"), text_crc32().alias("crc32"), h.alias("h"), F.pmod(h, F.lit(n)).cast("int").alias("shard"))
    sizes = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # n rows
    blocks = F.array(*[F.lit(max(LEAST_BLOCKS, -(-sizes.get(k, 0) // block_bytes))).cast("long") for k in range(n)])
    place = F.shiftrightunsigned("h", 33)  # 31 bits
    rows = rows.withColumn("block", F.shiftright(place * F.get(blocks, F.col("shard")), 31))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = counted.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("h", "row.doc_id", "row.text")
    placed = rows.join(starts, ["shard", "block"]).withColumn("slot", F.col("start") + F.row_number().over(within) - 1)
    placed = placed.select("row", "size", "crc32", "slot", "shard", "block")
    spark.createDataFrame([], placed.schema).coalesce(1).write.parquet(f"{path}/schema")
    if sizes:
        made = _write(placed, path, 0)
    else:
        made = spark.createDataFrame([], "generation int, shard int, block long, first long, rows long, bytes long")
    made.write.parquet(f"{path}/manifest-0")


def plan_transfers(sizes: dict[int, int], n: int) -> dict[int, list[tuple[int, int]]]:
    """For each old shard, (past, to): its line of bytes up to `past` goes to that shard, what stays first."""
    supply = [sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1)]
    flow = cheapest_flow(supply, capacities(sum(supply), n))
    cuts = {}
    for k in sizes:
        past, cuts[k] = 0, []
        for to in sorted((j for i, j in flow if i == k), key=lambda j: (j != k, j)):
            past += flow[k, to]
            cuts[k].append((past, to))
    return cuts


def reshard(spark: SparkSession, path: str, n: int) -> int:
    """Bring a store to n shards of equal bytes, moving the fewest; returns the new generation.

    A row goes where the middle of its bytes lies, so a shard's size is off by at most half a row for each cut. Rows that stay keep their slots; those
    that come get the slots behind them, by old shard and order there."""
    old = latest(spark, path)
    blocks = manifest(spark, path, old)
    sizes = {r["shard"]: r["bytes"] for r in blocks.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row a shard
    cuts = spark.createDataFrame([(k, v) for k, v in plan_transfers(sizes, n).items()], "shard int, cuts array<struct<past: long, to: int>>")
    line = Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    laid = blocks.join(F.broadcast(cuts), "shard").withColumn("at", F.coalesce(F.sum("bytes").over(line), F.lit(0)))  # cuts: at most a row a shard
    stays = (F.get("cuts", F.lit(0))["to"] == F.col("shard")) & (F.col("at") + F.col("bytes") <= F.get("cuts", F.lit(0))["past"])
    whole, affected = laid.where(stays).select(*blocks.columns), laid.where(~stays)
    key = ["generation", "shard", "block"]
    if not sizes:
        blocks.write.parquet(f"{path}/manifest-{old + 1}")
        return old + 1
    rows = _read(spark, path, affected)
    # where the middle of each row lies, from sizes and slots alone; then each block's pieces
    upto = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    narrow = rows.select(*key, "slot", "size").join(affected.select(*key, "at", "cuts"), key)
    middle = 2 * (F.col("at") + F.sum("size").over(upto)) - F.col("size")
    to = narrow.withColumn("middle", middle).select(*key, "slot", F.get(F.filter("cuts", lambda c: F.col("middle") < 2 * c["past"]), F.lit(0))["to"].alias("to"))
    pieces = to.groupBy(*key, "to").agg(F.min("slot").alias("low"), F.count("*").alias("n")).withColumn("here", F.col("to") == F.col("shard"))
    ahead = Window.partitionBy("to").orderBy(F.desc("here"), "shard", "low")
    kept = whole.groupBy(F.col("shard").alias("to")).agg(F.sum("rows").alias("kept"))
    pieces = pieces.join(kept, "to", "left").select(
        *key, "to", "low", "n",
        (F.row_number().over(ahead) - 1).cast("long").alias("label"),
        (F.coalesce("kept", F.lit(0)) + F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
    )
    of = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("low", "n", "to", "label", "start"))).alias("pieces"))  # at most a piece for each new shard
    mine = F.get(F.filter("pieces", lambda p: (F.col("slot") >= p["low"]) & (F.col("slot") < p["low"] + p["n"])), F.lit(0))
    moved = rows.join(of, key).withColumn("p", mine)
    moved = moved.select("row", "size", "crc32", (F.col("p.start") + F.col("slot") - F.col("p.low")).alias("slot"), F.col("p.to").alias("shard"), F.col("p.label").alias("block"))
    whole.unionByName(_write(moved, path, old + 1)).write.parquet(f"{path}/manifest-{old + 1}")
    return old + 1


def read_shards(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """(row, size, crc32, slot, shard, block, generation) of all rows of a store, `row` with the document's own columns."""
    return _read(spark, path, manifest(spark, path, generation))
