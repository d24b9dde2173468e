"""Documents put into containers of fixed capacity by Karmarkar-Karp multiway differencing.

A document larger than the capacity is cut into full containers and one remainder; everything else stays
whole. Items are dealt by hash into blocks of bounded size, each block is differenced into ``k`` windows, and
``k`` rises for as long as a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
from bisect import insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.sources.tables import written

#: The published splitting pattern of a public byte-level tokenizer (fixed value).
TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points of Unicode white space.
SPACES = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: Items of a block: what one task differences at a time.
BLOCK_ITEMS = 4096
#: Blocks that a task differences one after the other. Stated, as their few bytes say nothing of the work they are.
BLOCKS_A_TASK = 3


def token_count(text: Column | str) -> Column:
    """Matches of :data:`TOKEN` in a text, counted in the JVM; null and empty texts have none.

    ``\\s`` is spelled out as Unicode white space, which the pattern means and Java's ``\\s`` is not.
    """
    c = F.col(text) if isinstance(text, str) else text
    space = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SPACES)
    pattern = TOKEN.replace(r"[^\s", f"[^{space}").replace(r"\s+(?!\S)|\s+", f"[{space}]+(?![^{space}])|[{space}]+")
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("long")


def difference(sizes: list[int], k: int) -> list[tuple[int, object]]:
    """``k`` windows as (sum, tree of item numbers) by largest differencing.

    A partial partition is an ascending list of its non-empty windows; the other windows are empty. The two
    partials with the widest spread are merged, the fullest windows of one with the emptiest of the other.
    """
    heap: list[tuple[int, int, list]] = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if len(b) == 1 and over <= 1:
            s, tie, tree = b[0]
            if over == 1:
                s0, _, t0 = a.pop(0)
                s, tree = s + s0, (t0, tree)
            insort(a, (s, serial, tree), key=lambda x: x[0])
        else:
            mixed = []
            for j in range(max(over, 0)):  # a's emptiest with b's fullest
                s0, _, t0 = a[j]
                s1, _, t1 = b[over - 1 - j]
                mixed.append((s0 + s1, serial, (t0, t1)))
            a = sorted(mixed + a[max(over, 0) :] + b[max(over, 0) :], key=lambda x: x[0])
        serial += 1
        spread = a[-1][0] - (a[0][0] if len(a) == k else 0)
        heapq.heappush(heap, (-spread, serial, a))
    return [(s, t) for s, _, t in heap[0][2]] if heap else []


def pack_block(sizes: list[int], capacity: int) -> list[int]:
    """The window of each item: no window above ``capacity``; the count starts at the least possible and rises."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        excess = sum(s - capacity for s, _ in windows if s > capacity)
        if not excess:
            break
        k += max(1, excess // capacity)
    at = [0] * len(sizes)
    for w, (_, tree) in enumerate(windows):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                at[x] = w
    return at


def pack(docs: DataFrame, containers: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(window_id, container, doc_id, part, parts, tokens) for ``docs`` (doc_id, tokens) and ``containers`` (window_id, capacity).

    Every document appears in every kind of container; ``parts`` exceeds 1 only where its size exceeds the
    capacity. Null sizes count as 0; null ids and null or non-positive capacities give no row. A repeated id
    is a separate document. ``container`` is unique within a kind.
    """
    items = docs.select(F.col("doc_id"), F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0)).alias("tokens")).where("doc_id is not null")
    items = written(items, "sizes")  # texts are measured once, for both branches below
    kinds = containers.select("window_id", F.col("capacity").cast("long").alias("capacity")).where("window_id is not null and capacity > 0")
    blocks = -(-items.count() // block_items) or 1
    each = items.select("*", F.explode(F.array(*(F.struct(F.lit(w).alias("window_id"), F.lit(c).cast("long").alias("capacity")) for w, c in sorted(set(kinds.collect()))))).alias("kind")).select("doc_id", "tokens", "kind.*")
    full = F.expr("case when tokens > capacity then tokens div capacity else 0 end")
    rest = F.expr("case when tokens > capacity then tokens % capacity else tokens end")
    each = each.withColumn("full", full).withColumn("rest", rest).withColumn("parts", F.greatest(F.col("full") + (F.col("rest") > 0).cast("long"), F.lit(1)))
    doc, win = dict(docs.dtypes)["doc_id"], dict(containers.dtypes)["window_id"]
    whole = each.where("full > 0").select("window_id", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"), "parts", F.col("capacity").alias("tokens"))
    whole = whole.select("window_id", F.concat_ws("-", F.lit("f"), "doc_id", "part").alias("container"), "doc_id", F.col("part").cast("long").alias("part"), "parts", "tokens")
    loose = each.where("full = 0 or rest > 0").select("window_id", "capacity", "doc_id", F.col("full").alias("part"), "parts", F.col("rest").alias("tokens"))
    loose = loose.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    schema = StructType.fromDDL(f"window_id {win}, container string, doc_id {doc}, part bigint, parts bigint, tokens bigint")
    arrow = to_arrow_schema(schema)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sizes = group.column("tokens").to_pylist()
        at = pack_block(sizes, group.column("capacity")[0].as_py())
        names = pa.array([f"{key[1].as_py()}-{w}" for w in at], pa.string())
        return pa.Table.from_arrays([group.column("window_id"), names, group.column("doc_id"), group.column("part"), group.column("parts"), group.column("tokens")], schema=arrow)

    tasks = max(1, -(-blocks * kinds.count() // BLOCKS_A_TASK))
    packed = loose.repartition(tasks, "window_id", "block").groupBy("window_id", "block").applyInArrow(run, schema)
    return whole.unionByName(packed)
