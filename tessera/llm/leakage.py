"""Evaluation passages inside training documents, found by Wu-Manber search over words.

Patterns are all runs of ``length`` words of the held-out items. A table of shifts over hashed blocks of three
words lets the scan jump over most positions; where the shift is zero, the hash of the pattern's last block and
of its first two words selects a bucket, and the words themselves are compared.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_columns
from tessera.functions.words import words
from tessera.sources.tables import spread

BLOCK = 3
LENGTH = 12
#: Letters of items that one broadcast holds, with about 12 bytes each; more items are searched in several passes.
SHARD_CHARS = 16_000_000
#: Places of the shift table for each word of the items, so that few blocks share one.
PLACES = 8


def _hash(a: str, b: str, c: str = "") -> int:
    return xxhash.xxh3_64_intdigest(f"{a} {b} {c}")


class WuManber:
    """Search tables over the word runs of a set of items.

    Shifts are one byte for each place of a hash table, where blocks that share a place have the least shift.
    Buckets are a sorted array of hashes with the text and word at which each run begins; the texts' words are
    kept once, and equal words are one object.
    """

    def __init__(self, items: Iterable[tuple[int, str]], length: int = LENGTH) -> None:
        if not BLOCK < length < 256:
            raise ValueError("a pattern must be longer than a block and shorter than 256 words")
        self.length = length
        self.far = length - BLOCK + 1
        self.items: list = []
        self.texts: list[list[str]] = []
        one: dict[str, str] = {}
        for item, text in items:
            w = words(text or "")
            if len(w) >= length:
                self.items.append(item)
                self.texts.append([one.setdefault(x, x) for x in w])
        size = 1 << max(12, (PLACES * sum(map(len, self.texts))).bit_length())
        self.mask = size - 1
        self.shift = bytearray([self.far]) * size
        hashes, place = array("Q"), array("Q")
        for t, w in enumerate(self.texts):
            last = len(w) - length
            for p in range(len(w) - BLOCK + 1):
                h = _hash(w[p], w[p + 1], w[p + 2])
                step, at = self.far - 1 - min(p, self.far - 1), h & self.mask
                if step < self.shift[at]:
                    self.shift[at] = step
                s = p - self.far + 1
                if 0 <= s <= last:
                    hashes.append(h ^ _hash(w[s], w[s + 1]))
                    place.append(t << 32 | s)
        order = np.argsort(np.frombuffer(hashes, np.uint64), kind="stable") if hashes else np.zeros(0, np.int64)
        self.hashes = array("Q", np.frombuffer(hashes, np.uint64)[order].tobytes()) if hashes else hashes
        self.place = array("Q", np.frombuffer(place, np.uint64)[order].tobytes()) if hashes else place

    def find(self, text: str) -> set:
        """Items of which ``text`` holds at least one run."""
        w = words(text)
        n, m, shift, mask, hashes = len(w), self.length, self.shift, self.mask, self.hashes
        found: set = set()
        i = m - 1
        while i < n:
            h = _hash(w[i - 2], w[i - 1], w[i])
            if step := shift[h & mask]:
                i += step
                continue
            j = i - m + 1
            h ^= _hash(w[j], w[j + 1])
            k = bisect_left(hashes, h)
            if k < len(hashes) and hashes[k] == h:
                run = w[j : i + 1]
                while k < len(hashes) and hashes[k] == h:
                    t, s = self.place[k] >> 32, self.place[k] & 0xFFFFFFFF
                    if self.items[t] not in found and self.texts[t][s : s + m] == run:
                        found.add(self.items[t])
                    k += 1
            i += 1
        return found


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_texts: list[str], length: int = LENGTH, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id) for every document with ``length`` words in a row of one of an item's texts.

    Null and empty texts match nothing; texts shorter than ``length`` words have no pattern. Repeated documents
    and items give one row per pair of ids. Only the named columns are read. The items are broadcast while
    their texts have at most ``shard_chars`` letters; a larger set is cut by hash into as many passes as it needs.
    """
    spark = docs.sparkSession
    slim = items.select(F.col(item_id).alias("item"), F.explode(F.array(*(F.col(c).cast("string") for c in item_texts))).alias("body")).where("item is not null and body is not null")
    chars = slim.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    shards = -(-chars // shard_chars) or 1
    wanted = spread(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).where("doc is not null and body is not null"))
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    parts = []
    for k in range(shards):
        part = slim if shards == 1 else slim.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k)
        search = spark.sparkContext.broadcast(WuManber(((r.item, r.body) for r in part.toLocalIterator()), length))

        def scan(ids: list, texts: list, search=search) -> list[tuple]:
            find = search.value.find
            return [(d, i) for d, t in zip(ids, texts) for i in sorted(find(t))]

        parts.append(map_columns(wanted, scan, f"{doc_id} {kinds[0]}, {item_id} {kinds[1]}"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
