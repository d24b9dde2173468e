"""Repetition inside one document, and the n-gram perplexity of documents.

``repeated`` measures the share of letters and digits that repeat earlier content exactly. ``perplexity``
scores documents with a modified Kneser-Ney trigram model counted over the whole corpus and rejects what lies
outside its language's band. The model never leaves the executors: its n-grams and those of the documents meet in
shards by hash, where the model's are sorted hash arrays and the documents' stream by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_columns
from tessera.functions.words import HAN, mostly_han, visible, words
from tessera.llm.pairs import leading, votes
from tessera.sources.tables import spread, written

RUN_WORDS, RUN_CHARS, SHARE = 5, 10, 0.3


def repeated_share(text: str, run_words: int = RUN_WORDS, run_chars: int = RUN_CHARS) -> float:
    """Share of the letters and digits that lie in runs which occurred earlier in the same text.

    A run has ``run_words`` words, or ``run_chars`` characters where Han characters outnumber other words.
    Case, spacing and punctuation do not matter. Texts shorter than a run have share 0.
    """
    units = words(text)
    if mostly_han(text):
        letters = "".join(units)
        runs = [letters[i : i + run_chars] for i in range(len(letters) - run_chars + 1)]
        sizes, length = [1] * len(letters), run_chars
    else:
        runs = list(zip(*(units[k:] for k in range(run_words))))
        sizes, length = [len(u) for u in units], run_words
    if len(set(runs)) == len(runs):
        return 0.0
    seen: set = set()
    covered = end = 0
    for i, run in enumerate(runs):
        if run in seen:
            covered += sum(sizes[max(end, i) : i + length])
            end = i + length
        else:
            seen.add(run)
    return covered / sum(sizes)


def repeated(records: DataFrame, share: float = SHARE) -> DataFrame:
    """(rec_table, rec_key, share) of records (rec_table, rec_key, text) whose repeated share reaches ``share``.

    Null keys, null and blank texts give no row; a repeated record gives one row.
    """

    def scan(tables: list, keys: list, texts: list) -> list[tuple]:
        return [(r, k, s) for r, k, t in zip(tables, keys, texts) if (s := repeated_share(t)) >= share]

    whole = spread(records.select("rec_table", "rec_key", "text").where("rec_key is not null and text is not null"))
    return map_columns(whole, scan, "rec_table string, rec_key string, share double").groupBy("rec_table", "rec_key").agg(F.max("share").alias("share"))


# --- modified Kneser-Ney -------------------------------------------------------------------------------------

#: n-grams of a model shard: what one task holds as arrays, 16 bytes each.
SHARD_NGRAMS = 500_000
#: The least records of a language that have a band of their own; the others share the band of all records.
OWN = 100
START = 1


def pieces(text: str) -> tuple[int, list[str]]:
    """Whether the text is mostly Han (1 or 0), and the model's words; Han characters are words, digits are alike."""
    han = int(mostly_han(text))
    spaced = HAN.sub(lambda m: f" {m[0]} ", text) if han else text
    return han, ["0" if w.isdecimal() else w for w in words(spaced)]


def code(han: int, word: str) -> int:
    """A word as 31 bits of its hash, never 0 or START."""
    return xxhash.xxh32_intdigest(word, han) >> 1 | 2


class Codes(dict):
    """Codes of the words met, with a bound."""

    def __missing__(self, key: tuple[int, str]) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        c = self[key] = code(*key)
        return c


def batch_trigrams(texts: list[str], codes: Codes) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which texts have words, and all their trigrams (u, v, w) as codes, each with its text's place among those.

    Two START marks open a text.
    """
    ids: list[int] = []
    kept, sizes = [], []
    for i, t in enumerate(texts):
        han, ws = pieces(t)
        if ws:
            ids += [START, START, *(codes[han, w] for w in ws)]
            kept.append(i)
            sizes.append(len(ws) + 2)
    flat, of = np.array(ids, np.int64), np.repeat(np.arange(len(kept)), sizes)
    inside = of[2:] == of[:-2]  # all three words of one text
    return kept, flat[:-2][inside], flat[1:-1][inside], flat[2:][inside], of[2:][inside]


def ngram_counts(records: DataFrame) -> DataFrame:
    """(u, v, w, n): counts of word trigrams over all records, added up in each batch before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            kept, *columns, _ = batch_trigrams(batch.column(0).to_pylist(), codes)
            if kept:
                order = np.argsort(key(*columns), kind="stable")
                columns = [c[order] for c in columns]
                first, end = np.array(runs(*columns), np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(c[first] for c in columns), end - first)], names=["u", "v", "w", "n"])

    texts = spread(records.select("text").where("text is not null"))
    return texts.mapInArrow(count, "u bigint, v bigint, w bigint, n bigint").groupBy("u", "v", "w").agg(F.sum("n").alias("n"))


def discounts(df: DataFrame, n: str) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4."""
    seen = {r[0]: r[1] for r in df.where(F.col(n) <= 4).groupBy(n).count().collect()}
    c = [0, *(seen.get(i, 0) for i in range(1, 5))]
    y = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
    return [0.0] + [min(max(i - (i + 1) * y * c[i + 1] / c[i], 0.05), i - 0.05) if c[i] and c[i + 1] else 0.75 * min(i, 1) for i in (1, 2, 3)]


def level(df: DataFrame, context: list[str], n: str, d: list[float]) -> DataFrame:
    """``df`` with p, the discounted probability of each n-gram given its context, and gamma, the weight of the lower order."""
    cut = F.when(F.col(n) == 1, d[1]).when(F.col(n) == 2, d[2]).otherwise(d[3])
    total = df.groupBy(*context).agg(F.sum(n).alias("total"), F.sum(cut).alias("kept"))
    p = F.greatest(F.col(n) - cut, F.lit(0.0)) / F.col("total")
    return df.join(total, context).select(*df.columns, p.alias("p"), (F.col("kept") / F.col("total")).alias("gamma"))


def fit(records: DataFrame) -> dict[str, DataFrame]:
    """The model's table ``model`` (u, v, w, p) of all trigrams, interpolated down to single words.

    Trigrams and bigrams are counted once and written (``_held``), as several orders are made of them.
    """
    tri = written(ngram_counts(records), "trigrams")
    bi = written(tri.groupBy("v", "w").agg(F.count("*").alias("n")), "bigrams")
    uni = bi.groupBy("w").agg(F.count("*").alias("n"))
    d3, d2 = discounts(tri, "n"), discounts(bi, "n")
    types, kinds = uni.agg(F.sum("n"), F.count("*")).first()
    p1 = uni.select("w", ((F.col("n") + 0.5) / F.lit(float((types or 0) + 0.5 * ((kinds or 0) + 1)))).alias("p1"))
    low = level(bi, ["v"], "n", d2).join(p1, "w").select("v", "w", (F.col("p") + F.col("gamma") * F.col("p1")).alias("low"))
    model = level(tri, ["u", "v"], "n", d3).join(low, ["v", "w"]).select("u", "v", "w", (F.col("p") + F.col("gamma") * F.col("low")).alias("p"))
    return {"model": model, "_held": [tri, bi]}


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def key(*parts: np.ndarray) -> np.ndarray:
    """The 64-bit hash of several columns of long integers, as the engine's ``xxhash64`` gives it."""
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(parts[0]), 42, np.uint64)
    for p in parts:
        h = h + _P5 + np.uint64(8)
        h ^= turn(p.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
        h = turn(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


MET = "shard int, model boolean, rec_table string, rec_key string, lang string, body bigint, hashes array<bigint>, logp array<double>"
_ARROW = pa.schema([("shard", pa.int32()), ("model", pa.bool_()), ("rec_table", pa.string()), ("rec_key", pa.string()), ("lang", pa.string()), ("body", pa.int64()), ("hashes", pa.list_(pa.int64())), ("logp", pa.list_(pa.float64()))])


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal rows of several sorted columns."""
    n = len(columns[0])
    turn = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        turn |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(turn) + 1).tolist(), n]
    return list(zip(edges, edges[1:])) if n else []


def lists(values: np.ndarray, parts: list[tuple[int, int]]) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array([0, *(b for _, b in parts)], pa.int64()), pa.array(values))


def packed(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Model rows (hash, logp) as one row of arrays for each shard and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.mod(h, shards)
            order = np.argsort(at, kind="stable")
            parts = runs(at[order])
            none = lambda t: pa.nulls(len(parts), t)
            columns = [pa.array([int(at[order[a]]) for a, _ in parts], pa.int32()), pa.array([True] * len(parts)), none(pa.string()), none(pa.string()), none(pa.string()), none(pa.int64()), lists(h[order], parts), lists(p[order], parts)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return run


def grams_by_shard(records: DataFrame, shards: int) -> DataFrame:
    """The trigrams of each record as hashes, one row of them for each shard that it has any in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            tables, keys, texts = (c.to_pylist() for c in batch.columns)
            kept, u, v, w, of = batch_trigrams(texts, codes)
            if not kept:
                continue
            about = []
            for i in kept:
                best, sure = leading(*votes(texts[i]))
                about.append((tables[i], keys[i], best if sure >= 0.5 else "und", xxhash.xxh64_intdigest(visible(texts[i])) >> 1))
            h = key(u, v, w)
            at = np.mod(h, shards)
            order = np.lexsort((at, of))
            h, of, at = h[order], of[order], at[order]
            parts = runs(of, at)
            owner = [about[of[a]] for a, _ in parts]
            columns = [pa.array([int(at[a]) for a, _ in parts], pa.int32()), pa.array([False] * len(parts)), *(pa.array([o[i] for o in owner], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))), lists(h, parts), pa.nulls(len(parts), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return spread(records).mapInArrow(run, MET)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of log probabilities: of each shard first come the model's n-grams, then the records'."""
    shard, model, arrays = None, [], None
    schema = pa.schema([("rec_table", pa.string()), ("rec_key", pa.string()), ("lang", pa.string()), ("body", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])
    for batch in batches:
        at, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in runs(at, kind):
            part = batch.slice(a, b - a)
            if at[a] != shard:
                shard, model, arrays = at[a], [], None
            asked = part.column(6)
            if kind[a]:
                model.append((asked.flatten().to_numpy(), part.column(7).flatten().to_numpy()))
                continue
            if arrays is None:
                hashes = np.concatenate([h for h, _ in model]) if model else np.zeros(0, np.int64)
                order = np.argsort(hashes, kind="stable")
                arrays, model = (hashes[order], np.concatenate([p for _, p in model])[order] if model else np.zeros(0)), []
            h, n = asked.flatten().to_numpy(), asked.value_lengths().to_numpy().astype(np.int64)
            logp = np.full(len(h), math.log(1e-9))
            if len(arrays[0]):
                spot = np.minimum(np.searchsorted(arrays[0], h), len(arrays[0]) - 1)
                logp = np.where(arrays[0][spot] == h, arrays[1][spot], logp)
            yield pa.RecordBatch.from_arrays([*(part.column(i).cast(schema.field(j).type) for j, i in enumerate((2, 3, 4, 5))), pa.array(np.add.reduceat(logp, np.cumsum(n) - n)), pa.array(n)], schema=schema)


def perplexity(records: DataFrame, low: float = 0.01, high: float = 0.99, shard_ngrams: int = SHARD_NGRAMS, own: int = OWN) -> DataFrame:
    """(rec_table, rec_key, lang, n_words, perplexity, lower, upper, rejected) for each record.

    The model counts all records. Bands are the ``low`` and ``high`` quantiles of the language, or of all records
    for languages of fewer than ``own``; a record outside its band is rejected. Null keys or texts and texts
    without a word give no row; of a repeated record the first in value order counts.
    """
    whole = records.select("rec_table", "rec_key", "text").where("rec_key is not null and text is not null")
    model = fit(whole)
    shards = max(records.sparkSession.sparkContext.defaultParallelism, -(-model["_held"][0].count() // shard_ngrams))
    hashed = model["model"].select(F.xxhash64("u", "v", "w").alias("hash"), F.log("p").alias("logp")).mapInArrow(packed(shards), MET)
    both = hashed.unionByName(grams_by_shard(whole, shards)).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("model").desc())
    scored = both.mapInArrow(met, "rec_table string, rec_key string, lang string, body bigint, total double, n bigint")
    scored = scored.groupBy("rec_table", "rec_key", "lang", "body").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    scored = scored.groupBy("rec_table", "rec_key").agg(F.min_by(F.struct("lang", "mean", "n"), F.col("body")).alias("x"))
    scored = written(scored.select("rec_table", "rec_key", "x.lang", "x.n", F.exp(-F.col("x.mean")).alias("perplexity")), "perplexity")
    edges = [F.percentile_approx("perplexity", q, 10_000).alias(n) for q, n in ((low, "lower"), (high, "upper"))]
    bands = {r.lang: r for r in scored.groupBy("lang").agg(F.count("*").alias("size"), *edges).collect() if r["size"] >= own and r.lang != "und"}  # one row per language
    every = scored.agg(*edges).first()

    def edge(name: str) -> Column:
        out = F.lit(every[name]).cast("double")
        for lang, r in bands.items():
            out = F.when(F.col("lang") == lang, F.lit(r[name])).otherwise(out)
        return out.alias(name)

    out = scored.select("rec_table", "rec_key", "lang", "n", "perplexity", edge("lower"), edge("upper"))
    return out.select("rec_table", "rec_key", "lang", F.col("n").alias("n_words"), "perplexity", "lower", "upper", ((F.col("perplexity") < F.col("lower")) | (F.col("perplexity") > F.col("upper"))).alias("rejected"))
