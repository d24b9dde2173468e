"""Question pools: keys, classes, buckets, cascades of reasons, deduplication, quotas and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.answers import big_number, valid_reference
from tessera.functions.pytext import col, hash_order, strip
from tessera.sources.tables import written

KEY_CHARS = 120

# Keywords of the subjects, in the order in which they are tried, and their shares.
EXCLUDED = {
    "物理": "force,velocity,acceleration,newton,energy,momentum,circuit,voltage,resistance,kinetic,potential energy,torque,magnetic,electric field,wave,optics,thermodynamic",
    "CS/算法": "algorithm,complexity,big-o,sorting,binary search,dynamic programming,graph algorithm,data structure,hash,linked list,binary tree,stack,queue",
}
SUBJECTS = {
    "代数/函数": "equation,solve for,roots,polynomial,quadratic,factori,inequality,function,logarithm,exponential,absolute value,rational,irrational",
    "几何": "triangle,circle,angle,polygon,area of,perimeter,geometry,coordinate,distance between,volume,surface area,cone,sphere,cylinder,rectangle,square",
    "概率统计": "probability,random variable,distribution,expectation,variance,bayes,binomial,poisson,normal distribution,standard deviation,hypothesis,confidence interval,sample",
    "数列级数": "sequence,series,converge,sum of,fibonacci,recurrence,arithmetic progression,geometric progression,nth term,telescoping,partial sum",
    "微积分": "integral,derivative,limit,calculus,differentiat,antiderivat,d/dx,dy/dx,definite integral,improper integral,partial derivative,l'hopital,taylor,maclaurin",
    "抽象代数": "group,ring,field theory,homomorphism,isomorphism,subgroup,abelian,cyclic group,normal subgroup,quotient group,kernel,coset",
    "线性代数": "matrix,determinant,eigenvalue,linear algebra,vector space,rank of,linear transformation,eigenvector,diagonaliz,inner product,orthogonal,null space",
    "组合数学": "combinat,permutation,choose,how many ways,counting,arrangement,selection,binomial coefficient,pigeonhole,inclusion-exclusion",
    "数论": "number theory,prime,divisib,modular arithmetic,gcd,lcm,congruence,remainder,euler,fermat,diophantine",
}
EXCLUDED_SHORT = {
    "物理": "force,velocity,acceleration,newton,energy,momentum,circuit,voltage,kinetic,magnetic,electric field",
    "CS/算法": "algorithm,complexity,big-o,sorting,binary search,dynamic programming,data structure",
}
SUBJECTS_SHORT = {
    "代数/函数": "equation,solve for,roots,polynomial,quadratic,factori,inequality,function,logarithm,exponential",
    "几何": "triangle,circle,angle,polygon,area of,perimeter,geometry,coordinate,volume,surface area",
    "概率统计": "probability,random variable,distribution,expectation,variance,binomial,normal distribution",
    "数列级数": "sequence,series,converge,sum of,fibonacci,recurrence",
    "微积分": "integral,derivative,limit,calculus,differentiat",
    "组合数学": "combinat,permutation,choose,how many ways,counting",
    "数论": "number theory,prime,divisib,modular arithmetic,gcd,remainder",
}
OTHER = "其他数学"
SUBJECT_SHARES = {"代数/函数": 0.25, "其他数学": 0.20, "几何": 0.12, "概率统计": 0.10, "数列级数": 0.08, "微积分": 0.07, "抽象代数": 0.06, "线性代数": 0.04, "组合数学": 0.04, "数论": 0.04}


def quoted(words: str) -> str:
    """A pattern of comma-separated words, taken literally."""
    return "|".join("".join("\\" + c if c in r".+*?()[]{}|^$\/-" else c for c in w) for w in words.split(","))


def classify(question: Column | str, subjects: dict = SUBJECTS, excluded: dict = EXCLUDED) -> Column:
    """The first class of which a keyword occurs anywhere in the first 500 characters, excluded ones first."""
    q = F.lower(F.substring(col(question), 1, 500))
    out = F.lit(OTHER)
    for name, words in reversed([*excluded.items(), *subjects.items()]):
        out = F.when(q.rlike(quoted(words)), F.lit(name)).otherwise(out)
    return out


def key_strip(question: Column | str) -> Column:
    """The first 120 characters without white space at the ends."""
    return strip(F.substring(col(question), 1, KEY_CHARS))


def key_raw(question: Column | str) -> Column:
    return F.substring(col(question), 1, KEY_CHARS)


def sample_id(question: Column | str, gt: Column | str) -> Column:
    """16 hex digits of the SHA-1 of the stripped question and reference with two bars between."""
    return F.substring(F.sha1(F.encode(F.concat(strip(question), F.lit("||"), strip(gt)), "UTF-8")), 1, 16)


def difficulty(acc: Column) -> Column:
    """all_correct, on_policy (half and above), mid_hard (above nothing), hard_zero, unknown."""
    return F.when(acc.isNull(), "unknown").when(acc >= 1.0, "all_correct").when(acc >= 0.5, "on_policy").when(acc > 0, "mid_hard").otherwise("hard_zero")


def difficulty_rescue(acc: Column, status: Column) -> Column:
    """sweet_spot, recoverable_hard (none right, but the teacher), medium_easy, low_acc, unknown, else fallback."""
    rescued = (acc == 0) & F.coalesce(status.isin("both_correct", "one_correct"), F.lit(False))
    return F.when(acc.isNull(), "unknown").when(acc.between(0.1, 0.5), "sweet_spot").when(rescued, "recoverable_hard").when((acc > 0.5) & (acc < 0.8), "medium_easy").when((acc > 0) & (acc < 0.1), "low_acc").otherwise("fallback")


def start_bucket(p0: Column) -> Column:
    """hard up to .05, sweet_mid from .10 to .60, easy from .80, exploration between or unknown."""
    return F.when(p0 <= 0.05, "hard").when(p0.between(0.10, 0.60), "sweet_mid").when(p0 >= 0.80, "easy").otherwise("exploration")


def length_tier(answer: Column) -> Column:
    n = F.length(answer)
    return F.when((n >= 200) & (n < 600), "short").when((n >= 600) & (n < 1200), "mid").when((n >= 1200) & (n < 2000), "long")


def accuracy_bin(acc: Column) -> Column:
    return F.when(acc.isNull(), "unknown").when(acc == 0, "0").when(acc < 0.25, "(0, .25)").when(acc < 0.5, "[.25, .5)").when(acc < 0.75, "[.5, .75)").otherwise("[.75, 1]")


#: Bytes of input from which losing rows are looked for instead of winning ones; losing rows that are broadcast at most.
WIDE_BYTES, BROADCAST_ROWS = 1 << 30, 1_000_000


def first_per_key(df: DataFrame, key: Column, order: str, wide_bytes: int = WIDE_BYTES) -> DataFrame:
    """Of each key the row with the least ``order``, which must be unique; null keys are one key.

    Only keys and orders are aggregated, and combined before the shuffle, so a key that most rows share makes no
    large task. Small tables are then joined to the winners. Of tables beyond ``wide_bytes`` the losers are found
    (of keys that come more than once) and taken away, broadcast if they are few: the rows themselves stay where
    they are. Both ways give the same rows.
    """
    slim = df.select(key.alias("_key"), F.col(order).alias("_at"))
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= wide_bytes:
        winners = slim.groupBy("_key").agg(F.min("_at").alias(order)).select(order)
        return df.join(winners, order, "left_semi")
    many = slim.groupBy("_key").agg(F.min("_at").alias("_least"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_k"), "_least")
    later = written(slim.join(many, F.col("_key").eqNullSafe(F.col("_k"))).where("_at > _least").select(F.col("_at").alias(order)), "later")
    return df.join(F.broadcast(later) if later.count() <= BROADCAST_ROWS else later, order, "left_anti")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the greatest order, by an aggregate that combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(order)).alias("_row")).select(key, "_row.*")


def cascade(*steps: tuple[str, Column]) -> Column:
    """The reason of the first step whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for reason, bad in reversed(steps):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def with_first(df: DataFrame) -> DataFrame:
    """``df`` (row_idx, qkey, early) with _first true for the first row of each key among those without an early reason."""
    winners = df.where("early is null").groupBy("qkey").agg(F.min("row_idx").alias("row_idx")).select("row_idx", F.lit(True).alias("_first"))
    return df.join(winners, "row_idx", "left")


def rejected_for_pairs(questions: DataFrame, accuracy: DataFrame | None = None) -> DataFrame:
    """Questions (row_idx, question, answer, ground_truth, category) with key and reject reason of the pair cascade.

    Steps in order: reference missing or no number, answer outside 200 to 2000 and question outside 50 to 1500
    characters, repeated key among what is left, all right, excluded subject. ``accuracy`` (qkey, acc) is
    joined by stripped key. Kept rows have a null reason.
    """
    df = questions.withColumn("qkey", key_strip("question")).withColumn("subject", F.coalesce(F.nullif(F.col("category"), F.lit("")), classify("question")))
    if accuracy is not None:
        df = df.join(accuracy.select("qkey", "acc"), "qkey", "left")
    elif "acc" not in df.columns:
        df = df.withColumn("acc", F.lit(None).cast("double"))
    a, q = F.length("answer"), F.length("question")
    df = df.withColumn("early", cascade(("no_reference", F.col("ground_truth").isNull()), ("reference_no_number", ~valid_reference("ground_truth")), ("answer_short", a < 200), ("answer_long", a > 2000), ("question_short", q < 50), ("question_long", q > 1500)))
    df = with_first(df)
    late = cascade(("duplicate", F.col("_first").isNull()), ("all_correct", F.col("acc") >= 1.0), ("excluded_subject", F.col("subject").isin(*EXCLUDED)))
    return df.withColumn("reason", F.coalesce("early", late)).drop("early", "_first")


def rejected_for_training(questions: DataFrame) -> DataFrame:
    """The same for reinforcement: answers of at least 100 characters, subject before all right, short keyword lists."""
    df = questions.withColumn("qkey", key_strip("question")).withColumn("subject", classify("question", SUBJECTS_SHORT, EXCLUDED_SHORT))
    if "acc" not in df.columns:
        df = df.withColumn("acc", F.lit(None).cast("double"))
    q = F.length("question")
    df = df.withColumn("early", cascade(("reference_invalid", ~valid_reference("ground_truth")), ("question_short", q < 50), ("question_long", q > 1500), ("answer_short", F.coalesce(F.length("answer"), F.lit(0)) < 100)))
    df = with_first(df)
    late = cascade(("duplicate", F.col("_first").isNull()), ("excluded_subject", F.col("subject").isin(*EXCLUDED_SHORT)), ("all_correct", F.col("acc") >= 1.0))
    return df.withColumn("reason", F.coalesce("early", late)).drop("early", "_first")


def open_pool(questions: DataFrame, used: DataFrame) -> DataFrame:
    """Questions for a further round: answers of 200 to 800 characters, not used before by raw key; no deduplication."""
    df = questions.where(valid_reference("ground_truth") & F.length("answer").between(200, 800) & F.length("question").between(50, 1500)).withColumn("qkey", key_raw("question"))
    df = df.where(~classify("question", SUBJECTS_SHORT, EXCLUDED_SHORT).isin(*EXCLUDED_SHORT))
    return df.join(used.select(F.col("qkey")).distinct(), "qkey", "left_anti")


# --- quotas --------------------------------------------------------------------------------------------------


def cut_points(df: DataFrame, group: list[str], order: str, quota: Column) -> DataFrame:
    """(group, _cut): the order value at which each group's quota is reached, found by counts of order prefixes.

    ``order`` is a hex string of random digits. Twice two digits are counted per group, then what is left of a
    group, about 1 / 65536 of it, is ranked; no group is sorted whole.
    """
    rest = df.select(*group, order, quota.cast("long").alias("_left"))
    for n in (2, 4):
        counts = rest.groupBy(*group, F.substring(order, 1, n).alias("_p")).agg(F.count("*").alias("_n"), F.max("_left").alias("_q"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        edge = counts.withColumn("_b", before).where("_b < _q").groupBy(*group).agg(F.max("_p").alias("_edge"), F.max_by("_b", "_p").alias("_b"))
        rest = rest.join(edge, group).where(F.substring(order, 1, n) == F.col("_edge")).select(*group, order, (F.col("_left") - F.col("_b")).alias("_left"))
    ranked = rest.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(order))).where("_r <= _left")
    return ranked.groupBy(*group).agg(F.max(order).alias("_cut"))


def top_of_groups(df: DataFrame, group: list[str], key: str, quota: Column, seed: int | str = 0) -> DataFrame:
    """A random ``quota`` of each group by hash order of ``key``, which should be unique; ties are all kept."""
    ordered = df.withColumn("_order", hash_order(seed, key))
    cuts = cut_points(ordered, group, "_order", quota)
    return ordered.join(cuts, group).where("_order <= _cut").drop("_order", "_cut")


def case_of(values: dict, on: str, default: object = None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(on) == k, F.lit(v)).otherwise(out)
    return out


def fill_by_quota(df: DataFrame, bucket: str, key: str, shares: dict[str, float], total: int, fill_order: list[str], seed: int | str = 0) -> DataFrame:
    """Each bucket's share of ``total``, then the shortfall from the buckets in order; one row per key."""
    pool = df.dropDuplicates([key]).withColumn("_quota", case_of({b: int(total * r) for b, r in shares.items()}, bucket, 0))
    ordered = pool.withColumn("_order", hash_order(seed, key))
    cuts = cut_points(ordered.where("_quota > 0"), [bucket], "_order", F.col("_quota"))
    marked = ordered.join(F.broadcast(cuts), bucket, "left").withColumn("_main", F.coalesce(F.col("_order") <= F.col("_cut"), F.lit(False)))
    rank = case_of({b: i for i, b in enumerate(fill_order)}, bucket, len(fill_order))
    code = F.concat(F.when(F.col("_main"), "0").otherwise("1"), F.lpad(rank.cast("string"), 2, "0"), F.col("_order"))
    coded = written(marked.select(*df.columns, code.alias("_code")), "fill")  # counted several times below
    stop = prefix_cut(coded, "_code", total)
    return (coded if stop is None else coded.where(F.col("_code") <= stop)).select(*df.columns)


def prefix_cut(df: DataFrame, code: str, total: int) -> str | None:
    """The code of the ``total``-th row in order of a string code; None if there are not more rows than that."""
    prefix, left = "", total
    for n in (3, 5, 7, 9):
        counts = df.where(F.col(code).startswith(prefix)).groupBy(F.substring(code, 1, n).alias("p")).count().orderBy("p").collect()  # at most 256 prefixes each
        for r in counts:
            if left <= r["count"]:
                prefix = r.p
                break
            left -= r["count"]
        else:
            return None
    rows = df.where(F.col(code).startswith(prefix)).select(code).orderBy(code).limit(left).collect()
    return rows[-1][0] if rows else None


def balanced_by_class(df: DataFrame, cls: str, key: str, classes: list[str], seed: int | str = 0) -> DataFrame:
    """At most (rows // classes present) of each class; classes that are not listed are left out."""
    pool = df.dropDuplicates([key])
    present = pool.where(F.col(cls).isin(classes)).select(cls).distinct().count()
    quota = max(1, pool.count() // max(1, present))
    return top_of_groups(pool.where(F.col(cls).isin(classes)), [cls], key, F.lit(quota), seed)


def fill_with_cap(pool: DataFrame, total: int, shares: dict[str, float], buckets: dict[str, float], cap_share: float = 0.05, strict_cap: bool = False, seed: int | str = 0) -> DataFrame:
    """Class by bucket quotas under one cap on big numbers, for a pool (qkey, subject, bucket, is_big).

    Classes are filled in order: each bucket to its share, then the class from its buckets in order, then the
    total from the largest classes. Big numbers beyond the cap are passed over; refills check the cap but count
    only if ``strict_cap``. Each step takes a random top of its groups, so it is a few passes over the slim pool.
    """
    names = ["qkey", "subject", "bucket", "is_big"]
    pool = pool.select(*names).dropDuplicates(["qkey"]).withColumn("_order", hash_order(seed, "qkey"))
    pool = written(pool, "pool")
    sizes = {(r.subject, r.bucket, r.is_big): r["count"] for r in pool.groupBy("subject", "bucket", "is_big").count().collect()}  # classes x buckets x 2 rows
    left, room = dict(sizes), int(total * cap_share)
    take: dict[tuple, int] = dict.fromkeys(sizes, 0)

    def grab(subject: str, bucket: str, want: int, counting: bool) -> int:
        """Takes big and other numbers in proportion to what is left, big ones within the cap."""
        nonlocal room
        small, big = left.get((subject, bucket, False), 0), left.get((subject, bucket, True), 0)
        n = min(want, small + big)
        b = min(big, max(n - small, round(n * big / (small + big))) if small + big else 0, max(0, room))
        s = min(small, n - b)
        for kind, k in ((False, s), (True, b)):
            if k:
                take[subject, bucket, kind] += k
                left[subject, bucket, kind] -= k
        if counting or strict_cap:
            room -= b
        return s + b

    chosen = 0
    for subject, share in shares.items():
        target, got = int(total * share), 0
        for bucket, r in buckets.items():
            got += grab(subject, bucket, min(max(1, int(target * r)), target - got), True)
        for bucket in buckets:
            got += grab(subject, bucket, target - got, False)
        chosen += got
    by_size = sorted({s for s, _, _ in sizes}, key=lambda s: (-sum(v for k, v in sizes.items() if k[0] == s), s))
    for subject in by_size:
        for bucket in sorted({b for s, b, _ in sizes if s == subject}, key=lambda b: (list(buckets).index(b) if b in buckets else 99, b)):
            chosen += grab(subject, bucket, total - chosen, False)
    quota = pool.sparkSession.createDataFrame([(*k, v) for k, v in take.items()] or [("", "", False, 0)], "subject string, bucket string, is_big boolean, _quota bigint")
    keyed = pool.join(F.broadcast(quota), ["subject", "bucket", "is_big"]).where("_quota > 0")
    cuts = cut_points(keyed, ["subject", "bucket", "is_big"], "_order", F.col("_quota"))
    return keyed.join(cuts, ["subject", "bucket", "is_big"]).where("_order <= _cut").select(*names)


def shuffled(df: DataFrame, key: str, seed: int | str = 0) -> DataFrame:
    """All rows in the hash order of a key: a range shuffle, not one task."""
    return df.withColumn("_o", hash_order(seed, key)).orderBy("_o").drop("_o")


def shuffled_positions(df: DataFrame, key: str, seed: int | str = 0) -> DataFrame:
    """``df`` with position, from 0, of each row in the hash order of a key."""
    return numbered(df.withColumn("_o", hash_order(seed, key)), "_o").withColumnRenamed("_n", "position").drop("_o")


def split_tail(df: DataFrame, key: str, test_rows: int, seed: int | str = 0) -> DataFrame:
    """``df`` with split 'test' for the last ``test_rows`` in hash order of ``key``, else 'train'."""
    coded = df.withColumn("_code", hash_order(seed, key))
    stop = prefix_cut(coded.withColumn("_code", F.concat(F.lit("000"), F.col("_code"))), "_code", max(0, df.count() - test_rows)) if test_rows else None
    if test_rows and stop is None:
        split = F.lit("test") if df.count() <= test_rows else F.lit("train")
    else:
        split = F.when(F.concat(F.lit("000"), F.col("_code")) <= F.lit(stop or "~"), "train").otherwise("test")
    return coded.withColumn("split", split).drop("_code")


def split_ratio(df: DataFrame, key: str, ratio: float = 0.8, seed: int | str = 0, names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """``df`` with split: the first ``int(rows * ratio)`` in hash order of ``key``, and the rest."""
    total = df.count()
    head, tail = names
    return split_tail(df, key, total - int(total * ratio), seed).withColumn("split", F.when(F.col("split") == "train", head).otherwise(tail))


def shards(df: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """``df`` with contiguous shard numbers 0..n-1; the first shards take one more row if it does not come out even."""
    total = df.count()
    base, more = divmod(total, n)
    ranked = numbered(df, order)
    at = F.col("_n")
    return ranked.withColumn("shard", F.when(at < more * (base + 1), F.floor(at / (base + 1))).otherwise(more + F.floor((at - more * (base + 1)) / max(base, 1))).cast("int")).drop("_n")


def batches(df: DataFrame, size: int, order: str = "row_idx") -> DataFrame:
    """``df`` with batch, from 0: contiguous batches of ``size`` rows in the order of a column; the last may be smaller."""
    return numbered(df, order).withColumn("batch", F.expr(f"_n div {int(size)}")).drop("_n")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with _n, the position from 0 in the order of a column, without sorting all rows in one task.

    Rows are range-partitioned, sorted and written once, each with its partition and its place there. The sizes
    are counted from what was written, so they fit its places whatever partitions the engine chose; one number
    for each partition shifts the places. Rows of equal order get some order among themselves.
    """
    mono = F.monotonically_increasing_id()
    placed = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_mono", mono)
    placed = written(placed.withColumn("_part", F.shiftrightunsigned(F.col("_mono"), 33).cast("int")), "numbered")
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("_part").count().collect())  # one number for each partition
    shifts, at = [], 0
    for p, n in sizes:
        shifts.append((p, at))
        at += n
    shift = df.sparkSession.createDataFrame(shifts or [(0, 0)], "_part int, _shift bigint")
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    known = F.coalesce("_shift", F.raise_error(F.lit("a partition was not counted")))
    return placed.join(F.broadcast(shift), "_part", "left").withColumn("_n", local + known).select(*df.columns, "_n")
