"""Token sequences and per-token distributions as array expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.pytext import let, uniform


def padded(prompt: Column, response: Column, length: int, pad: int, mask: Column | None = None) -> Column:
    """(input_ids, attention_mask, position_ids, loss_mask) of a fixed length; null for an empty response.

    The response is cut to length - 1, the prompt keeps its end. ``mask`` marks the response's trained tokens.
    """
    r = F.slice(response, F.lit(1), F.least(F.size(response), F.lit(length - 1)))
    room = F.lit(length) - F.size(r)
    p = F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), room)
    ids = F.concat(p, r)
    n = F.size(ids)
    trained = F.slice(F.transform(mask, lambda x: x.cast("float")), F.lit(1), F.size(r)) if mask is not None else F.array_repeat(F.lit(1.0).cast("float"), F.size(r))
    rest = F.lit(length) - n
    positions = F.transform(F.array_repeat(F.lit(0), n), lambda _, i: i)
    zeros = F.array_repeat(F.lit(0), rest)
    out = F.struct(
        F.concat(ids, F.array_repeat(F.lit(pad), rest)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), zeros).alias("attention_mask"), F.concat(positions, zeros).alias("position_ids"),
        F.concat(F.array_repeat(F.lit(0.0).cast("float"), F.size(p)), trained, F.array_repeat(F.lit(0.0).cast("float"), rest)).alias("loss_mask"),
    )
    return F.when((F.size(response) > 0) & (n >= 2), out)


def paired_batch(df: DataFrame, length: int, pad: int, student: str = "prompt_ids", teacher: str | None = None, mask: str | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """Teacher's and student's sequences of each sample (student prompt, response_ids, attention), and the columns ``carried``.

    ``attention`` tells the response's real tokens from padding; ``mask`` those of them that the model made from a
    tool's. Without ``teacher`` both see the same sequence. A sample without prompt, without a real token, without
    a made token or too short for a sequence is left out.
    """
    real = lambda c: F.transform(F.filter(F.arrays_zip(F.col(c).alias("x"), F.col("attention").alias("a")), lambda z: z["a"] == 1), lambda z: z["x"])
    df = df.where(F.size(student) > 0).withColumn("_r", real("response_ids"))
    if mask is not None:
        df = df.withColumn("_m", real(mask)).where(F.exists("_m", lambda x: x == 1))
    made = F.col("_m") if mask is not None else None
    df = df.withColumn("_s", padded(F.col(student), F.col("_r"), length, pad, made))
    df = df.withColumn("_t", F.col("_s") if teacher is None else padded(F.col(teacher), F.col("_r"), length, pad, made)).where("_s is not null and _t is not null")
    parts = ("input_ids", "attention_mask", "position_ids", "loss_mask")
    return df.select(*(F.col(f"_{who[0]}.{x}").alias(f"{who}_{x}") for who in ("teacher", "student") for x in parts), F.lit(True).alias("valid_row_mask"), *carried)


def response_mask(given: Column, attention: Column, response_length: Column) -> Column:
    """The given mask, else the attention of the last ``response_length`` positions."""
    return F.coalesce(given, F.slice(attention, -response_length, response_length))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def log_softmax(logits: Column) -> Column:
    """Log probabilities, stable by the largest logit."""

    def normal(a: Column) -> Column:
        return let(F.array_max(a), lambda top: let(top + F.log(total(F.transform(a, lambda x: F.exp(x - top)))), lambda norm: F.transform(a, lambda x: x - norm)))

    return let(logits, normal)


def kl(p: Column, q: Column) -> Column:
    """KL(p || q) of two arrays of log probabilities."""
    return total(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)))


def reverse_kl(student: Column, teacher: Column) -> Column:
    return kl(log_softmax(student), log_softmax(teacher))


def forward_kl(student: Column, teacher: Column) -> Column:
    return kl(log_softmax(teacher), log_softmax(student))


def js_divergence(student: Column, teacher: Column) -> Column:
    both = F.struct(log_softmax(student).alias("s"), log_softmax(teacher).alias("t"))

    def divergence(x: Column) -> Column:
        m = F.zip_with(x["s"], x["t"], lambda a, b: F.log(F.greatest(0.5 * (F.exp(a) + F.exp(b)), F.lit(1e-8))))
        return let(m, lambda m: F.greatest(F.lit(0.0), 0.5 * kl(x["s"], m) + 0.5 * kl(x["t"], m)))

    return let(both, divergence)


def entropy(logits: Column) -> Column:
    return -total(F.transform(log_softmax(logits), lambda a: F.exp(a) * a))


def top_k(student: Column, teacher: Column, k: int) -> tuple[Column, Column]:
    """Both arrays at the teacher's ``k`` largest logits."""
    ranked = F.slice(F.array_sort(F.transform(F.arrays_zip(teacher.alias("t"), student.alias("s")), lambda x: F.struct((-x["t"]).alias("o"), x["t"].alias("t"), x["s"].alias("s")))), 1, k)
    return F.transform(ranked, lambda x: x["s"]), F.transform(ranked, lambda x: x["t"])


def normal_entropy(logits: Column, scale: float = 1.0) -> Column:
    return entropy(logits) / F.log(F.size(logits).cast("double")) * scale


def normal_divergence(student: Column, teacher: Column, k: int = 0, scale: float = 1.0) -> Column:
    s, t = top_k(student, teacher, k) if k else (student, teacher)
    return js_divergence(s, t) / math.log(2) * scale


def token_weight(ent: Column, div: Column, alpha: float, gamma: float = 0.0) -> Column:
    w = F.pow(F.greatest(ent, F.lit(1e-8)), alpha)
    return w * F.pow(F.greatest(div, F.lit(1e-8)), gamma) if gamma else w


def sampled(weights: Column, ratio: float, seed: int | str, *keys: Column | str) -> Column:
    """0-based places of a share of the tokens, at least one, drawn without replacement by weight, in their order.

    The largest ln(u) / w are drawn, u a hash draw of seed, keys and place. All are kept where the share is all.
    """
    n = F.size(weights)
    k = F.greatest(F.lit(1), F.floor(n * F.lit(ratio)).cast("int"))
    draw = lambda w, i: F.struct((-F.log(F.greatest(uniform(seed, *keys, i), F.lit(2.0**-49))) / F.greatest(w, F.lit(1e-300))).alias("o"), i.alias("i"))
    drawn = F.slice(F.array_sort(F.transform(weights, draw)), F.lit(1), k)
    every = F.transform(weights, lambda _, i: i)
    return F.when(k >= n, every).otherwise(F.array_sort(F.transform(drawn, lambda x: x["i"])))


def probability(logits: Column, token: Column) -> Column:
    """Probability of the token with a 0-based number."""
    return F.exp(F.get(log_softmax(logits), token))


LOSSES = {"reverse_kl": reverse_kl, "forward_kl": forward_kl, "jsd": js_divergence}
