"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def rounded(c: Column, digits: int = 6) -> Column:
    """Half up by floor, alike in every engine."""
    f = F.lit(float(10**digits))
    return F.floor(c * f + F.lit(0.5)) / f


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("int")


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def finite_or(c: Column, default: float) -> Column:
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(float(default))).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def softmax(a: Column, scale: float = 1.0) -> Column:
    """Probabilities of scaled scores, shifted by the greatest."""
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top).cast("double") * F.lit(float(scale))))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def group_probability(positive: Column, negative: Column, scale: float = 18.0) -> Column:
    """Share of the positive prompts in the softmax over all."""
    p = softmax(F.concat(positive, negative), scale)
    return F.aggregate(F.slice(p, F.lit(1), F.size(positive)), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """0 if either side is empty or null."""
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))), F.lit(0.0))


def hex_bits(h: Column) -> Column:
    return F.conv(h, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which equally long hexadecimal strings of up to 16 digits differ; null if the lengths differ."""
    return F.when(F.length(a) == F.length(b), F.bit_count(hex_bits(a).bitwiseXOR(hex_bits(b))))


def uniqueness(similarity: Column) -> Column:
    """100 for neighbours at 0.82 or less, 0 from 0.997 on."""
    return clamp((F.lit(P.UNIQUE_TOP) - similarity) / F.lit(P.UNIQUE_TOP - P.UNIQUE_BOTTOM) * 100)


def resolution_fit(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull() & height.isNotNull(), clamp((F.log2(F.least(width, height)) - 7) * 22))


def aspect_fit(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull() & height.isNotNull(), clamp(105 - (F.try_divide(F.greatest(width, height), F.least(width, height)) - 1) * 28))


def static_prior(strength: Column, quality: Column) -> Column:
    return half_up(strength * 0.7 + quality * 0.3)


def position_strength(position: Column) -> Column:
    """By place in the catalogue: the first 30, the first 300, the rest, unknown."""
    return F.when(position.isNull(), 50).when(position < 30, 90).when(position < 300, 76).otherwise(62)


def asset_label(score: Column) -> Column:
    return F.when(score >= 86, "reviewed image").when(score >= 72, "direct source preview").when(score >= 50, "source preview needing review").when(score > 0, "lower-quality source preview").otherwise("no usable preview")


def fit_label(score: Column) -> Column:
    return F.when(score >= 0.9, "exact").when(score >= 0.75, "strong").when(score >= 0.6, "plausible").otherwise("weak")


def use_tier(uses: Column) -> Column:
    out = F.when(uses.isNull(), 95)
    for least, tier in P.USE_TIERS:
        out = out.when(uses >= least, tier)
    return out.otherwise(72)


def expected_level(p: Column) -> Column:
    """Expected ordinal level of probabilities for 0..n-1, scaled to 0..1."""
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x) / (F.size(p) - 1)


def likeliest_level(p: Column) -> Column:
    """The first level of the greatest probability."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def fallback_score(index: Column) -> Column:
    return F.greatest(F.lit(0.25), F.lit(0.49) - F.lit(0.04) * index)
