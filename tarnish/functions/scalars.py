"""Numeric expressions used by cleaning, sampling and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tarnish.functions.text import col


def percent_gain(x: str | Column, base: str | Column) -> Column:
    """``100 * (x - base) / base``, null for a zero base."""
    return F.try_divide(F.lit(100.0) * (col(x) - col(base)), col(base))


def difference(x: str | Column, base: str | Column) -> Column:
    return col(x) - col(base)


def log10_scale(x: str | Column) -> Column:
    return F.log10(col(x).cast("double"))


def seeded_hash(seed: int, *parts: str | Column) -> Column:
    """md5 text that orders rows pseudo-randomly and reproducibly: ``md5('seed:part:...')``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by the Abramowitz-Stegun polynomial 26.2.17 (error < 7.5e-8)."""
    # Fixed values of the published polynomial.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * a)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + F.lit(c)) * t
    tail = F.exp(-a * a / 2) / F.sqrt(F.lit(2.0) * F.pi()) * poly
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


# The rational functions of Wichura's algorithm AS 241 (1988), constant term first,
# numerator and denominator, for the middle and for the tails.
QUANTILE_MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
QUANTILE_TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9))


def _ratio(t: Column, rational: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    def horner(terms: tuple[float, ...]) -> Column:
        out = F.lit(terms[-1])
        for c in reversed(terms[:-1]):
            out = out * t + F.lit(c)
        return out
    return horner(rational[0]) / horner(rational[1])


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution, exact to 15 digits for p from 1e-11 to 1 - 1e-11 (AS 241)."""
    q = p - 0.5
    middle = q * _ratio(F.lit(0.180625) - q * q, QUANTILE_MIDDLE)
    tail = _ratio(F.sqrt(-F.log(F.least(p, F.lit(1.0) - p))) - 1.6, QUANTILE_TAIL)
    return F.when(F.abs(q) <= 0.425, middle).otherwise(F.when(q < 0, -tail).otherwise(tail))
