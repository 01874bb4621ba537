"""Scalar functions on columns."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = statistics.NormalDist()

# Coefficients, highest power first, of Cody's rational Chebyshev approximations of erf and erfc (1969).
_ERF = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC_MID = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_ERFC_TAIL = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
# Coefficients, highest power first, of Wichura's algorithm AS 241 for the normal quantile (1988).
_QUANTILE_MID = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_QUANTILE_NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
_QUANTILE_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _ratio(coefficients: tuple, x: Column) -> Column:
    """One polynomial over the other."""
    parts = []
    for row in coefficients:
        value = F.lit(row[0])
        for c in row[1:]:
            value = value * x + c
        parts.append(value)
    return parts[0] / parts[1]


def _bound(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it; a long x would be copied into every place otherwise."""
    return F.get(F.transform(F.array(x.cast("double")), f), F.lit(0))


def erfc(x: Column) -> Column:
    """The complementary error function on the JVM, right to some 15 digits, far tails included; null for null."""
    return _bound(x, _erfc)


def _erfc(x: Column) -> Column:
    a = F.abs(x)
    # exp(-a^2) from a cut at sixteenths, as rounding a^2 alone would lose digits of large a
    cut = F.floor(a * 16) / 16
    gauss = F.exp(-cut * cut) * F.exp(-(a - cut) * (a + cut))
    inverse = 1 / (a * a)
    tail = gauss / a * (1 / math.sqrt(math.pi) - inverse * _ratio(_ERFC_TAIL, inverse))
    positive = F.when(a <= 0.46875, 1 - a * _ratio(_ERF, a * a)).when(a <= 4, gauss * _ratio(_ERFC_MID, a)).when(a < 27, tail).when(a.isNotNull(), 0.0)
    return F.when(x < 0, 2 - positive).otherwise(positive)


def _quantile_beyond_half(q: Column) -> Column:
    """The normal quantile at 1/2 + q."""
    small = 0.5 - F.abs(q)
    r = F.sqrt(-F.log(small))
    outer = F.when(r <= 5, _ratio(_QUANTILE_NEAR, r - 1.6)).otherwise(_ratio(_QUANTILE_FAR, r - 5))
    return F.when(F.abs(q) <= 0.425, q * _ratio(_QUANTILE_MID, 0.180625 - q * q)).when(F.abs(q) < 0.5, F.signum(q) * outer)


def tokens(text: Column, separators: str = r" \t,") -> Column:
    """Parts between runs of separators, none of them empty."""
    return F.array_remove(F.split(text, f"[{separators}]+"), "")


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def file_suffix(path: Column) -> Column:
    """What follows the last dot of the file name."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def is_missing(text: Column) -> Column:
    """Null or NA in any case."""
    return text.isNull() | (F.upper(text) == "NA")


def chromosome(text: Column) -> Column:
    """Chromosome code: X is 23, Y is 24, missing and 0 are null."""
    up = F.upper(F.trim(text))
    code = F.when(up == "X", 23).when(up == "Y", 24).otherwise(up.try_cast("int"))
    return F.when(code != 0, code)


def chromosome_of_id(variant: Column) -> Column:
    """I4: the part of chrom:pos:... before the first colon."""
    return F.split_part(variant, F.lit(":"), F.lit(1)).try_cast("int")


def person_id(fid: Column, iid: Column) -> Column:
    """Fid:iid."""
    return F.concat_ws(":", fid, iid)


def of_chromosome_file(path: Column, chrom: Column) -> Column:
    """Whether the file name holds _chr<chrom>_."""
    return F.contains(path, F.concat(F.lit("_chr"), chrom.cast("string"), F.lit("_")))


def number_text(x: Column, fixed: int = 15, scientific: int = 5, switch: float = 1e-6) -> Column:
    """Fixed notation, or scientific below the switch; NA for null."""
    small = F.format_string(f"%.{scientific}e", x)
    return F.when(x.isNull(), "NA").when(F.abs(x) < switch, small).otherwise(F.format_string(f"%.{fixed}f", x))


def elapsed_text(seconds: float) -> str:
    """I8: h:m:s."""
    whole = int(seconds)
    return f"{whole // 3600}:{whole % 3600 // 60}:{whole % 60}"


def positive_integer(text: Column) -> Column:
    """Digits without a leading zero, unless there is but one."""
    return text.rlike("^([0-9]|[1-9][0-9]+)$")


def is_number(text: Column) -> Column:
    """Digits only."""
    return text.rlike("^[0-9]+$")


def chi2_tail(x: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom, so that it does not run out at 1e-16; null below 0."""
    return F.when(x >= 0, erfc(F.sqrt(x / 2)))


def chi2_cut(p: float) -> float:
    """The chi-squared value (one degree of freedom) whose upper tail is p; infinite at 0."""
    if p <= 0:
        return math.inf
    if p >= 1:
        return 0.0
    low, high = 0.0, 1500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return (low + high) / 2


def chi2_quantile(p: float) -> float:
    """Lower-tail quantile, one degree of freedom."""
    return _NORMAL.inv_cdf((1 + p) / 2) ** 2 if 0 < p < 1 else (0.0 if p <= 0 else math.inf)


def se_from_p(beta: Column, p: Column) -> Column:
    """|beta| over the square root of the chi-squared quantile at p (lower tail); 1e10 where p is 1, null where p is
    null, 0 or outside [0, 1], as no finite error belongs to these."""
    ratio = _bound(p, lambda v: F.when((v > 0) & (v < 1), _quantile_beyond_half(v / 2)))
    return F.when(p == 1, 1e10).otherwise(F.abs(beta) / ratio)


def p_from_z(z: Column) -> Column:
    """Two-sided p-value."""
    return erfc(F.abs(z) / math.sqrt(2))


def normal_cdf(x: Column) -> Column:
    """I13."""
    return 0.5 * erfc(-x / math.sqrt(2))


def normal_quantile(p: Column) -> Column:
    """I13; null outside (0, 1)."""
    return _bound(p, _normal_quantile)


def _normal_quantile(p: Column) -> Column:
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(r <= 5, _ratio(_QUANTILE_NEAR, r - 1.6)).otherwise(_ratio(_QUANTILE_FAR, r - 5))
    q = p - 0.5
    return F.when((p <= 0) | (p >= 1), None).when(F.abs(q) <= 0.425, q * _ratio(_QUANTILE_MID, 0.180625 - q * q)).otherwise(F.signum(q) * outer)


def heterozygosity(af: Column) -> Column:
    """2p(1-p)."""
    return 2 * af * (1 - af)


def minor_frequency(af: Column) -> Column:
    """min(p, 1-p)."""
    return F.least(af, 1 - af)


def z_score(beta: Column, se: Column, least: float = 1e-6) -> Column:
    """Beta / se, null where |se| is not above `least`."""
    return F.when(F.abs(se) > least, beta / se)


def p_from_log10(value: Column, negative: bool = True) -> Column:
    """P from a log10 column, by default -log10 p."""
    return F.pow(F.lit(10.0), -value if negative else value)


def scaled_effects(b: Column, se: Column, n: Column) -> dict[str, Column]:
    """I16: effects per standardised genotype, total sum of squares and Z'y."""
    spread = n * se * se + b * b
    scale = 1 / F.sqrt(spread)
    return {"b_scaled": b * scale, "se_scaled": se * scale, "tss": n * spread, "zy": n * b}


def named_value(names: Column, values: Column, key: str) -> Column:
    """The value that stands under key."""
    return F.try_element_at(F.map_from_arrays(names, values), F.lit(key))


def largest(cutoffs: list[float]) -> float:
    """The one of a list of cutoffs that holds."""
    if not cutoffs:
        raise ValueError("no cutoff is given")
    return max(cutoffs)
