"""Functions of numeric arrays, as expressions that stay in the JVM.

Vectors are ``array<double>`` columns (or anything castable). Where the original
analyses have a known slip, ``compat=True`` reproduces it and the default is clean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(v: Column | str) -> Column:
    return F.aggregate(vec(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(vec(a), vec(b), lambda x, y: x * y))


def length(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column | str, by: Column) -> Column:
    """``v / by``, or ``v`` as it is where ``by`` is 0."""
    return F.when(by == 0, vec(v)).otherwise(F.transform(vec(v), lambda x: x / by))


def to_pdf(v: Column | str) -> Column:
    return scaled(v, total(v))


def to_unit(v: Column | str) -> Column:
    return scaled(v, length(v))


def to_max_one(v: Column | str) -> Column:
    return scaled(v, F.greatest(F.lit(0.0), F.array_max(vec(v))))


def gini(p: Column | str) -> Column:
    """1 - sum of squares of a distribution."""
    return F.lit(1.0) - dot(p, p)


def gini_of_counts(counts: Column | str) -> Column:
    return gini(to_pdf(counts))


def squared_l2(a: Column | str, b: Column | str, compat: bool = False) -> Column:
    """Sum of squared differences; ``compat`` adds one for each dimension."""
    d = F.aggregate(F.zip_with(vec(a), vec(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return d + F.size(vec(a)) if compat else d


def l1(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(vec(a), vec(b), lambda x, y: F.abs(x - y)))


def hellinger(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences of roots: neither halved nor rooted."""
    return total(F.zip_with(vec(a), vec(b), lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0))))


def kullback_leibler(a: Column | str, b: Column | str) -> Column:
    """Sum of x ln(x / y). A zero makes it NaN, as 0 ln 0 isn't taken as 0."""
    term = lambda x, y: F.when((x <= 0) | (y <= 0), F.lit(float("nan"))).otherwise(x * F.ln(x / y))
    return total(F.zip_with(vec(a), vec(b), term))


METRICS = {"L1": l1, "L2": squared_l2, "HELLINGER": hellinger, "KULLBACK_LIEBLER": kullback_leibler}


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    """A distance by its name, in any case."""
    if metric.upper() not in METRICS:
        raise ValueError(f"no metric {metric!r}; known: {', '.join(METRICS)}")
    return METRICS[metric.upper()](a, b)


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once for a row and not at each of its uses inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _steps(v: Column) -> Column:
    """Steps from the first place to the last; 1 for a single place, which is place 0."""
    return F.greatest(F.size(v) - 1, F.lit(1))


def relative_mean(f: Column | str) -> Column:
    """Mean place in [0, 1] of a distribution over positions; a single position is place 0."""
    v = vec(f)
    return total(F.transform(v, lambda x, i: x * i / _steps(v)))


def relative_central_moment(f: Column | str, k: int) -> Column:
    """The k-th moment of place about its mean, not standardised; 0 for a single position."""
    v = vec(f)
    return bound(relative_mean(f), lambda mean: total(F.transform(v, lambda x, i: F.pow(i / _steps(v) - mean, F.lit(float(k))) * x)))


def argmax(v: Column | str) -> Column:
    """First position (from 0) of the largest element; 0 for an empty array."""
    return F.coalesce(F.array_position(vec(v), F.array_max(vec(v))) - 1, F.lit(0)).cast("int")


def argmin(v: Column | str) -> Column:
    return F.coalesce(F.array_position(vec(v), F.array_min(vec(v))) - 1, F.lit(0)).cast("int")


def index_of(v: Column | str, x) -> Column:
    """First position (from 0) of ``x``, or -1."""
    return (F.array_position(vec(v), x) - 1).cast("int")


def multi_hot(labels: Column | str, n: int) -> Column:
    """A label set as an array of ``n`` zeros and ones."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.array_contains(vec(labels), j).cast("int"))


def labels_of(hot: Column | str) -> Column:
    """The label set of an array of zeros and ones."""
    return F.filter(F.transform(vec(hot), lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def added(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x + y)


def subtracted(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x - y)


def projected(a: Column | str, onto: Column | str) -> Column:
    """The part of ``a`` along ``onto``; a zero vector where ``onto`` is one."""
    n = dot(onto, onto)
    return F.transform(vec(onto), lambda x: F.when(n == 0, 0.0).otherwise(x * dot(a, onto) / n))


def filled(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def mean(v: Column | str) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(v), F.size(vec(v)))


def sample_variance(v: Column | str) -> Column:
    """Null for fewer than two elements."""
    return bound(mean(v), lambda m: F.try_divide(total(F.transform(vec(v), lambda x: (x - m) * (x - m))), F.size(vec(v)) - 1))


def joined(v: Column | str, sep: str = ",") -> Column:
    return F.array_join(F.transform(vec(v), lambda x: x.cast("string")), sep)


# -- small matrices as arrays of rows


def mat_vec(m: Column | str, v: Column | str) -> Column:
    return F.transform(vec(m), lambda row: dot(row, v))


def transpose(m: Column | str) -> Column:
    m = vec(m)
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def mat_mul(a: Column | str, b: Column | str) -> Column:
    t = transpose(b)
    return F.transform(vec(a), lambda row: F.transform(t, lambda col: dot(row, col)))


def trace(m: Column | str) -> Column:
    return total(F.transform(vec(m), lambda row, i: F.get(row, i)))


def determinant(m: Column | str) -> Column:
    """Of a 2x2 or 3x3 matrix."""
    m = vec(m)
    two = m[0][0] * m[1][1] - m[0][1] * m[1][0]
    three = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    return F.when(F.size(m) == 2, two).when(F.size(m) == 3, three)


def mat_scaled(m: Column | str, by: Column, divide: bool = False, compat: bool = False) -> Column:
    """Times ``by``, or divided by it; ``compat`` multiplies in both cases."""
    return F.transform(vec(m), lambda row: F.transform(row, lambda x: x / by if divide and not compat else x * by))


def normalize_sum(m: Column | str) -> Column:
    """Entries over their sum; as they are where the sum is 0."""
    return bound(total(F.flatten(vec(m))), lambda s: F.transform(vec(m), lambda row: scaled(row, s)))


def normalize_01(m: Column | str) -> Column:
    """Entries brought linearly to [0, 1]; zeros where all are equal."""
    ends = F.struct(F.array_min(F.flatten(vec(m))).alias("low"), F.array_max(F.flatten(vec(m))).alias("high"))
    return bound(ends, lambda e: F.transform(vec(m), lambda row: F.transform(row, lambda x: F.when(e["high"] > e["low"], (x - e["low"]) / (e["high"] - e["low"])).otherwise(0.0))))


def zeros(rows: int, columns: int) -> Column:
    return F.array_repeat(filled(0.0, columns), rows)


def identity(n: int) -> Column:
    return F.array(*(F.array(*(F.lit(float(i == j)) for j in range(n))) for i in range(n)))


def swap_rows(m: Column | str, i: int, j: int) -> Column:
    """Rows ``i`` and ``j`` (from 0) in each other's place."""
    return F.transform(vec(m), lambda row, k: F.when(k == i, F.get(vec(m), F.lit(j))).when(k == j, F.get(vec(m), F.lit(i))).otherwise(row))


def inverse(m: Column | str) -> Column:
    """Of a 2x2 or 3x3 matrix, by its adjugate; null for a singular one and for other sizes."""
    m = vec(m)
    at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    minor = lambda i, j: at((i + 1) % 3, (j + 1) % 3) * at((i + 2) % 3, (j + 2) % 3) - at((i + 1) % 3, (j + 2) % 3) * at((i + 2) % 3, (j + 1) % 3)
    two = F.array(F.array(at(1, 1), -at(0, 1)), F.array(-at(1, 0), at(0, 0)))
    three = F.array(*(F.array(*(minor(j, i) for j in range(3))) for i in range(3)))
    over = lambda a: bound(determinant(m), lambda d: F.when(d != 0, F.transform(a, lambda row: F.transform(row, lambda x: x / d))))
    return F.when(F.size(m) == 2, over(two)).when(F.size(m) == 3, over(three))


# -- random draws: they follow from a key and a seed, so that a lost task draws the same again


def uniform_of(*key: Column | str, seed: int = 0) -> Column:
    """In (0, 1), from a hash of the key."""
    return (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))


def gaussian_of(*key: Column | str, mean: float = 0.0, deviation: float = 1.0, seed: int = 0) -> Column:
    """A normal draw, by the polar form of two uniform ones."""
    u, v = uniform_of(*key, seed=2 * seed), uniform_of(*key, seed=2 * seed + 1)
    return F.lit(mean) + F.lit(deviation) * F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v)


def multinomial_of(weights: Column | str, *key: Column | str, seed: int = 0) -> Column:
    """A position (from 0) drawn with a chance that follows its weight; null where no weight is above 0."""
    w = F.transform(vec(weights), lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    sums = F.aggregate(w, F.array().cast("array<double>"), lambda a, x: F.array_append(a, x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0))))
    place = bound(sums, lambda s: F.size(F.filter(s, lambda x: x <= F.element_at(s, -1) * uniform_of(*key, seed=seed))))
    return F.when(total(w) > 0, F.least(place, F.size(w) - 1))


# -- complex numbers as struct<re, im>


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def complex_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_div(a: Column, b: Column) -> Column:
    n = complex_magnitude_squared(b)
    return complex_of((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n)


def complex_magnitude_squared(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def complex_magnitude(a: Column) -> Column:
    return F.sqrt(complex_magnitude_squared(a))


def complex_phase(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def complex_normalized(a: Column) -> Column:
    n = complex_magnitude(a)
    return complex_of(a["re"] / n, a["im"] / n)
