"""Information-theoretic string functions as Column expressions (higher-order functions, no Python).

Characters are counted over ``array_distinct`` in sorted order, so sums run in one order everywhere; results that are
compared between engines are rounded half up to 9 places by ``r9``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character class fractions (upper, lower, digit, symbol) of code, secrets and English; fixed values.
CODE = (0.05, 0.75, 0.10, 0.10)
SECRET = (0.25, 0.25, 0.25, 0.25)
ENGLISH = (0.02, 0.82, 0.03, 0.13)


def r9(col: Column) -> Column:
    return F.floor(col * 1e9 + 0.5) / 1e9


def chars(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


def let(col: Column, body) -> Column:
    """``body(col)`` with ``col`` evaluated once."""
    return F.element_at(F.transform(F.array(col), body), 1)


def over_counts(items: Column, term) -> Column:
    """Sum of ``term(count)`` over the distinct items in sorted order: one sort and one pass."""
    zero = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0.0).alias("run"), F.lit(0.0).alias("acc"))
    close = lambda a: F.when(a["run"] > 0, a["acc"] + term(a["run"])).otherwise(a["acc"])
    step = lambda a, x: F.when(a["prev"].eqNullSafe(x), F.struct(x.alias("prev"), (a["run"] + 1).alias("run"), a["acc"].alias("acc"))).otherwise(
        F.struct(x.alias("prev"), F.lit(1.0).alias("run"), close(a).alias("acc"))
    )
    return F.aggregate(F.array_sort(items), zero, step, close)


def _bits(items: Column, total: Column) -> Column:
    return let(total, lambda n: over_counts(items, lambda run: -run / n * F.log2(run / n)))


def entropy(v: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 up to length 1."""
    return F.when(F.length(v) <= 1, 0.0).otherwise(_bits(chars(v), F.length(v).cast("double")))


def class_share(v: Column, chars_class: str) -> Column:
    """Share of the characters in a class such as ``A-Z``."""
    return F.length(F.regexp_replace(v, f"[^{chars_class}]", "")) / F.length(v).cast("double")


def profile(v: Column) -> tuple[Column, Column, Column, Column]:
    """Upper, lower, digit and symbol shares; what is not ASCII alphanumeric is a symbol."""
    return class_share(v, "A-Z"), class_share(v, "a-z"), class_share(v, "0-9"), F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")) / F.length(v).cast("double")


def distance(p: tuple[Column, ...], q: tuple[float, ...]) -> Column:
    total = (p[0] - q[0]) * (p[0] - q[0])
    for a, b in zip(p[1:], q[1:]):
        total = total + (a - b) * (a - b)
    return F.sqrt(total)


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def char_signal(v: Column) -> Column:
    """Nearness to the secret profile against the code profile."""
    p = profile(v)
    both = F.struct(distance(p, CODE).alias("c"), distance(p, SECRET).alias("s"))
    return F.when(F.length(v) <= 1, 0.5).otherwise(let(both, lambda d: F.when(d["c"] + d["s"] == 0, 0.5).otherwise(clamp01(d["c"] / (d["c"] + d["s"])))))


def bigrams(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(v) - 1), lambda i: F.substring(v, i, F.lit(2)))


def bigram_entropy(v: Column) -> Column:
    return _bits(bigrams(v), (F.length(v) - 1).cast("double"))


def bigram_signal_of(ratio: Column) -> Column:
    """Signal of a bigram to character entropy ratio."""
    return let(
        F.when(ratio > 1, F.greatest(F.lit(0.0), 2 - ratio)).otherwise(ratio),
        lambda r: clamp01(F.when(r <= 0.85, r / 0.85 * 0.3).when(r >= 0.95, 0.7 + (r - 0.95) / 0.05 * 0.3).otherwise(0.3 + (r - 0.85) / 0.1 * 0.4)),
    )


def bigram_signal(v: Column) -> Column:
    ratio = lambda h: let(bigram_entropy(v) / h, bigram_signal_of)
    return F.when(F.length(v) < 4, 0.5).otherwise(let(entropy(v), lambda h: F.when(h == 0, 0.5).otherwise(ratio(h))))


def compression_signal_of(ratio: Column, n: Column) -> Column:
    """Signal of a compressed to raw length ratio (capped at 1.5) of a value of length ``n``; none up to 50 characters."""
    r = F.least(ratio, F.lit(1.5))
    s = (
        F.when(r <= 0.3, 0.1)
        .when(r <= 0.5, 0.1 + (r - 0.3) / 0.2 * 0.2)
        .when(r <= 0.8, 0.3 + (r - 0.5) / 0.3 * 0.4)
        .when(r <= 1.0, 0.7 + (r - 0.8) / 0.2 * 0.2)
        .otherwise(0.9 + (r - 1.0) / 0.5 * 0.1)
    )
    return F.when(n > 50, F.when(n <= 80, F.least(s, F.lit(0.5))).otherwise(s))


def coincidence(v: Column) -> Column:
    """Index of coincidence; 1 below length 2."""
    n = F.length(v).cast("double")
    return F.when(F.length(v) < 2, 1.0).otherwise(over_counts(chars(v), lambda f: f * (f - 1)) / F.nullif(n * (n - 1), F.lit(0.0)))


def _classes(v: Column, *sets: tuple[str, str]) -> Column:
    out = v
    for pattern, to in sets:
        out = F.regexp_replace(out, pattern, to)
    return out


def _changes(mapped: Column) -> Column:
    """Neighbouring characters that differ: what is left of the string when runs are squeezed, less one."""
    return F.length(F.regexp_replace(mapped, r"(.)\1+", "$1")) - 1


def friction(v: Column) -> Column:
    """Share of neighbouring characters of different class among letters, digits, symbols; 0 below length 2."""
    mapped = _classes(v, ("[A-Za-z]", "L"), ("[0-9]", "D"), ("[^LD]", "S"))
    return F.when(F.length(v) < 2, 0.0).otherwise(_changes(mapped) / F.nullif((F.length(v) - 1).cast("double"), F.lit(0.0)))


def transitions(v: Column) -> Column:
    """Changes among upper, lower, digits, symbols."""
    mapped = _classes(v, ("[a-z]", "l"), ("[0-9]", "0"), ("[A-Z]", "U"), ("[^l0U]", "S"))
    return F.when(F.length(v) < 2, 0).otherwise(_changes(mapped))


def gradient(v: Column) -> Column:
    """Entropies of the three thirds; zeros below length 9."""
    third = F.floor(F.length(v) / 3).cast("int")
    cut = lambda i, n: entropy(F.substring(v, i, n))
    return F.when(F.length(v) < 9, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(cut(F.lit(1), third), cut(third + 1, third), cut(third * 2 + 1, F.length(v))))


def spikes(g: Column) -> Column:
    return g[2] > g[0] + 0.5


def uniform(v: Column) -> Column:
    """Over 16 characters whose counts hardly differ."""
    n = F.length(v).cast("double")
    spread = lambda k: over_counts(chars(v), lambda f: ((f - n / k) / n) * ((f - n / k) / n)) / k
    return F.when(F.length(v) <= 16, False).otherwise(let(F.size(F.array_distinct(chars(v))).cast("double"), lambda k: F.sqrt(spread(k)) < 0.03))


def djb2(v: Column) -> Column:
    """The 33-multiplier hash, modulo 2^32."""
    return F.aggregate(chars(v), F.lit(5381).cast("bigint"), lambda h, c: F.pmod(h * 33 + F.ascii(c), F.lit(4294967296)))


def aggregate_score(char: Column, bigram: Column, compressed: Column | None = None) -> tuple[Column, Column]:
    """``(score 0-100, ambiguous)`` of the signals: weights 1, 1 and 1.2 where there is a compression signal."""
    agree = lambda test: test(char) & test(bigram) & (F.coalesce(test(compressed), F.lit(True)) if compressed is not None else F.lit(True))
    if compressed is None:
        mean = (char + bigram) / 2.0
    else:
        mean = F.when(compressed.isNull(), (char + bigram) / 2.0).otherwise((char + bigram + compressed * 1.2) / 3.2)
    decided = agree(lambda x: x < 0.4) | agree(lambda x: x > 0.6)
    return F.floor(mean * 100 + 0.5), ~decided


def vector(v: Column, packed: Column | None = None) -> Column:
    """Six dimensions; ``packed`` is the compressed length ratio used from length 80 on."""
    n = F.length(v).cast("double")
    kinds = F.size(F.array_distinct(chars(v))).cast("double")
    p = profile(v)
    d1 = let(kinds, lambda k: F.when(k <= 1, 0.0).otherwise(F.least(F.lit(1.0), entropy(v) / F.nullif(F.log2(k), F.lit(0.0)))))
    d2 = F.when(n < 80, kinds / n).otherwise(F.least(F.lit(1.0), F.least(packed if packed is not None else kinds / n, F.lit(1.5)) / 1.5))
    half = lambda q: F.least(F.lit(1.0), distance(p, q) / 2.0)
    return F.array(d1, d2, half(ENGLISH), half(CODE), 1 - half(SECRET), F.when(n < 2, 0.0).otherwise(transitions(v) / F.nullif(n - 1, F.lit(0.0))))


SECRET_SCORE = 0.5


def vector_score(v: Column, packed: Column | None = None) -> Column:
    """``struct(score, is_secret)``: the mean of the six dimensions to three places; empty values score 0."""
    mean = F.floor(F.aggregate(vector(v, packed), F.lit(0.0), lambda a, d: a + d) / 6 * 1000 + 0.5) / 1000
    score = F.when(F.coalesce(F.length(v), F.lit(0)) == 0, 0.0).otherwise(mean)
    return F.struct(score.alias("score"), (score >= SECRET_SCORE).alias("is_secret"))


def shape(v: Column) -> Column:
    return (
        F.when(v == "", "mixed")
        .when(v.startswith("eyJ"), "jwt")
        .when(v.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-"), "uuid")
        .when(v.rlike(r"(?i)^[0-9a-f]+\z"), "hex-shaped")
        .when(v.rlike(r"^[A-Za-z0-9+/]+=*\z") & (F.length(v) > 8), "base64-shaped")
        .otherwise("mixed")
    )


def mask(v: Column) -> Column:
    return F.when(v.isNull() | (F.length(v) <= 8), "********").otherwise(
        F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), F.greatest(F.length(v) - 6, F.lit(4))), F.right(v, F.lit(2)))
    )
