"""Scalar functions (SCL*): plain column expressions, so they stay inside generated code.

NaN and null count as 0 where a share or a saturation is asked for. Rounding is half up, by floor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring formulas.
CONFIDENCE_HALF = 3.0
UNKNOWN_UTILIZATION_CONFIDENCE = 0.2
#: Fixed cut-offs of the verdicts.
HI, LO = 0.6, 0.34

CANDIDATES = ("uncollapsed-feature", "candidate-unverified")

#: Common words that carry no intent; fixed list.
STOPWORDS = (
    "the", "a", "an", "to", "of", "and", "or", "with", "by", "per", "as", "at",
    "in", "on", "for", "is", "are", "be", "this", "that", "it", "its", "from",
    "into", "one", "all", "any", "no", "not", "show", "view", "add", "new", "get",
    "set", "use", "via", "out", "up", "off", "than", "then", "so", "more", "less",
)


def either(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp01(x: Column) -> Column:
    """SCL1."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def rounded(x: Column, places: int = 3) -> Column:
    """SCL2."""
    k = float(10**places)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def saturate(value: Column, half: Column | float) -> Column:
    """SCL3: 1 - e^(-value/half) for positive arguments, else 0."""
    h = either(half)
    return F.when((value > 0) & (h > 0) & ~F.isnan(value), F.lit(1.0) - F.exp(-value / h)).otherwise(F.lit(0.0))


def geom_space(low: float | Column, high: float | Column, n: int) -> Column:
    """SCL4: n numbers evenly apart on a log scale; the geometric mean for n of 1 or less."""
    a, b = either(low), either(high)
    if n <= 1:
        return F.array(F.sqrt(a * b))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(F.ln(a) + i * ((F.ln(b) - F.ln(a)) / F.lit(float(n - 1)))))


def lin_space(low: float | Column, high: float | Column, n: int) -> Column:
    """SCL5: n numbers evenly apart; the middle for n of 1 or less."""
    a, b = either(low), either(high)
    if n <= 1:
        return F.array((a + b) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + i * ((b - a) / F.lit(float(n - 1))))


def split_identifier(x: Column) -> Column:
    """SCL6: words of an identifier in camel, snake or any other case, lower-cased."""
    apart = F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda w: w != "")


def singular(x: Column) -> Column:
    """SCL7: a trailing s goes from words of over 4 letters, unless it is one of two."""
    return F.when((F.length(x) > 4) & x.endswith("s") & ~x.endswith("ss"), F.substring(x, 1, F.length(x) - 1)).otherwise(x)


#: Identifiers of one word, as most are; they need no splitting.
ONE_WORD = "^[A-Z]?[a-z0-9]+$"


def split_parts(x: Column) -> Column:
    """The words of an identifier, null if it is one word."""
    return F.when(~x.rlike(ONE_WORD), F.transform(split_identifier(x), singular))


def identifier_parts(x: Column) -> Column:
    return F.when(x.rlike(ONE_WORD), F.array(singular(F.lower(x)))).otherwise(F.transform(split_identifier(x), singular))


def token(space: str, text: Column) -> Column:
    return F.struct(F.lit(space).alias("space"), text.alias("token"))


def word_tokens(full: Column) -> Column:
    """tokens_of() a name of one word, each once."""
    one = singular(full)
    return F.when(one == full, F.array(token("full", full), token("part", full))).otherwise(F.array(token("full", full), token("full", one), token("part", one)))


def tokens_of(full: Column, parts: Column) -> Column:
    """What can match a name with these parts, lower-cased: it and its joined parts as full, each part as part."""
    first = F.element_at(parts, 1)
    one = F.array(token("full", full), token("full", first), token("part", first))
    more = F.array_distinct(F.concat(F.array(token("full", full), token("full", F.array_join(parts, ""))), F.transform(parts, lambda p: token("part", p))))
    return F.when(F.size(parts) == 1, one).otherwise(more)


def identifier_tokens(x: Column) -> Column:
    """SCL8: the tokens of an identifier; none if it has no words."""
    parts = identifier_parts(x)
    return F.when(F.size(parts) > 0, tokens_of(F.lower(x), parts)).otherwise(F.expr("array()").cast("array<struct<space:string,token:string>>"))


def signal_keys(x: Column) -> Column:
    """SCL9: a signal matches a file if one of these keys is among the file's tokens."""
    parts = identifier_parts(x)
    second = F.when(F.size(parts) == 1, token("part", F.element_at(parts, 1))).otherwise(token("full", F.array_join(parts, "")))
    return F.array_distinct(F.when(F.size(parts) > 0, F.array(token("full", F.lower(x)), second)).otherwise(F.array(token("full", F.lower(x)))))


def words_of(x: Column) -> Column:
    """SCL10: distinct words of a free text: lower-cased, of 3 letters or more, no stopwords, singular."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    kept = F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, singular))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """SCL11."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def hop_distance(hops: Column) -> Column:
    """SCL12: 1 if there is no path."""
    return F.coalesce(hops / (hops + 2), F.lit(1.0))


def correction_confidence(demand: Column, arrow_share: Column, coherence: Column, known: Column) -> Column:
    """SCL13."""
    direction = F.when(known, F.lit(0.5) + F.lit(0.5) * coherence).otherwise(F.lit(0.5))
    return F.when(demand > 0, clamp01((F.lit(1.0) - F.exp(-demand / F.lit(CONFIDENCE_HALF))) * arrow_share * direction)).otherwise(F.lit(0.0))


def capacity_confidence(matched: Column, declared: Column) -> Column:
    """SCL14."""
    return F.when(declared > 0, clamp01(matched / declared)).otherwise(F.lit(0.0))


def utilization_confidence(known: Column) -> Column:
    """SCL15."""
    return F.when(known, F.lit(1.0)).otherwise(F.lit(UNKNOWN_UTILIZATION_CONFIDENCE))


def category(correction: Column, capacity: Column, utilization: Column, known: Column, hi: Column | float = HI, lo: Column | float = LO) -> Column:
    """SCL22: the first rule that holds, on rounded values."""
    h, l_ = either(hi), either(lo)
    return (
        F.when((correction >= h) & (capacity >= h) & ~known, "candidate-unverified")
        .when((correction >= h) & (capacity >= h) & (utilization <= l_), "uncollapsed-feature")
        .when((correction >= h) & (capacity <= l_), "unsupported-wish")
        .when((capacity >= h) & (correction <= l_) & (utilization <= l_), "dormant-capacity")
        .when(utilization >= h, "already-collapsed")
        .otherwise("low-signal")
    )


def is_candidate(kind: Column) -> Column:
    """SCL23."""
    return kind.isin(*CANDIDATES)


def interpretation(kind: Column) -> Column:
    """SCL23: a sentence for each category."""
    return (
        F.when(kind == "candidate-unverified", "Wanted and buildable, but its use is unknown: check that it isn't in use already.")
        .when(kind == "uncollapsed-feature", "Wanted and buildable, and hardly used.")
        .when(kind == "unsupported-wish", "Wanted, but the code has little to build it from.")
        .when(kind == "dormant-capacity", "Buildable, but nobody asks for it.")
        .when(kind == "already-collapsed", "There, and in use.")
        .otherwise("No strong pressure.")
    )


def integration_label(distance: Column) -> Column:
    """SCL24."""
    return F.when(distance <= 0.1, "CO-LOCATED").when(distance <= 0.45, "RIPE").when(distance >= 0.75, "DEEP").when(distance.isNotNull(), "MODERATE")


def change_verdict(potential: Column, utilization: Column) -> Column:
    """SCL25, of the changes in both."""
    return F.when((potential <= -0.1) & (utilization > 0), "collapsed").when(potential <= -0.1, "decaying").when(potential >= 0.1, "intensifying").otherwise("stable")


def stability_verdict(baseline: Column, candidate_share: Column, first_share: Column) -> Column:
    """SCL26."""
    place = F.when(first_share >= 0.8, "always first; ").when(first_share >= 0.2, "sometimes first; ").otherwise("")
    return (
        F.when((baseline < 0.01) & (candidate_share < 0.05), "never a candidate")
        .when(candidate_share <= 0.2, "stable non-candidate")
        .when(candidate_share >= 0.8, F.concat(place, F.lit("robust")))
        .when(candidate_share >= 0.5, F.concat(place, F.lit("mostly robust")))
        .otherwise(F.concat(place, F.lit("fragile")))
    )


def module_name(path: Column) -> Column:
    """SCL28: dotted, without extension and __init__."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.[^.]+$", ""), r"[\\/]", "."), r"\.__init__$", "")


def absolute_module(spec: Column, importer: Column) -> Column:
    """SCL29: a specifier with leading dots, seen from the importing module, without them."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.regexp_replace(spec, r"^\.+", "")
    package = F.split(importer, r"\.")
    base = F.slice(package, 1, F.greatest(F.lit(0), F.size(package) - dots))
    parts = F.when(rest != "", F.concat(base, F.split(rest, r"\."))).otherwise(base)
    return F.when(dots == 0, spec).otherwise(F.array_join(parts, "."))


def parent_module(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", ""))


def plain_path(path: Column) -> Column:
    """SCL30: slashes forward, lower case, without . and .. segments."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/"), lambda s: (s != "") & (s != "."))
    empty = F.expr("array()").cast("array<string>")
    folded = F.aggregate(parts, empty, lambda at, s: F.when(s != "..", F.concat(at, F.array(s))).otherwise(F.slice(at, 1, F.greatest(F.lit(0), F.size(at) - 1))))
    return F.array_join(folded, "/")


def bar(x: Column, width: int = 10) -> Column:
    """SCL31: a share as a bar of # and dots."""
    return F.rpad(F.repeat(F.lit("#"), F.floor(x * width + 0.5).cast("int")), width, ".")


def percent(x: Column) -> Column:
    """SCL31."""
    return F.concat(F.floor(x * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def signed(x: Column) -> Column:
    """SCL31: two places, with a sign."""
    r = rounded(x, 2)
    return F.concat(F.when(r >= 0, "+").otherwise("-"), F.format_string("%.2f", F.abs(r)))


def uniform(seed: Column) -> Column:
    """SCL35: a reproducible number in [0, 1) from a text."""
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
