"""Text functions, Column to Column; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation and ASCII white space, as the token rule names them.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
SPACES = r"[ \t\n\r\f\x0B]+"


def tokenize(text: Column) -> Column:
    """Lower case, punctuation to spaces, split at white space; null gives no token."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " ")
    return F.filter(F.split(plain, SPACES), lambda t: t != "")


def normalize(text: Column) -> Column:
    """Lower case, trimmed, white space squeezed, without closing marks."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), SPACES, " ")), "[.!?]+$", "")


def sentences(text: Column) -> Column:
    """Pieces that end in a closing mark followed by white space."""
    return F.split(text, r"(?<=[.!?])[ \t\n\r\f\x0B]+")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams joined by spaces; none of shorter arrays."""

    def run(t: Column) -> Column:
        places = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(t, i, n), " "))

    return let(tokens, run)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def zero_guard(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the divisor is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)
