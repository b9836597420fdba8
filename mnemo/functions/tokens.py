"""Column expressions over token sequences.

Tokens are whitespace-separated words kept as ``ARRAY<STRING>``; a sub-word tokenizer is a
model artefact and is replaced by this rule (see README). Everything here is a built-in
expression, so it stays inside whole-stage codegen / JVM evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII whitespace class used for splitting (space, tab, newline, vertical tab,
# form feed, carriage return). Same class is used by the DuckDB oracle.
WHITESPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(text) -> Column:
    """Text -> ARRAY<STRING> of whitespace tokens (empty strings dropped)."""
    return F.filter(F.split(_c(text), WHITESPACE), lambda t: t != F.lit(""))


def first_tokens(text, n: int) -> Column:
    """O26 + O27: the first n tokens of a text, or all if it has fewer; what comes after them is not split."""
    # One part more for an empty string before leading whitespace, one for the text after.
    parts = F.slice(F.split(_c(text), WHITESPACE, n + 2), 1, n + 1)
    return F.slice(F.filter(parts, lambda t: t != F.lit("")), 1, n)


def n_tokens(text) -> Column:
    return F.size(tokenize(text))


def context_part(tokens, prompt_tokens: int) -> Column:
    """First P tokens."""
    return F.slice(_c(tokens), 1, prompt_tokens)


def completion_part(tokens, prompt_tokens: int, generation_tokens: int) -> Column:
    """Tokens P .. P+G-1 (the true continuation)."""
    return F.slice(_c(tokens), prompt_tokens + 1, generation_tokens)


def detokenize(tokens) -> Column:
    """Tokens -> text (single space join)."""
    return F.array_join(_c(tokens), " ")


def concat_sequences(a, b) -> Column:
    """Context ++ true completion."""
    return F.concat(_c(a), _c(b))


def match_count(generated, truth) -> Column:
    """Number of positions where generated[i] equals truth[i]; a missing token never matches."""
    g, t = _c(generated), _c(truth)
    return F.aggregate(
        F.transform(t, lambda x, i: F.when(F.try_element_at(g, i + 1) == x, 1).otherwise(0)),
        F.lit(0),
        lambda acc, v: acc + v,
    )


def memorization_score(generated, truth, divisor=None) -> Column:
    """Position-wise matches / divisor (default: length of the truth, i.e. G)."""
    d = F.size(_c(truth)) if divisor is None else (F.lit(divisor) if isinstance(divisor, int) else _c(divisor))
    return F.try_divide(match_count(generated, truth).cast("double"), d.cast("double"))


def snippet(text, n: int = 200) -> Column:
    """First n characters + '...' only when longer than n."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def escape_control(token) -> Column:
    """O38: \\n \\t \\r -> two-character escapes, other code points < 32 -> \\xHH."""
    out = _c(token)
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    out = F.replace(out, F.lit("\t"), F.lit("\\t"))
    out = F.replace(out, F.lit("\r"), F.lit("\\r"))
    for cp in range(32):
        if cp in (9, 10, 13):
            continue
        out = F.replace(out, F.lit(chr(cp)), F.lit("\\x%02x" % cp))
    return out


def ngram_array(tokens, n: int) -> Column:
    """All contiguous n-grams of a token array as space-joined strings (in order)."""
    t = _c(tokens)
    return F.when(
        F.size(t) >= n,
        F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " ")),
    ).otherwise(F.array().cast("array<string>"))
