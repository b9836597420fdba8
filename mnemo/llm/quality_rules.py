"""Quality rules as weak supervision, in DataFrame functions only.

Statistics of every whole text become votes: each rule says good (1), bad (-1) or abstains (0).
Expectation-maximisation over the table of distinct vote patterns (at most 3 to the number of rules,
whatever the input) estimates how often each rule is right when it speaks, and the posterior
probability of quality replaces all-must-pass filtering.

The model: a document is good with probability ``prior``; a rule that does not abstain is right with
one accuracy on good and another on bad documents, independently given the class; abstaining says
nothing. Accuracies are bounded so that a rule can be weak but never turn its meaning round.

Nulls count as empty texts: they have no words, every base figure is 0, and ``base_failed`` is true.
An empty table gives an empty result. Repeated rows are judged row by row. Columns of the input that
clash with the result's are not carried along; ``keep_good`` returns exactly the input's columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import written

SPACES = " \t\n\x0b\x0c\r"
LINE_ENDS = (".", "!", "?", ":", ";", "\"", "'")
SYMBOLS = r"[^#*$%&|<>]+"
PRIOR = 0.8
ROUNDS = 8
#: By design of the thresholds, a rule speaks ill of at most this share of the good documents it judges.
GOOD_AT_LEAST = 0.995
_POSITION_BITS = 20


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a lambda would compute it per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(flagged: Column) -> Column:
    """Positions covered by three-word windows starting at the given ascending positions."""
    return F.aggregate(
        flagged,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def _window_hashes(words: Column) -> Column:
    return _bind(words, lambda w: F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))


def repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order.

    Only texts with a repeated window get past the first test. There, hash and position are packed
    in one long (44 and 20 bits), sorted, and neighbours compared by their full hashes. Texts too
    long for that packing, or with two different windows equal in 44 bits, compare every window.
    """
    low = F.lit((1 << _POSITION_BITS) - 1).cast("long")

    def same(x: Column, y: Column) -> Column:
        return F.shiftright(x, _POSITION_BITS) == F.shiftright(y, _POSITION_BITS)

    def place(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def fast(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 << _POSITION_BITS)).bitwiseOR(i)))
        near = _bind(keys, lambda s: F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False))))
        return _bind(near, lambda s: F.struct(
            F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda j: same(F.get(s, j), F.get(s, j - 1))
                     & (F.get(h, place(F.get(s, j))) != F.get(h, place(F.get(s, j - 1))))).alias("mixed"),
            _covered(F.sort_array(F.transform(s, lambda x: x.bitwiseAND(low)))).alias("n")))

    def slow(h: Column) -> Column:
        flagged = F.filter(F.transform(h, lambda x, i: F.when(F.size(F.filter(h, lambda y: y == x)) > 1, i.cast("long"))), lambda p: p.isNotNull())
        return _covered(flagged)

    def count(h: Column) -> Column:
        quick = F.when(F.size(h) < (1 << _POSITION_BITS), fast(h))
        return _bind(quick, lambda r: F.when(r.isNull() | r["mixed"], slow(h)).otherwise(r["n"]))

    return F.coalesce(_bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(count(h))), F.lit(0).cast("long"))


def with_statistics(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """Adds one struct column of the statistics that the rules read."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaced = t
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    tokens = F.array_remove(F.split(spaced, " ", -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    # Each array is bound once: everything below reads lambda variables.
    line_figures = _bind(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(ls, lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*LINE_ENDS))).cast("long").alias("n_ended_lines")))
    word_figures = _bind(tokens, lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        repeat_words(_window_hashes(ws)).alias("n_repeat_words")))
    symbols = F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long")
    figures = F.struct(word_figures.alias("w"), line_figures.alias("l"), symbols.alias("s"))
    return docs.withColumn(into, _bind(figures, lambda z: F.struct(
        z["w"]["n_words"].alias("n_words"), z["w"]["word_chars"].alias("word_chars"), z["s"].alias("n_symbols"), z["l"]["n_dup_lines"].alias("n_dup_lines"),
        z["w"]["n_repeat_words"].alias("n_repeat_words"), z["l"]["n_lines"].alias("n_lines"), z["l"]["n_ended_lines"].alias("n_ended_lines"))))


def _field(s: str | Column, name: str) -> Column:
    return F.col(f"{s}.{name}") if isinstance(s, str) else s[name]


def base_failed(s: str | Column = "stats") -> Column:
    return (_field(s, "n_words") < 50) | (100 * _field(s, "n_repeat_words") > 50 * _field(s, "n_words"))


def rules(s: str | Column = "stats") -> dict[str, Column]:
    """The votes: 1 good, -1 bad, 0 abstains."""
    c = {k: _field(s, k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines")}

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    n, lines, chars = c["n_words"], c["n_lines"], c["word_chars"]
    return {
        "length": vote(n < 20, n >= 80),
        "word_length": vote((chars < 2 * n) | (chars > 12 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        "symbols_by_word": vote(10 * c["n_symbols"] > n, 50 * c["n_symbols"] <= n),
        "symbols_by_char": vote(60 * c["n_symbols"] > chars, 300 * c["n_symbols"] <= chars),
        "repeated_lines": vote((c["n_dup_lines"] >= 3) & (100 * c["n_dup_lines"] > 30 * lines), c["n_dup_lines"] == 0),
        "repeated_phrases": vote(100 * c["n_repeat_words"] > 30 * n, 100 * c["n_repeat_words"] <= 15 * n),
        "line_ends": vote((lines >= 4) & (100 * c["n_ended_lines"] < 12 * lines), (lines >= 2) & (100 * c["n_ended_lines"] >= 70 * lines)),
    }


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[float, dict[str, dict[str, float]]]:
    """Share of good documents and accuracies of each rule, by expectation-maximisation.

    ``votes`` has one int column per name. Distinct vote patterns are counted once over all rows; each
    round is one aggregate of that table (at most 3 ** len(names) rows) whose single row of sums is
    read. Of each rule two accuracies are kept: ``good`` (how often it says good of a good document
    when it speaks) and ``bad`` (how often it says bad of a bad one). The first round takes documents
    that some rule calls bad as bad with probability 0.9; later rounds take the posterior.
    """
    patterns = written(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "votes").coalesce(1)
    some_bad = F.least(F.lit(0), *[F.col(k) for k in names]) < 0
    p: Column = F.when(some_bad, 0.1).otherwise(0.95)
    accuracy: dict[str, dict[str, float]] = {k: {"good": 0.9, "bad": 0.5} for k in names}
    for _ in range(rounds):
        n, good, bad = F.col("n"), F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum(n).alias("n"), F.sum(good).alias("good")]
        for k in names:
            says = F.col(k)
            sums += [F.sum(F.when(says == 1, good)).alias(f"{k}_gg"), F.sum(F.when(says != 0, good)).alias(f"{k}_g"),
                     F.sum(F.when(says == -1, bad)).alias(f"{k}_bb"), F.sum(F.when(says != 0, bad)).alias(f"{k}_b")]
        row = patterns.withColumn("p", p).agg(*sums).first()
        if not row["n"]:
            break
        prior = min(0.98, max(0.05, row["good"] / row["n"]))
        for k in names:
            right_good = ((row[f"{k}_gg"] or 0) + 9) / ((row[f"{k}_g"] or 0) + 10)
            right_bad = ((row[f"{k}_bb"] or 0) + 1) / ((row[f"{k}_b"] or 0) + 10)
            right_good = min(0.999, max(GOOD_AT_LEAST, right_good))
            # A rule may be weak, but never means the opposite of what it says.
            accuracy[k] = {"good": right_good, "bad": min(0.99, max(1.001 - right_good, right_bad))}
        p = posterior({k: F.col(k) for k in names}, prior, accuracy)
    return prior, accuracy


def posterior(votes: dict[str, Column], prior: float, accuracy: dict[str, dict[str, float]]) -> Column:
    """Probability of quality given the votes, under rules independent given the class."""
    logit = F.lit(math.log(prior / (1 - prior)))
    for k, v in votes.items():
        good, bad = accuracy[k]["good"], accuracy[k]["bad"]
        logit = logit + F.when(v == 1, math.log(good / (1 - bad))).when(v == -1, math.log((1 - good) / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def judged(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input's rows with ``stats`` (struct), ``base_failed``, ``quality`` (posterior) and ``kept``.

    Rows are written once with their statistics, so whole texts are read once; drop the text
    beforehand (``select``) is not needed when only figures are kept, see ``figures``.
    """
    own = with_statistics(docs, text)
    voted = own.withColumn("votes", F.struct(*[v.alias(k) for k, v in rules().items()]))
    held = written(voted, "quality")
    names = list(rules())
    prior, accuracy = fit(held.select("votes.*"), names)
    p = posterior({k: F.col(f"votes.{k}") for k in names}, prior, accuracy)
    return held.withColumn("base_failed", base_failed()).withColumn("quality", p).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def figures(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """As ``judged``, but only key, statistics and verdict are written (no text)."""
    own = with_statistics(docs.select(F.col(key).alias(key), F.col(text).alias("_text")), "_text").drop("_text")
    voted = written(own.withColumn("votes", F.struct(*[v.alias(k) for k, v in rules().items()])), "quality")
    names = list(rules())
    prior, accuracy = fit(voted.select("votes.*"), names)
    p = posterior({k: F.col(f"votes.{k}") for k in names}, prior, accuracy)
    return voted.withColumn("base_failed", base_failed()).withColumn("quality", p).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that the rules keep, with the input's columns.

    Texts are read twice, for the table of vote patterns and for the verdict, and never written.
    """
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{text}`").alias("_text"))
    names = list(rules())
    own = with_statistics(packed, "_text")
    # Bound, so that the statistics stand in the plan (and are computed) once a pass.
    votes = own.select(_bind(F.col("stats"), lambda s: F.struct(*[v.alias(k) for k, v in rules(s).items()])).alias("votes"))
    prior, accuracy = fit(votes.select("votes.*"), names)

    def verdict(s: Column) -> Column:
        return ~base_failed(s) & (posterior(rules(s), prior, accuracy) >= threshold)

    return own.where(_bind(F.col("stats"), verdict)).select("row.*")
