"""Trivial-continuation rules over (text, completion) pairs as column expressions.

Every rule is a built-in expression (regex, array higher-order functions), so it runs in the
JVM on each row and also works unchanged on a streaming DataFrame. Python's string semantics
are reproduced with explicit character classes instead of engine-specific ``\\s``/``\\b``:
- whitespace for ``str.split()``/``str.strip()``: the code points Python treats as space;
- a number is a maximal run of word characters (letters, numbers, underscore) made only of
  decimal digits, which is what ``\\b(\\d+)\\b`` finds.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace code points (str.isspace), as a regex class.
PY_WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
NUMBER = "(?<![\\p{L}\\p{N}_])\\p{Nd}++(?![\\p{L}\\p{N}_])"

# The 18 structure patterns of the reference filter, in its order
# (html pair, table row, numbered item, bullet item, star item, path with digits, indented
# number, license line, category line, image link, empty link, copyright year, verse,
# numeric entity, class attribute, bib citation, doctype, xml namespace). Written with
# PY_WS for \s and \p{Nd} for \d so Java and the oracle agree with Python.
STRUCTURE_PATTERNS_PY = [
    r"<[a-zA-Z]+>.*?</[a-zA-Z]+>",
    r"\|-\s*\n\|\s",
    r"^\s*\d+\.\s",
    r"^\s*•\s",
    r"^\s*\*\s",
    r"[A-Za-z]+/[A-Za-z]+\d+",
    r"^\s+\d+\.\s",
    r"Licensed under the Apache License",
    r"^Category:",
    r"!\[\]\(.*?\)",
    r"\[\]\(.*?\)",
    r"Copyright \d{4}",
    r"[A-Za-z]+ \d+:\d+",
    r"&#\d+;",
    r'class="[^"]+"',
    r"\[@bib\d+\]",
    r"<!DOCTYPE",
    r'xmlns(:[a-zA-Z]+)?="[^"]+"',
]


def portable(pattern: str) -> str:
    """Rewrite a Python pattern with explicit classes (same meaning in Java and RE2)."""
    return pattern.replace("\\s", PY_WS).replace("\\d", "\\p{Nd}")


# For each of the patterns a literal that every match of it holds. A text without it is not searched.
STRUCTURE_LITERALS = ["</", "|-", ".", "\u2022", "*", "/", ".", "Licensed under the Apache License", "Category:", "![](", "[](", "Copyright ", ":", "&#",
                      'class="', "[@bib", "<!DOCTYPE", "xmlns"]

# Java flags: multiline (^ after every \n) and unix lines ('.' excludes only \n), as in Python.
STRUCTURE_PATTERNS = ["(?md)" + portable(p) for p in STRUCTURE_PATTERNS_PY]

# Script labels by code point range, checked in this order; else 'Other'.
SCRIPT_RANGES = [
    ("CJK", 0x4E00, 0x9FFF),
    ("Hiragana", 0x3040, 0x309F),
    ("Katakana", 0x30A0, 0x30FF),
    ("Cyrillic", 0x0400, 0x04FF),
    ("Arabic", 0x0600, 0x06FF),
    ("Devanagari", 0x0900, 0x097F),
    ("Thai", 0x0E00, 0x0E7F),
    ("Hangul", 0xAC00, 0xD7A3),
]
SCRIPT_LABELS = [r[0] for r in SCRIPT_RANGES] + ["Other"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(s) -> Column:
    return F.regexp_replace(_c(s), f"\\A{PY_WS}+|{PY_WS}+\\z", "")


def py_words(s) -> Column:
    """``str.split()``: whitespace-separated words, no empties."""
    return F.filter(F.split(_c(s), f"{PY_WS}+"), lambda w: w != F.lit(""))


def lines(s) -> Column:
    """``str.split('\\n')`` (keeps empty lines)."""
    return F.split(_c(s), "\n")


#: Every decimal digit of Unicode with its ASCII digit, for ``translate``.
_NON_ASCII_DIGITS = [chr(c) for c in range(128, 0x110000) if unicodedata.decimal(chr(c), None) is not None]
DIGITS_FROM = "".join(_NON_ASCII_DIGITS)
DIGITS_TO = "".join(str(unicodedata.decimal(c)) for c in _NON_ASCII_DIGITS)
LIMB = 18  # digits that a BIGINT holds whatever they are


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda body evaluates whatever it names again per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbers(s) -> Column:
    """Integers of ``\\b(\\d+)\\b`` in order, of any length, as ASCII digits without leading zeros."""
    found = F.regexp_extract_all(_c(s), F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(
        F.when(w.rlike("^[0-9]+$"), w).otherwise(F.translate(w, DIGITS_FROM, DIGITS_TO)), "^0+(?=.)", ""))


def _limbs(n: Column, count: Column) -> Column:
    padded = F.lpad(n, count * LIMB, F.lit("0"))
    return F.transform(F.sequence(count - 1, F.lit(0)), lambda i: F.substring(padded, i * LIMB + 1, F.lit(LIMB)).try_cast("bigint"))


def _with_arithmetic(all_numbers: Column, rule) -> Column:
    """``rule(minus, whole)`` with differences that are exact for the longest of ``all_numbers``.

    Up to 18 digits they are BIGINTs; beyond, arrays of 18-digit limbs, lowest first, in complement
    form with a spare limb, so that equal differences are equal arrays.
    """
    def short_minus(x, y):
        return x.try_cast("bigint") - y.try_cast("bigint")

    def short_whole(i):
        return i.cast("bigint")

    def long(count):
        def minus(x, y):
            zero = F.struct(F.lit(0).cast("bigint").alias("borrow"), F.array().cast("array<bigint>").alias("out"))

            def step(acc, d):
                left = d - acc["borrow"]
                return F.struct(F.when(left < 0, 1).otherwise(0).cast("bigint").alias("borrow"),
                                F.concat(acc["out"], F.array(F.pmod(left, F.lit(10 ** LIMB)))).alias("out"))

            return F.aggregate(F.zip_with(_limbs(x, count), _limbs(y, count), lambda a, b: a - b), zero, step, lambda r: r["out"])

        return rule(minus, lambda i: _limbs(i.cast("string"), count))

    width = F.coalesce(F.array_max(F.transform(all_numbers, F.length)), F.lit(0))
    return _let(width, lambda w: F.when(w <= LIMB, rule(short_minus, short_whole)).otherwise(
        _let((F.floor(w / LIMB) + 2).cast("int"), long)))


def _steps(arr: Column, fn) -> Column:
    """``fn(element, element before)`` of every neighbouring pair."""
    n = F.greatest(F.size(arr) - 1, F.lit(0))
    return F.zip_with(F.slice(arr, 2, n), F.slice(arr, 1, n), fn)


def is_sequential_numbers(text, completion) -> Column:
    """O68 (S11)."""
    def decide(z):
        last, c = z["last"], z["c"]

        def rule(minus, whole):
            cont = F.forall(F.transform(c, lambda x, i: minus(x, last) == whole(i + 1)), lambda ok: ok)
            inner = (F.size(c) > 1) & F.forall(_steps(c, lambda x, y: minus(x, y) == whole(F.lit(1))), lambda ok: ok)
            return cont | inner

        return last.isNotNull() & (F.size(c) > 0) & _with_arithmetic(F.array_append(c, last), rule)

    found = F.struct(F.try_element_at(numbers(text), F.lit(-1)).alias("last"), numbers(completion).alias("c"))
    return F.coalesce(_let(found, decide), F.lit(False))


def _numbered_lines(ls: Column) -> Column:
    return F.filter(F.transform(ls, numbers), lambda a: F.size(a) > 0)


def is_line_by_line_sequential(text, completion) -> Column:
    """O69 (S12)."""
    def decide(z):
        t, c = z["t"], z["c"]

        def rule(minus, whole):
            def increments(nl):
                """Element-wise differences of neighbouring numbered lines with equal counts."""
                same_size = _steps(nl, lambda x, y: F.when(F.size(x) == F.size(y), F.zip_with(x, y, minus)))
                return F.flatten(F.filter(same_size, lambda d: d.isNotNull()))

            def judge(y):
                first_t, first_c = F.try_element_at(y["ti"], F.lit(1)), F.try_element_at(y["ci"], F.lit(1))
                both = first_t.isNotNull() & first_c.isNotNull()
                same = both & (first_t == first_c) & F.forall(F.concat(y["ti"], y["ci"]), lambda x: x == first_t)
                return same | _let(F.when(both, first_t).otherwise(whole(F.lit(1))), cont)

            def cont(inc):
                last_t, first_c = F.try_element_at(t, F.lit(-1)), F.try_element_at(c, F.lit(1))
                return (F.size(last_t) == F.size(first_c)) & F.forall(
                    F.zip_with(last_t, first_c, lambda x, y: minus(y, x) == inc), lambda ok: ok)

            return _let(F.struct(increments(t).alias("ti"), increments(c).alias("ci")), judge)

        return (F.size(t) >= 2) & (F.size(c) >= 2) & _with_arithmetic(F.flatten(F.concat(t, c)), rule)

    def split_lines(y):
        # Lines are searched for numbers only if there are two on both sides.
        return (F.size(y["t"]) >= 2) & (F.size(y["c"]) >= 2) & _let(
            F.struct(_numbered_lines(y["t"]).alias("t"), _numbered_lines(y["c"]).alias("c")), decide)

    both_lines = F.struct(lines(py_strip(text)).alias("t"), lines(py_strip(completion)).alias("c"))
    return F.coalesce(_let(both_lines, split_lines), F.lit(False))


def _nonspace(s) -> Column:
    return F.regexp_replace(_c(s), f"{PY_WS}+", "")


def _single_char(ns: Column) -> Column:
    """Whether a text is one character again and again."""
    return (F.length(ns) > 0) & (F.length(F.replace(ns, F.left(ns, F.lit(1)), F.lit(""))) == 0)


def is_repeated_text(text, completion) -> Column:
    """O70 (S13)."""
    t, c = _c(text), _c(completion)
    # A window of three words is in the joined completion as three whole words, or with its outer words inside longer
    # ones. Either way a window of the completion has its middle word and touching letters: only such windows are searched for.
    def windows(ws, fn):
        n = F.greatest(F.size(ws) - 2, F.lit(0))
        return F.zip_with(F.zip_with(F.slice(ws, 1, n), F.slice(ws, 2, n), lambda x, y: F.struct(x.alias("a"), y.alias("b"))),
                          F.slice(ws, 3, n), lambda p, z: fn(p["a"], p["b"], z))

    def touching(x, y, z):
        return F.concat_ws(" ", F.right(x, F.lit(1)), y, F.left(z, F.lit(1)))

    def shares_window(z):
        tw, cw = z["tw"], z["cw"]

        def search(y):
            def held(a, b, c):
                return F.array_contains(y["common"], touching(a, b, c)) & F.contains(y["joined"], F.concat_ws(" ", a, b, c))

            return (F.size(y["common"]) > 0) & F.exists(windows(tw, held), lambda w: w)

        common = F.array_intersect(windows(tw, touching), windows(cw, touching))
        return (F.size(tw) >= 3) & (F.size(cw) >= 3) & _let(F.struct(common.alias("common"), F.array_join(cw, " ").alias("joined")), search)

    phrase = _let(F.struct(py_words(t).alias("tw"), py_words(c).alias("cw")), shares_window)
    def last_lines(stripped):
        return _let(lines(stripped), lambda ls: F.array_join(F.slice(ls, F.greatest(F.size(ls) - 2, F.lit(1)), 3), "\n"))

    ends = _let(F.struct(py_strip(t).alias("t"), py_strip(c).alias("c")), lambda z: (z["t"] == z["c"]) | F.contains(z["c"], last_lines(z["t"])))
    single = (F.length(t) > 3) & (F.length(c) > 3) & _let(F.struct(_nonspace(t).alias("t"), _nonspace(c).alias("c")), lambda z: (
        F.left(z["t"], F.lit(1)) == F.left(z["c"], F.lit(1))) & _single_char(z["t"]) & _single_char(z["c"]))
    return F.coalesce((F.length(t) > 0) & (F.length(c) > 0) & (ends | single | phrase), F.lit(False))


def _density(s, count: Column, i: int) -> Column:
    """Whether structure pattern i has more than 0.3 matches a line of ``s``."""
    return F.contains(s, F.lit(STRUCTURE_LITERALS[i])) & ((F.regexp_count(s, F.lit(STRUCTURE_PATTERNS[i])) / count) > 0.3)


def structure_density_hit(text, completion) -> Column:
    """O71 (S14): some pattern with > 0.3 matches per line on both sides."""
    t, c = _c(text), _c(completion)
    tn = F.greatest(F.size(lines(t)), F.lit(1))
    cn = F.greatest(F.size(lines(c)), F.lit(1))
    hits = [_density(t, tn, i) & _density(c, cn, i) for i in range(len(STRUCTURE_PATTERNS))]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def matched_structure(text, completion) -> Column:
    """Index (0-based) of the first structure pattern hitting on both sides, else NULL."""
    t, c = _c(text), _c(completion)
    tn = F.greatest(F.size(lines(t)), F.lit(1))
    cn = F.greatest(F.size(lines(c)), F.lit(1))
    out = F.lit(None).cast("int")
    for i in reversed(range(len(STRUCTURE_PATTERNS))):
        out = F.when(_density(t, tn, i) & _density(c, cn, i), F.lit(i)).otherwise(out)
    return out


def skeleton_lines(s) -> Column:
    """O72 (first half): first <= 5 stripped-text lines with [a-zA-Z0-9]+ runs replaced by X."""
    ls = lines(py_strip(s))
    return F.transform(F.slice(ls, 1, 5), lambda ln: F.regexp_replace(ln, "[a-zA-Z0-9]+", "X"))


def non_latin(s) -> Column:
    """Characters with code point > 127, in order."""
    return F.regexp_replace(_c(s), "[\\x00-\\x7F]+", "")


def script_of(ch: Column) -> Column:
    cp = F.ascii(ch)
    out = F.lit("Other")
    for label, lo, hi in reversed(SCRIPT_RANGES):
        out = F.when((cp >= lo) & (cp <= hi), F.lit(label)).otherwise(out)
    return out


def dominant_script(s) -> Column:
    """Most frequent script among non-ASCII characters; tie -> the one seen first."""
    return _let(non_latin(s), _dominant)


def _dominant(nl: Column) -> Column:
    ranges = {label: f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for label, lo, hi in SCRIPT_RANGES}
    known = "".join(ranges.values())
    # (characters of the script, all others) as regex classes
    classes = {label: (f"[{r}]", f"[^{r}]+") for label, r in ranges.items()} | {"Other": (f"[^{known}]", f"[{known}]+")}
    cands = [
        F.struct(
            F.length(F.regexp_replace(nl, others, "")).alias("n"),
            (-F.regexp_instr(nl, F.lit(own))).alias("first"),
            F.lit(label).alias("script"),
        )
        for label, (own, others) in classes.items()
    ]
    best = F.array_max(F.filter(F.array(*cands), lambda x: x["n"] > 0))
    return best["script"]


def is_repetitive(s) -> Column:
    """O74 (S17): some prefix of length 2..n/2 occurs c > 1 times (non-overlapping), c*L > n/2.

    The count of a longer prefix never exceeds that of a shorter one, so the scan stops
    (the fold state turns ``dead``) at the first prefix that no longer repeats.
    """
    def scan(z):
        s, n = z["s"], z["n"]

        def step(acc, length):
            prefix = F.substring(s, 1, length)
            cnt = (n - F.length(F.replace(s, prefix, F.lit("")))) / length
            skip = acc["found"] | acc["dead"]
            return F.when(skip, acc).otherwise(_let(cnt, lambda c: F.struct(
                ((c > 1) & (c * length > n / 2)).alias("found"), (c <= 1).alias("dead"))))

        init = F.struct(F.lit(False).alias("found"), F.lit(False).alias("dead"))
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.floor(n / 2).cast("int"), F.lit(2))), init, step, lambda acc: acc["found"])

    # Text and length are bound: the scan would work them out again at every step.
    both = _let(_c(s), lambda x: _let(F.struct(x.alias("s"), F.length(x).alias("n")), lambda z: (z["n"] >= 4) & scan(z)))
    return F.coalesce(both, F.lit(False))


def script_repetition(text, completion) -> Column:
    """Third arm of O75: both have non-ASCII text, same dominant script, both repetitive."""
    def decide(z):
        nt, nc = z["t"], z["c"]
        return (F.length(nt) > 0) & (F.length(nc) > 0) & is_repetitive(nt) & is_repetitive(nc) & (_dominant(nt) == _dominant(nc))

    return F.coalesce(_let(F.struct(non_latin(text).alias("t"), non_latin(completion).alias("c")), decide), F.lit(False))
