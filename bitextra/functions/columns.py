"""The same text functions as Column expressions, inside whole-stage code generation where Spark has the parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextra.functions import kernel, strings

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(c: ColumnLike) -> Column:
    return F.lower(F.translate(_c(c), strings.WIDTH_FROM, strings.WIDTH_TO))


def strip_tags(c: ColumnLike) -> Column:
    return F.regexp_replace(_c(c), r"<[^>]+>", "")


def collapse_blanks(c: ColumnLike) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?U)\s+", " "), "^ | $", "")


def make_cmp(c: ColumnLike) -> Column:
    """Comparison form: tags out, folded, blanks collapsed. Null for null."""
    return F.lower(kernel.call("CompareForm", _c(c)))


def nfkc(c: ColumnLike) -> Column:
    """Compatibility normalisation; plain ASCII does not leave the JVM's projection through Python."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    c = _c(c)
    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, c).otherwise(run(F.when(~plain, c)))


def without_accents(c: ColumnLike) -> Column:
    """Text without combining marks; plain ASCII does not leave the JVM."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(strings.without_accents, na_action="ignore")

    c = _c(c)
    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, c).otherwise(run(F.when(~plain, c)))


def hira_to_kata(c: ColumnLike) -> Column:
    return F.translate(_c(c), strings.WIDTH_FROM[-86:], strings.WIDTH_TO[-86:])


def make_cmp_nfkc(c: ColumnLike, case: bool = True, width: bool = True, kana: bool = True) -> Column:
    out = strip_tags(c)
    out = nfkc(out) if width else out
    out = F.lower(out) if case else out
    return collapse_blanks(hira_to_kata(out) if kana else out)


def contains_cjk(c: ColumnLike, flavour: str = "js") -> Column:
    return _c(c).rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in strings.CJK_RANGES[flavour]) + "]")


def by_char(c: ColumnLike) -> Column:
    return contains_cjk(c) | ~_c(c).contains(" ")


def tokens(c: ColumnLike) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(r"(?U)[.,;:!?()\"'\[\]{}<>]|[^\s.,;:!?()\"'\[\]{}<>]+"), 0)


def numbers(c: ColumnLike) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), 0)


def caps_words(c: ColumnLike) -> Column:
    return F.regexp_extract_all(_c(c), F.lit("[A-Z][A-Z0-9]+"), 0)


def opening_tags(c: ColumnLike) -> Column:
    found = F.regexp_extract_all(_c(c), F.lit("<([^>]+)>"), 1)
    return F.filter(F.transform(found, F.lower), lambda t: ~t.startswith("/"))


def multiset_difference(a: Column, b: Column) -> Column:
    """Size of the symmetric difference of two arrays as multisets."""
    def count(arr: Column, x: Column) -> Column:
        return F.size(F.filter(arr, lambda y: y == x))

    return F.aggregate(F.array_union(a, b), F.lit(0), lambda acc, x: acc + F.abs(count(a, x) - count(b, x)))


def format_penalty(a: ColumnLike, b: ColumnLike) -> Column:
    return multiset_difference(opening_tags(a), opening_tags(b)) / F.lit(100.0)


def _chars(c: ColumnLike) -> Column:
    return F.filter(F.split(_c(c), ""), lambda x: x != "")


def bag_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return multiset_difference(_chars(a), _chars(b))


def bag_common(a: ColumnLike, b: ColumnLike) -> Column:
    """Size of the multiset intersection of the characters, from the lengths left after removing each character."""
    a, b = _c(a), _c(b)

    def times(text: Column, ch: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, ch, F.lit("")))

    shared = F.array_intersect(F.split(a, ""), F.split(b, ""))
    return F.aggregate(shared, F.lit(0), lambda acc, ch: acc + F.least(times(a, ch), times(b, ch)))


def edit_lower_bound(a: ColumnLike, b: ColumnLike) -> Column:
    return F.greatest(F.length(_c(a)), F.length(_c(b))) - bag_common(a, b)


def budget(a: ColumnLike, b: ColumnLike, least: float) -> Column:
    h = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return (h - F.floor(h * F.lit(float(least)))).cast("int")


def passes_symmetric_bag(a: ColumnLike, b: ColumnLike, least: float) -> Column:
    """The legacy prefilter, by the symmetric difference of the characters; it also turns down pairs that reach ``least``."""
    h = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return (h == 0) | ((h - bag_distance(a, b)) / h >= least)


def length_ratio_ok(a: ColumnLike, b: ColumnLike, least: float) -> Column:
    la, lb = F.length(_c(a)), F.length(_c(b))
    return F.least(la, lb) >= F.lit(float(least)) * F.greatest(la, lb)


def edit_score(a: ColumnLike, b: ColumnLike, least: float = 0.0) -> Column:
    """(h - distance) / h, 0 beyond the budget; the bounded distance stops early."""
    a, b = _c(a), _c(b)
    h = F.greatest(F.length(a), F.length(b))
    d = F.call_function("levenshtein", a, b, budget(a, b, least))
    return F.when(h == 0, 1.0).when(d < 0, 0.0).otherwise((h - d) / h).cast("double")


def _pairs(f):
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def word_score(a: ColumnLike, b: ColumnLike, least: float = 0.0) -> Column:
    return _pairs(lambda x, y: strings.word_score(x, y, least))(_c(a), _c(b))


def substring_score(term: ColumnLike, text: ColumnLike, least: float) -> Column:
    term, text = _c(term), _c(text)
    near = _pairs(lambda x, y: strings.substring_score(x, y, least))(term, text)
    return F.when(term == "", 0.0).when(text.contains(term), 1.0).otherwise(near if least < 1 else F.lit(0.0))


def fuzzy_score(query: ColumnLike, source: ColumnLike, least: float) -> Column:
    """Score of two comparison forms by characters or words, 0 below ``least``; only word pairs go to Python."""
    q, s = _c(query), _c(source)
    passes = length_ratio_ok(q, s, least) & (edit_lower_bound(q, s) <= budget(q, s, least))
    by_words = ~by_char(q) & passes
    words = word_score(F.when(by_words, q), F.when(by_words, s), least)
    raw = F.when(q == s, 1.0).when(~passes, 0.0).when(by_char(q), edit_score(q, s, least)).otherwise(words)
    return F.when(raw >= least, raw).otherwise(0.0)


def bounded_pattern(folded: Column) -> Column:
    """Regular expression that finds a folded term at its own edges, for ``rlike`` on folded text."""
    def edge(first: bool) -> Column:
        c = F.substring(folded, 1, 1) if first else F.substring(folded, -1, 1)
        look = "(?<![{}])" if first else "(?![{}])"
        return F.when(c.rlike("[a-z]"), look.format("a-z")).when(c.rlike("[0-9]"), look.format("0-9")).otherwise("")

    quoted = F.regexp_replace(folded, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.concat(edge(True), quoted, edge(False))


def contains_bounded(text: ColumnLike, folded: Column) -> Column:
    """Whether the folded ``text`` holds the term without running on at its letter or digit edges."""
    return F.when(folded == "", True).otherwise(F.regexp_like(fold(text), bounded_pattern(folded)))


def pattern_groups(pattern: str) -> int | None:
    """Groups of a regular expression, as the engine that runs the filters reads it; None if it is invalid."""
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    try:
        compiled = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(f"(?iu){pattern}")
    except IllegalArgumentException:
        return None
    return compiled.matcher("").groupCount()


def apply_casing(pattern: ColumnLike, text: ColumnLike) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else strings.apply_casing(x, y) for x, y in zip(a, b)], dtype=object)

    return run(_c(pattern), _c(text))


def escape_html(c: ColumnLike, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(_c(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def decode_xml(c: ColumnLike) -> Column:
    out = _c(c)
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(ch))
    return out


def encode_xml(c: ColumnLike) -> Column:
    out = _c(c)
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(ch), F.lit(entity))
    return out


def parse_a1(c: ColumnLike) -> Column:
    """struct<col, row, col2, row2> of an A1 reference; null if it is none."""
    c = _c(c)
    pattern = r"^([A-Za-z]+)(\d+)?(?::([A-Za-z]+)(\d+)?)?$"
    part = [F.nullif(F.regexp_extract(c, pattern, i), F.lit("")) for i in (1, 2, 3, 4)]
    parts = F.struct(F.upper(part[0]).alias("col"), part[1].try_cast("int").alias("row"), F.upper(part[2]).alias("col2"), part[3].try_cast("int").alias("row2"))
    return F.when(c.rlike(pattern), parts)


def column_number(c: ColumnLike) -> Column:
    """Number of a single-letter column."""
    return F.ascii(F.upper(_c(c))) - 64
