"""Quality checks of records: numbers, capital words and glossary terms, one row an issue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextra.functions import columns as C
from bitextra.functions.strings import find_bounded, fold
from bitextra.operators.lookup import GRAM, grams
from bitextra.operators.placement import SMALL
from bitextra.scratch import spread


def numbers(records: DataFrame) -> DataFrame:
    """id, value, side: numbers of the source that the target lacks ('target'), and the other way round ('source').

    Numbers are counted as multisets within the row, without a shuffle.  Null texts have no numbers.
    """
    rows = records.select("id", *[C.numbers(F.coalesce(c, F.lit(""))).alias(c) for c in ("source", "target")])

    def count(arr, x):
        return F.size(F.filter(arr, lambda y: y == x))

    s, t = F.col("source"), F.col("target")
    over = lambda a, b, side: F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(F.struct(x.alias("value"), F.lit(side).alias("side")), F.greatest(F.lit(0), count(a, x) - count(b, x)))))
    return rows.select("id", F.explode(F.concat(over(s, t, "target"), over(t, s, "source"))).alias("i")).select("id", "i.value", "i.side")


def capital_words(records: DataFrame, glossary: DataFrame) -> DataFrame:
    """id, word: capital words of the source that the target lacks and that are no terms; repeats repeat."""
    words = records.select("id", F.coalesce("target", F.lit("")).alias("t"), F.explode(C.caps_words(F.coalesce("source", F.lit("")))).alias("word"))
    words = words.filter(~F.contains("t", F.col("word"))).select("id", "word", C.fold("word").alias("w"))
    known = glossary.filter("term IS NOT NULL AND term <> ''").select(C.fold("term").alias("w")).distinct()
    return words.join(known, "w", "left_anti").select("id", "word")


def terms(records: DataFrame, glossary: DataFrame, folded_edges: bool = False, small: int = SMALL) -> DataFrame:
    """id, term_id, term, translation: terms of the source whose translation the target lacks, at word boundaries.

    A glossary of up to ``small`` entries travels with the tasks; all its terms are found in one pass over a text where
    an Aho-Corasick automaton is at hand.  A larger one meets the texts by the first characters of its terms; the rows
    are the same.  A wide letter beside a term is no letter that runs on, unless ``folded_edges``.  Entries without a
    term or translation are left out.
    """
    rows = glossary.select("id", "term", "translation").filter("term <> '' AND translation <> ''").orderBy("id").limit(small + 1).collect()
    if len(rows) > small:
        return _terms_joined(records, glossary, folded_edges)
    entries = [(r["id"], r["term"], r["translation"]) for r in rows]
    kind = glossary.schema["id"].dataType.simpleString()
    id_kind = records.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_term: dict[str, list[tuple]] = {}
        for e in entries:
            by_term.setdefault(fold(e[1]), []).append((*e, fold(e[2])))
        find = _finder(list(by_term))
        for b in batches:
            out = []
            for i, source, target in zip(b["id"], b["source"], b["target"]):
                s, t = fold(source), fold(target)
                if folded_edges:
                    source, target = s, t
                for term in find(s):
                    if find_bounded(source, term, 0, s) >= 0:
                        out += [(i, e, name, x) for e, name, x, low in by_term[term] if low not in t or find_bounded(target, low, 0, t) < 0]
            yield pd.DataFrame(out, columns=["id", "term_id", "term", "translation"])

    texts = spread(records.select("id", "source", F.coalesce("target", F.lit("")).alias("target")).filter("source <> ''"))
    return texts.mapInPandas(run, f"id {id_kind}, term_id {kind}, term string, translation string")


def _lacks(source: str, target: str, term: str, translation: str, folded_edges: bool) -> bool:
    """Whether the source holds the folded term at word boundaries and the target not its folded translation."""
    s, t = fold(source), fold(target)
    if folded_edges:
        source, target = s, t
    return find_bounded(source, term, 0, s) >= 0 and (translation not in t or find_bounded(target, translation, 0, t) < 0)


def _terms_joined(records: DataFrame, glossary: DataFrame, folded_edges: bool) -> DataFrame:
    """``terms`` as a join of the runs of each text with the first characters of each term."""
    g = glossary.select(F.col("id").alias("term_id"), "term", "translation").filter("term <> '' AND translation <> ''")
    g = g.withColumns({"__t": C.fold("term"), "__x": C.fold("translation")}).withColumn("__key", F.substring("__t", 1, GRAM))
    texts = records.select("id", "source", F.coalesce("target", F.lit("")).alias("target")).filter("source <> ''").withColumn("__s", C.fold("source"))
    met = texts.withColumn("__key", F.explode(grams(F.col("__s")))).join(g, "__key").filter(F.contains("__s", F.col("__t")))

    @F.pandas_udf("boolean")
    def lacks(s: pd.Series, t: pd.Series, term: pd.Series, translation: pd.Series) -> pd.Series:
        return pd.Series([_lacks(*x, folded_edges) for x in zip(s, t, term, translation)], dtype=bool)

    return met.filter(lacks("source", "target", "__t", "__x")).select("id", "term_id", "term", "translation")


def _finder(terms: list[str]) -> Callable[[str], set[str]]:
    """Which of the terms a text holds."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {t for t in terms if t in text}
    if not terms:
        return lambda text: set()
    machine = ahocorasick.Automaton()
    for t in terms:
        machine.add_word(t, t)
    machine.make_automaton()
    return lambda text: {t for _, t in machine.iter(text)}


def check(records: DataFrame, glossary: DataFrame, number: bool = True, capitals: bool = True, glossary_terms: bool = True, folded_edges: bool = False) -> DataFrame:
    """id, type ('number', 'allcaps', 'glossary'), value, side, word, term, translation of all issues."""
    parts = []
    if number:
        parts.append(numbers(records).withColumn("type", F.lit("number")))
    if capitals:
        parts.append(capital_words(records, glossary).withColumn("type", F.lit("allcaps")))
    if glossary_terms:
        parts.append(terms(records, glossary, folded_edges).drop("term_id").withColumn("type", F.lit("glossary")))
    cols = ["id", "type", "value", "side", "word", "term", "translation"]
    text = lambda df: df.select("id", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols[1:]])
    if not parts:
        return text(records.select("id").limit(0).withColumn("type", F.lit("")))
    out = text(parts[0])
    for p in parts[1:]:
        out = out.unionByName(text(p))
    return out


def totals(issues: DataFrame) -> DataFrame:
    """type, flagged (records), issues."""
    return issues.groupBy("type").agg(F.count_distinct("id").alias("flagged"), F.count(F.lit(1)).alias("issues"))


def first_flagged(issues: DataFrame, k: int = 200) -> DataFrame:
    """The issues of the first ``k`` flagged records, for display."""
    ids = issues.select("id").distinct().orderBy("id").limit(k)
    return issues.join(ids, "id", "left_semi")
