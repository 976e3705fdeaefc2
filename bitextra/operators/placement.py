"""Placement and difference kernels over tables: one Arrow pass a row set, with the glossary and rules in the closure.

Glossaries and rules are driver-side lists here; ``terms_of`` and ``rules_of`` read them behind a check of their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextra.functions import alignment as al
from bitextra.functions import placing as pl

#: most rows of a glossary or rule table that may travel with the tasks
SMALL = 200_000
DIFF = "struct<q_text:string,s_text:string,q_start:int,q_end:int,s_start:int,s_end:int,q_registered:boolean,s_registered:boolean>"
RESOLVED = f"target string, covered boolean, placements array<string>, uncovered array<{DIFF}>"


def _rows(df: DataFrame, what: str) -> list[dict]:
    rows = df.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"{what} of more than {SMALL} rows do not travel with the tasks")
    return [r.asDict() for r in rows]


def terms_of(glossary: DataFrame) -> list[dict]:
    """term, translation, cmp in order of id; entries without a term are left out."""
    g = glossary.select("id", "term", "translation", "cmp").filter("term IS NOT NULL AND term <> ''").orderBy("id")
    return [{k: r[k] for k in ("term", "translation", "cmp")} for r in _rows(g, "glossaries")]


def rules_of(rules: DataFrame) -> list[dict]:
    return _rows(rules.select("rule_id", "source_pattern", "target_template", "enabled").orderBy("rule_id"), "rules")


def _diff(d: al.Diff) -> tuple:
    return (d.q_text, d.s_text, d.q_start, d.q_end, d.s_start, d.s_end, d.q_registered, d.s_registered)


def _map(df: DataFrame, need: list[str], schema: str, f) -> DataFrame:
    """Append the columns of ``schema``, made from the values of ``need``; rows with a null among them get nulls.

    Columns of the input that have the name of a new one are replaced.
    """
    names = [c.split()[0] for c in schema.split(", ")] if "<" not in schema else [c.strip().split(" ")[0] for c in _top(schema)]
    kept = [c for c in df.columns if c not in names or c in need]
    plain = df.select(*kept)
    clash = {c: f"__in_{c}" for c in kept if c in names}
    for a, b in clash.items():
        plain = plain.withColumnRenamed(a, b)
    args = [clash.get(c, c) for c in need]
    out_schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in plain.schema] + [schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [f(*v) if all(isinstance(x, str) for x in v) else (None,) * len(names) for v in zip(*(b[a] for a in args))]
            for k, n in enumerate(names):
                b[n] = pd.Series([m[k] for m in made], dtype=object, index=b.index)
            yield b

    return plain.mapInPandas(run, out_schema).drop(*clash.values())


def _top(schema: str) -> list[str]:
    """Split a schema at its outermost commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def resolve(pairs: DataFrame, terms: list[dict], rules: list[dict]) -> DataFrame:
    """query, tm_source, tm_target -> target, covered, placements, uncovered."""
    def run(q: str, s: str, t: str) -> tuple:
        r = pl.resolve(q, s, t, _glossary(terms), _rules(rules))
        return r.target, r.covered, list(r.placements), [_diff(d) for d in r.uncovered]

    return _map(pairs, ["query", "tm_source", "tm_target"], RESOLVED, run)


_BUILT: dict[int, tuple] = {}


def _built(key: list, make) -> object:
    """Built once for a list that travelled with a task."""
    got = _BUILT.get(id(key))
    if got is None or got[0] is not key:
        if len(_BUILT) > 8:
            _BUILT.clear()
        got = _BUILT[id(key)] = (key, make(key))
    return got[1]


def _glossary(terms: list[dict]) -> al.Glossary:
    return _built(terms, al.Glossary)


def _rules(rules: list[dict]) -> list:
    return _built(rules, pl.compile_rules)


def place_terms(pairs: DataFrame, terms: list[dict]) -> DataFrame:
    """query, tm_source, tm_target -> placed, placed_target, placed_from, placed_to."""
    def run(q: str, s: str, t: str) -> tuple:
        got = pl.place_term(q, s, t, _glossary(terms))
        return (True, *got) if got else (False, t, None, None)

    return _map(pairs, ["query", "tm_source", "tm_target"], "placed boolean, placed_target string, placed_from string, placed_to string", run)


def place_numbers(pairs: DataFrame, terms: list[dict] = (), strict: bool = False) -> DataFrame:
    """query, tm_source, tm_target -> placed, placed_target."""
    terms = list(terms)

    def run(q: str, s: str, t: str) -> tuple:
        got = pl.place_numbers_strict(q, s, t) if strict else pl.place_numbers(q, s, t, _glossary(terms))
        return got is not None, t if got is None else got

    return _map(pairs, ["query", "tm_source", "tm_target"], "placed boolean, placed_target string", run)


def place_rules(pairs: DataFrame, rules: list[dict]) -> DataFrame:
    """query, tm_source, tm_target -> placed, placed_target."""
    def run(q: str, s: str, t: str) -> tuple:
        got = pl.place_rules(q, s, t, _rules(rules))
        return got is not None, t if got is None else got

    return _map(pairs, ["query", "tm_source", "tm_target"], "placed boolean, placed_target string", run)


def lexical_diffs(pairs: DataFrame, terms: list[dict] = ()) -> DataFrame:
    """query, tm_source -> diffs, from right to left."""
    terms = list(terms)
    return _map(pairs, ["query", "tm_source"], f"diffs array<{DIFF}>", lambda q, s: ([_diff(d) for d in al.lexical_diffs(q, s, _glossary(terms))],))


def changed_regions(pairs: DataFrame) -> DataFrame:
    """original, placed -> changed, uncertain (arrays of idx, len) and runs (start, style)."""
    span = "array<struct<idx:int,len:int>>"

    def run(a: str, b: str) -> tuple:
        changed = al.changed_regions(a, b)
        rest = al.uncertain_regions(changed, len(b))
        runs = al.format_runs(b, [(x, x + n) for x, n in changed], [(x, x + n) for x, n in rest])
        return changed, rest, runs

    return _map(pairs, ["original", "placed"], f"changed {span}, uncertain {span}, runs array<struct<start:int,style:string>>", run)


def highlight(pairs: DataFrame, terms: list[dict] = ()) -> DataFrame:
    """query, tm_source -> query_html, source_html, with terms marked in the query."""
    terms = list(terms)
    return _map(pairs, ["query", "tm_source"], "query_html string, source_html string", lambda q, s: al.highlight(q, s, terms))


def mark_terms(texts: DataFrame, terms: list[dict]) -> DataFrame:
    """text -> html with all terms of the list marked (null without any) and regions (start, end, translation)."""
    span = "array<struct<start:int,end:int,translation:string>>"
    longest = sorted((t for t in terms if t.get("term")), key=lambda t: -len(t["term"]))
    return _map(texts, ["text"], f"html string, regions {span}", lambda t: (al.mark_terms(t, longest), al.term_regions(t, longest)))


def render_query(pairs: DataFrame, terms: list[dict]) -> DataFrame:
    """query, tm_source -> query_layers and source_marks: HTML of both with what stays unresolved."""
    def run(q: str, s: str) -> tuple:
        diffs = al.lexical_diffs(q, s, _glossary(terms))
        return al.render_query(q, terms, diffs), al.mark_uncovered(s, diffs, "s")

    return _map(pairs, ["query", "tm_source"], "query_layers string, source_marks string", run)


def pairs_with_best(queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, query, tm_source, tm_target, score of the best match of each query."""
    best = found.filter("match_rank = 1").select("query_id", "score", F.col("source").alias("tm_source"), F.col("target").alias("tm_target"), F.col("id").alias("record_id"))
    return queries.select("query_id", "query").join(best, "query_id")
