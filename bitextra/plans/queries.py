"""Queries over the test tables, one or more for each operator, and the SQL that checks them.

Every query runs over its whole tables.  Searches ask for every record whose id is divisible by 50, against all
records.  Operators that SQL cannot express (word scores, substring distance, placement, differences) have no SQL;
they are tested against brute force and golden cases.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextra.functions import columns as C
from bitextra.operators import checks, lookup, placement, planner, timestamps
from bitextra.operators import replace as snr
from bitextra.operators import upsert as up
from bitextra.plans import sql
from bitextra.plans.tables import table
from bitextra.scratch import materialize, shared_dir
from bitextra.sources import datasource, tsv
from bitextra.streaming import lookups as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if check is not None:
            ORACLES[f.__name__] = check
        return f

    return add


def _asked(spark: SparkSession, d: str, column: str = "source") -> DataFrame:
    return table(spark, d, "records").filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col(column).alias("query"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sheet texts beside the record their target was taken from."""
    cells = table(spark, d, "cells").select("sheet_id", "row_num", "src", "record_id")
    r = table(spark, d, "records").select(F.col("id").alias("record_id"), "source", "target")
    return cells.join(r, "record_id").filter("src IS NOT NULL AND source IS NOT NULL")


_SQL_PAIRS = "(SELECT c.sheet_id, c.row_num, c.src, r.source, r.target FROM cells c JOIN records r ON c.record_id = r.id WHERE c.src IS NOT NULL AND r.source IS NOT NULL)"


@query()
def p4_found(spark, d):
    return timestamps.normalised_instants(table(spark, d, "records"), table(spark, d, "memories"), rewritten_only=True)


@query()
def p4_instants(spark, d):
    return timestamps.normalised_instants(table(spark, d, "records"), table(spark, d, "memories"))


_SLASH = r"""SELECT r.memory, '{0}' AS field, date_order AS declared, count(*) AS slash_dates, count(*) AS as_declared FROM records r JOIN memories m ON r.memory = m.memory
    WHERE date_order IN ('mdy', 'dmy') AND regexp_matches({0}, '^ *\d{{1,2}}/\d{{1,2}}/\d{{4}}( \d{{1,2}}:\d{{2}}(:\d{{2}})?)? *$') AND CAST(regexp_extract({0}, '(\d+)/(\d+)/', 1) AS INTEGER) BETWEEN 1 AND 12
    AND CAST(regexp_extract({0}, '(\d+)/(\d+)/', 2) AS INTEGER) BETWEEN 1 AND 12 AND CAST(regexp_extract({0}, '(\d+)/(\d+)/', 1) AS INTEGER) <> CAST(regexp_extract({0}, '(\d+)/(\d+)/', 2) AS INTEGER) GROUP BY ALL"""


@query(_SLASH.format("created") + " UNION ALL " + _SLASH.format("modified"))
def p4_withheld(spark, d):
    return timestamps.learned_orders(table(spark, d, "records"), table(spark, d, "memories"))


# text functions


@query(f"SELECT id, {sql.fold('source')} AS folded, CAST(length({sql.fold('source')}) AS INTEGER) AS n FROM records")
def nrm_fold(spark, d):
    return table(spark, d, "records").select("id", C.fold("source").alias("folded"), F.length(C.fold("source")).alias("n"))


@query(f"SELECT id, {sql.make_cmp('source')} AS source_form, {sql.make_cmp('target')} AS target_form, CAST(length({sql.make_cmp('source')}) AS INTEGER) AS n FROM records")
def nrm_cmp(spark, d):
    return table(spark, d, "records").select("id", C.make_cmp("source").alias("source_form"), C.make_cmp("target").alias("target_form"), F.length(C.make_cmp("source")).alias("n"))


@query(r"SELECT id, regexp_replace(source, '<[^>]+>', '', 'g') AS plain FROM records")
def nrm_strip_tags(spark, d):
    return table(spark, d, "records").select("id", C.strip_tags("source").alias("plain"))


@query()
def nrm_nfkc(spark, d):
    return table(spark, d, "records").select("id", C.make_cmp_nfkc("source").alias("form"), C.make_cmp_nfkc("source", case=False).alias("cased"), C.hira_to_kata(C.nfkc("target")).alias("wide"))


@query(
    r"""SELECT id, regexp_matches(source, '[\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}]') AS js,
        regexp_matches(source, '[\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]') AS gs,
        regexp_matches(source, '[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2A6DF}]') AS py FROM records"""
)
def prd_cjk(spark, d):
    return table(spark, d, "records").select("id", *[C.contains_cjk("source", k).alias(k) for k in ("js", "gs", "py")])


_TOKENS = r"regexp_extract_all(source, '[.,;:!?()\"''\[\]{}<>]|[^\s\x0B\x{85}\p{Z}.,;:!?()\"''\[\]{}<>]+')"


@query(f"SELECT id, array_to_string({_TOKENS}, '|') AS tokens, CAST(len({_TOKENS}) AS INTEGER) AS n FROM records WHERE source IS NOT NULL")
def tok_words(spark, d):
    return table(spark, d, "records").filter("source IS NOT NULL").select("id", F.array_join(C.tokens("source"), "|").alias("tokens"), F.size(C.tokens("source")).alias("n"))


@query(f"SELECT id, array_to_string(regexp_extract_all({sql.fold('source')}, '[0-9]+(?:[.,][0-9]+)*'), '|') AS numbers, array_to_string(regexp_extract_all(source, '[A-Z][A-Z0-9]+'), '|') AS words FROM records WHERE source IS NOT NULL")
def num_and_caps(spark, d):
    return table(spark, d, "records").filter("source IS NOT NULL").select("id", F.array_join(C.numbers("source"), "|").alias("numbers"), F.array_join(C.caps_words("source"), "|").alias("words"))


_TAGS = "SELECT id, lower(t) AS t FROM (SELECT id, unnest(regexp_extract_all({0}, '<([^>]+)>', 1)) AS t FROM records WHERE source IS NOT NULL AND target IS NOT NULL) WHERE NOT starts_with(t, '/')"


@query(
    f"""WITH s AS (SELECT id, t, count(*) AS n FROM ({_TAGS.format('source')}) GROUP BY ALL), t AS (SELECT id, t, count(*) AS n FROM ({_TAGS.format('target')}) GROUP BY ALL),
    j AS (SELECT coalesce(s.id, t.id) AS id, abs(coalesce(s.n, 0) - coalesce(t.n, 0)) AS off FROM s FULL JOIN t ON s.id = t.id AND s.t = t.t)
    SELECT r.id, coalesce(sum(off), 0)::DOUBLE / 100 AS penalty FROM records r LEFT JOIN j ON r.id = j.id WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY r.id"""
)
def tag_penalty(spark, d):
    return table(spark, d, "records").filter("source IS NOT NULL AND target IS NOT NULL").select("id", C.format_penalty("source", "target").alias("penalty"))


@query(
    """SELECT id, replace(replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
       source AS back FROM records"""
)
def xml_and_html(spark, d):
    return table(spark, d, "records").select("id", C.escape_html("source", True).alias("html"), C.decode_xml(C.encode_xml("source")).alias("back"))


@query(
    """WITH x AS (SELECT row_num, chr(CAST(65 + row_num % 26 AS INTEGER)) || row_num AS ref FROM cells)
    SELECT row_num, ref, left(ref, 1) AS col, row_num AS row, CAST(ascii(left(ref, 1)) - 64 AS INTEGER) AS number FROM x"""
)
def a1_references(spark, d):
    x = table(spark, d, "cells").select("row_num", F.concat(F.char(65 + F.col("row_num") % 26), F.col("row_num").cast("string")).alias("ref"))
    p = C.parse_a1("ref")
    return x.select("row_num", "ref", p["col"].alias("col"), p["row"].alias("row"), C.column_number(p["col"]).alias("number"))


# similarity


@query(f"SELECT sheet_id, row_num, CAST(levenshtein(a_code, b_code) AS INTEGER) AS distance, {sql.score('src', 'source')} AS score FROM {sql.coded(_SQL_PAIRS, 'src', 'source')}")
def sim_edit(spark, d):
    return _pairs(spark, d).select("sheet_id", "row_num", F.levenshtein("src", "source").alias("distance"), C.edit_score("src", "source").alias("score"))


_CHARS = "SELECT sheet_id, row_num, ch, count(*) AS n FROM (SELECT sheet_id, row_num, unnest(string_split({0}, '')) AS ch FROM " + _SQL_PAIRS + ") WHERE ch <> '' GROUP BY ALL"


@query(
    f"""WITH a AS ({_CHARS.format('src')}), b AS ({_CHARS.format('source')}),
    j AS (SELECT coalesce(a.sheet_id, b.sheet_id) AS sheet_id, coalesce(a.row_num, b.row_num) AS row_num, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.sheet_id = b.sheet_id AND a.row_num = b.row_num AND a.ch = b.ch),
    g AS (SELECT sheet_id, row_num, sum(abs(x - y)) AS bag, sum(least(x, y)) AS common FROM j GROUP BY ALL)
    SELECT p.sheet_id, p.row_num, CAST(coalesce(bag, 0) AS INTEGER) AS bag, CAST(greatest(length(src), length(source)) - coalesce(common, 0) AS INTEGER) AS bound FROM {_SQL_PAIRS} p LEFT JOIN g USING (sheet_id, row_num)"""
)
def sim_bag(spark, d):
    return _pairs(spark, d).select("sheet_id", "row_num", C.bag_distance("src", "source").alias("bag"), C.edit_lower_bound("src", "source").alias("bound"))


@query(
    f"""WITH a AS ({_CHARS.format('src')}), b AS ({_CHARS.format('source')}),
    j AS (SELECT coalesce(a.sheet_id, b.sheet_id) AS sheet_id, coalesce(a.row_num, b.row_num) AS row_num, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS off FROM a FULL JOIN b ON a.sheet_id = b.sheet_id AND a.row_num = b.row_num AND a.ch = b.ch),
    g AS (SELECT sheet_id, row_num, sum(off) AS bag FROM j GROUP BY ALL), p AS (SELECT *, greatest(length(src), length(source)) AS h FROM {_SQL_PAIRS})
    SELECT p.sheet_id, p.row_num, h = 0 OR (h - coalesce(bag, 0))::DOUBLE / h >= 0.7::DOUBLE AS passes FROM p LEFT JOIN g USING (sheet_id, row_num)"""
)
def fil_symmetric(spark, d):
    return _pairs(spark, d).select("sheet_id", "row_num", C.passes_symmetric_bag("src", "source", 0.7).alias("passes"))


@query()
def sim_words(spark, d):
    p = _pairs(spark, d).withColumns({c: C.make_cmp(c) for c in ("src", "source")})
    return p.select("sheet_id", "row_num", C.word_score("src", "source").alias("words"), C.fuzzy_score("src", "source", 0.5).alias("fuzzy"), C.substring_score("source", "src", 0.7).alias("inside"))


# lookups

_Q = f"(SELECT id AS query_id, {sql.make_cmp('source')} AS q FROM records WHERE id % 50 = 0)"


@query(
    f"""WITH q AS {_Q}, m AS (SELECT id, refcount, reliability, validated, {sql.make_cmp('source')} AS s FROM records),
    r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY refcount DESC NULLS LAST, reliability DESC NULLS LAST, validated DESC NULLS LAST, id) AS match_rank FROM q JOIN m ON q.q = m.s WHERE q.q <> '')
    SELECT query_id, match_rank, id FROM r WHERE match_rank <= 10"""
)
def lkp_exact(spark, d):
    return lookup.exact_lookup(_asked(spark, d), table(spark, d, "records")).select("query_id", "match_rank", "id")


def _fuzzy_sql(column: str, least: float, order: str, k: int, taken: str = "0") -> str:
    """Fuzzy lookup by characters of every 50th record; ``taken`` is taken off the score."""
    banded = f"""(SELECT q.query_id, q.q, q.raw, m.* FROM (SELECT id AS query_id, s AS q, raw_text AS raw FROM m WHERE id % 50 = 0 AND s <> '') q
        JOIN m ON least(length(q), length(s)) >= {least}::DOUBLE * greatest(length(q), length(s)))"""
    return f"""WITH m AS (SELECT id, refcount, reliability, validated, {column} AS raw_text, {sql.make_cmp(column)} AS s FROM records),
    p AS (SELECT *, {sql.score('q', 's')} AS plain FROM {sql.coded(banded, 'q', 's')}),
    t AS (SELECT *, plain - {taken} AS score FROM p WHERE plain >= {least}::DOUBLE),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC{order}, id) AS match_rank FROM t WHERE score >= {least}::DOUBLE)
    SELECT query_id, match_rank, id, score FROM r WHERE match_rank <= {k}"""


@query(_fuzzy_sql("source", 0.7, ", refcount DESC NULLS LAST, reliability DESC NULLS LAST, validated DESC NULLS LAST", 10))
def lkp_fuzzy_char(spark, d):
    return lookup.fuzzy_lookup(_asked(spark, d), table(spark, d, "records"), 0.7, "char", k=10, order=lookup.PY_ORDER).select("query_id", "match_rank", "id", "score")


@query(_fuzzy_sql("source", 0.9, ", refcount DESC NULLS LAST", 20))
def lkp_fuzzy_tight(spark, d):
    return lookup.fuzzy_lookup(_asked(spark, d), table(spark, d, "records"), 0.9, "char").select("query_id", "match_rank", "id", "score")


@query(_fuzzy_sql("target", 0.75, "", 20))
def lkp_reverse_char(spark, d):
    return lookup.reverse_lookup(_asked(spark, d, "target"), table(spark, d, "records"), 0.75, mode="char").select("query_id", "match_rank", "id", "score")


@query()
def lkp_fuzzy_auto(spark, d):
    return lookup.fuzzy_lookup(_asked(spark, d), table(spark, d, "records"), 0.7)


def _opening(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '<([^>]+)>', 1), lambda t: lower(t)), lambda t: NOT starts_with(t, '/'))"


_TAGS_OFF = "coalesce(list_sum(list_transform(list_distinct(list_concat({a}, {b})), lambda t: abs(len(list_filter({a}, lambda x: x = t)) - len(list_filter({b}, lambda x: x = t))))), 0)::DOUBLE / 100".format(a=_opening("raw"), b=_opening("raw_text"))


@query(_fuzzy_sql("source", 0.8, ", refcount DESC NULLS LAST", 20, _TAGS_OFF))
def lkp_fuzzy_penalty(spark, d):
    return lookup.fuzzy_lookup(_asked(spark, d), table(spark, d, "records"), 0.8, "char", penalty=True).select("query_id", "match_rank", "id", "score")


@query(_fuzzy_sql("target", 0.8, "", 20, _TAGS_OFF))
def lkp_reverse_penalty(spark, d):
    return lookup.reverse_lookup(_asked(spark, d, "target"), table(spark, d, "records"), 0.8, mode="char", penalty=True).select("query_id", "match_rank", "id", "score")


@query()
def lkp_reverse_auto(spark, d):
    return lookup.reverse_lookup(_asked(spark, d, "target"), table(spark, d, "records"), 0.8).select("query_id", "match_rank", "id", "score")


@query(
    f"""WITH q AS (SELECT query_id, length(q) AS n FROM {_Q}), s AS (SELECT length({sql.make_cmp('source')}) AS n FROM records WHERE source IS NOT NULL)
    SELECT query_id, CAST(coalesce(sum(CASE WHEN s.n BETWEEN floor(q.n * 0.7::DOUBLE) AND floor(q.n / 0.7::DOUBLE) + 1 THEN 1 END), 0) AS BIGINT) AS total_searched FROM q, s WHERE q.n IS NOT NULL GROUP BY query_id"""
)
def lkp_searched(spark, d):
    return lookup.searched(_asked(spark, d).filter("query IS NOT NULL"), table(spark, d, "records"), 0.7)


@query("SELECT id, CASE WHEN contains(lower(source), 'lantern') THEN 'source' ELSE 'target' END AS match_field FROM records WHERE contains(lower(source), 'lantern') OR contains(lower(target), 'lantern')")
def con_substring(spark, d):
    return lookup.concordance(table(spark, d, "records"), "Lantern", k=None).select("id", "match_field")


@query("SELECT id, CASE WHEN regexp_matches(source, '(?i)l[ae]ntern') THEN 'source' ELSE 'target' END AS match_field FROM records WHERE regexp_matches(source, '(?i)l[ae]ntern') OR regexp_matches(target, '(?i)l[ae]ntern') ORDER BY id LIMIT 50")
def con_regex(spark, d):
    return lookup.concordance(table(spark, d, "records"), "l[ae]ntern", regex=True).select("id", "match_field")


@query(r"SELECT id, 1.0::DOUBLE AS score FROM records WHERE contains(' ' || regexp_replace(lower(source), '[^\p{L}\p{N}\p{Co}]+', ' ', 'g') || ' ', ' waiting time ')")
def con_phrase(spark, d):
    return lookup.phrase_concordance(table(spark, d, "records"), "waiting time").select("id", "score")


_G = f"(SELECT id, term, translation, CASE WHEN coalesce(cmp, '') = '' THEN {sql.make_cmp('term')} ELSE cmp END AS t FROM glossary)"


@query(
    f"""WITH q AS {_Q}, h AS (SELECT query_id, g.id, term, length(term) AS n FROM q JOIN {_G} g ON contains(q, t) WHERE t <> '' AND q <> '')
    SELECT query_id, id, term, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) AS match_rank FROM h"""
)
def gls_contained(spark, d):
    return lookup.glossary_lookup(_asked(spark, d), table(spark, d, "glossary")).select("query_id", "id", "term", "match_rank")


@query(f"WITH q AS {_Q} SELECT query_id, g.id, term FROM q JOIN {_G} g ON contains(q, t) OR contains(t, q) WHERE t <> '' AND q <> ''")
def gls_bidirectional(spark, d):
    return lookup.glossary_hits(_asked(spark, d), table(spark, d, "glossary"), bidirectional=True).select("query_id", "id", "term")


_G_NEAR = f"""(SELECT q.query_id, q.q, g.id, g.term, g.translation, g.t FROM {_Q} q, {_G} g WHERE q <> '' AND t <> '')"""


@query(
    f"""WITH p AS (SELECT *, length(t) AS n, contains(q, t) AS inside FROM {_G_NEAR}),
    w AS (SELECT query_id, id, min(levenshtein(b_code, substring(a_code, CAST(i AS INTEGER), CAST(n + j AS INTEGER)))) AS d
        FROM {sql.coded('(SELECT * FROM p WHERE NOT inside AND n >= 10)', 'q', 't')}, unnest(range(1, length(q) + 1)) x(i), unnest(range(-CAST(floor(n / 10) AS INTEGER), CAST(floor(n / 10) AS INTEGER) + 1)) y(j) GROUP BY ALL),
    h AS (SELECT p.*, CASE WHEN inside THEN 1.0::DOUBLE ELSE (n - d)::DOUBLE / n END AS score FROM p LEFT JOIN w USING (query_id, id)),
    r AS (SELECT query_id, id, term, translation, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(term) DESC, id) AS match_rank FROM h WHERE score >= 0.9::DOUBLE)
    SELECT * FROM r WHERE match_rank <= 20"""
)
def gls_fuzzy(spark, d):
    return lookup.glossary_lookup(_asked(spark, d), table(spark, d, "glossary"), 0.9, k=20)


@query(f"WITH q AS (SELECT id AS query_id, source AS raw, {sql.make_cmp('source')} AS q FROM records WHERE id % 50 = 0) SELECT query_id, g.id, term FROM q JOIN {_G} g ON contains(q, t) WHERE t <> '' AND q <> '' AND contains(lower(raw), lower(term))")
def gls_visible(spark, d):
    q = _asked(spark, d)
    return lookup.visible_terms(q, lookup.glossary_hits(q, table(spark, d, "glossary"))).select("query_id", "id", "term")


@query("SELECT 'records' AS name, count(*) AS records, 'en' AS source_lang, 'N/A' AS target_lang FROM records")
def lkp_statistics(spark, d):
    return lookup.statistics(table(spark, d, "records"), "records", "en")


@query(
    f"""WITH q AS {_Q}, m AS (SELECT id, target, refcount, reliability, validated, {sql.make_cmp('source')} AS s FROM records),
    r AS (SELECT query_id, id, target, row_number() OVER (PARTITION BY query_id ORDER BY refcount DESC NULLS LAST, reliability DESC NULLS LAST, validated DESC NULLS LAST, id) AS k FROM q JOIN m ON q.q = m.s WHERE q.q <> '')
    SELECT query_id, target AS value, id AS record_id FROM r WHERE k = 1"""
)
def lkp_inserts(spark, d):
    return lookup.inserts(lookup.exact_lookup(_asked(spark, d), table(spark, d, "records")))


# filters


@query("SELECT id, source FROM records WHERE contains(lower(source), 'throne') OR contains(lower(target), 'throne') ORDER BY id LIMIT 100")
def fil_browse(spark, d):
    x = F.lit("throne")
    return table(spark, d, "records").filter(F.contains(F.lower("source"), x) | F.contains(F.lower("target"), x)).orderBy("id").limit(100).select("id", "source")


@query("SELECT sheet_id, row_num FROM cells c WHERE EXISTS (SELECT 1 FROM glossary g WHERE term <> '' AND contains(lower(c.src), lower(g.term)))")
def fil_term_rows(spark, d):
    return lookup.rows_with_terms(table(spark, d, "cells"), table(spark, d, "glossary"), "src", ["sheet_id", "row_num"])


@query(f"SELECT id, CAST(length({sql.make_cmp('source')}) AS INTEGER) AS n FROM records WHERE length({sql.make_cmp('source')}) BETWEEN floor(40 * 0.7::DOUBLE) AND floor(40 / 0.7::DOUBLE) + 1")
def fil_length_band(spark, d):
    n = F.length(C.make_cmp("source"))
    return table(spark, d, "records").select("id", n.alias("n")).filter(F.col("n").between(int(40 * 0.7), int(40 / 0.7) + 1))


@query("SELECT id, source, target FROM records WHERE NOT (lower(coalesce(source, '')) = 'source' AND lower(coalesce(target, '')) = 'target')")
def fil_headers(spark, d):
    head = (F.lower(F.coalesce("source", F.lit(""))) == "source") & (F.lower(F.coalesce("target", F.lit(""))) == "target")
    return table(spark, d, "records").filter(~head).select("id", "source", "target")


# changes


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").select((F.col("sheet_id") * 1_000_000 + F.col("row_num")).alias("seq"), F.col("src").alias("source"), F.col("tgt").alias("target"))


_MERGE = f"""WITH n AS (SELECT {sql.make_cmp('src')} AS a, {sql.make_cmp('tgt')} AS b, count(*) AS times FROM cells WHERE trim(src) <> '' AND trim(tgt) <> '' GROUP BY ALL),
    o AS (SELECT {sql.make_cmp('source')} AS a, {sql.make_cmp('target')} AS b, min(id) AS id FROM records GROUP BY ALL)"""


@query(_MERGE + " SELECT n.a AS source_cmp, n.b AS target_cmp, times, o.id, CASE WHEN o.id IS NULL THEN 'added' ELSE 'refcount' END AS action FROM n LEFT JOIN o ON n.a = o.a AND n.b = o.b")
def ups_pairs(spark, d):
    return up.merged_pairs(table(spark, d, "records"), _incoming(spark, d)).select("source_cmp", "target_cmp", "times", "id", "action")


@query(_MERGE + " SELECT CAST(count(*) FILTER (o.id IS NULL) AS BIGINT) AS added, CAST(coalesce(sum(times), 0) - count(*) FILTER (o.id IS NULL) AS BIGINT) AS updated, CAST(coalesce(sum(times), 0) AS BIGINT) AS total FROM n LEFT JOIN o ON n.a = o.a AND n.b = o.b")
def ups_tallies(spark, d):
    return up.tallies(up.merged_pairs(table(spark, d, "records"), _incoming(spark, d)))


@query(
    _MERGE + f""", h AS (SELECT o.id, times FROM n JOIN o ON n.a = o.a AND n.b = o.b)
    SELECT {sql.make_cmp('r.source')} AS a, {sql.make_cmp('r.target')} AS b, CAST(CASE WHEN times IS NULL THEN refcount ELSE coalesce(refcount, 0) + times END AS INTEGER) AS refcount FROM records r LEFT JOIN h ON r.id = h.id
    UNION ALL SELECT n.a, n.b, CAST(times - 1 AS INTEGER) FROM n LEFT JOIN o ON n.a = o.a AND n.b = o.b WHERE o.id IS NULL"""
)
def ups_merged(spark, d):
    r = table(spark, d, "records").select("id", "source", "target", "refcount")
    return up.upsert(r, _incoming(spark, d)).select(C.make_cmp("source").alias("a"), C.make_cmp("target").alias("b"), F.col("refcount").cast("int").alias("refcount"))


@query("SELECT m.top + row_number() OVER (ORDER BY sheet_id, row_num) AS id FROM cells, (SELECT max(id) AS top FROM records) m UNION ALL SELECT id FROM records")
def ups_append(spark, d):
    r = table(spark, d, "records").select("id", "source", "target", "source_cmp", "source_len")
    return up.append(r, _incoming(spark, d).drop("seq")).select("id")


@query(f"SELECT id, CASE WHEN id % 7 = 0 THEN 'changed <b>x</b>' ELSE source END AS source, CASE WHEN id % 7 = 0 THEN 'changed x' ELSE source_cmp END AS source_cmp FROM records")
def ups_update(spark, d):
    r = table(spark, d, "records").select("id", "source", "target", "source_cmp")
    return up.update(r, r.filter("id % 7 = 0").select("id", F.lit("changed <b>x</b>").alias("source"))).select("id", "source", "source_cmp")


@query("SELECT id FROM records WHERE id NOT IN (SELECT record_id FROM cells WHERE record_id IS NOT NULL)")
def ups_delete(spark, d):
    return up.delete(table(spark, d, "records"), table(spark, d, "cells").filter("record_id IS NOT NULL").select(F.col("record_id").alias("id"))).select("id")


_TERM_KEYS = sql.make_cmp("term") + " AS a, " + sql.make_cmp("coalesce(translation, '')") + " AS b"


@query(
    f"""WITH old AS (SELECT DISTINCT {_TERM_KEYS} FROM glossary), new AS (SELECT DISTINCT {_TERM_KEYS} FROM (SELECT term, translation FROM glossary UNION ALL SELECT src, tgt FROM cells) x(term, translation) WHERE trim(term) <> '')
    SELECT n.a, n.b, CASE WHEN o.a IS NULL THEN 'added' ELSE 'exists' END AS action FROM new n LEFT JOIN old o ON n.a = o.a AND n.b = o.b"""
)
def ups_terms(spark, d):
    g = table(spark, d, "glossary")
    new = table(spark, d, "cells").select((F.col("sheet_id") * 1_000_000 + F.col("row_num")).alias("seq"), F.col("src").alias("term"), F.col("tgt").alias("translation"))
    new = g.select(F.col("id").alias("seq"), "term", "translation").unionByName(new)
    return up.add_terms(g, new).select(F.col("cmp").alias("a"), F.col("translation_cmp").alias("b"), "action")


@query(f"SELECT id, CASE WHEN id % 7 = 0 THEN 'New <i>Term</i>' ELSE term END AS term, CASE WHEN id % 7 = 0 THEN 'new term' ELSE cmp END AS cmp, CASE WHEN id % 7 = 0 THEN {sql.make_cmp('translation')} ELSE translation_cmp END AS translation_cmp FROM glossary")
def ups_edit_terms(spark, d):
    g = table(spark, d, "glossary").select("id", "term", "translation", "cmp", "translation_cmp")
    return up.update(g, g.filter("id % 7 = 0").select("id", F.lit("New <i>Term</i>").alias("term"))).select("id", "term", "cmp", "translation_cmp")


@query(f"SELECT t AS cmp, id, term, translation FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY id) AS k FROM {_G} WHERE term <> '') WHERE k = 1")
def gls_first(spark, d):
    return up.first_by_form(table(spark, d, "glossary"))


@query("SELECT rule_id, source_pattern <> '[unclosed' AS valid, rule_id > min(rule_id) OVER (PARTITION BY source_pattern, target_template) AS repeat FROM rules")
def ups_rules(spark, d):
    return up.valid_rules(table(spark, d, "rules")).select("rule_id", "valid", "repeat")


@query("SELECT memory, count(*) AS records FROM records GROUP BY memory")
def agg_counts(spark, d):
    return table(spark, d, "records").groupBy("memory").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT memory, kind, count(*) AS lookups, count(record_id) AS hits, CAST(round(sum(score * 10000)) AS BIGINT) AS score_sum FROM (SELECT DISTINCT lookup_id, memory, kind, record_id, score, looked_at FROM lookups) GROUP BY ALL")
def agg_lookups(spark, d):
    once = table(spark, d, "lookups").select("lookup_id", "memory", "kind", "record_id", "score", "looked_at").distinct()
    return once.groupBy("memory", "kind").agg(F.count(F.lit(1)).alias("lookups"), F.count("record_id").alias("hits"), F.round(F.sum(F.col("score") * 10000)).cast("bigint").alias("score_sum"))


@query("SELECT a.sheet_id, a.row_num, a.src, b.tgt FROM cells a JOIN cells b ON a.sheet_id = b.sheet_id AND a.row_num = b.row_num WHERE trim(a.src) <> '' AND trim(b.tgt) <> ''")
def joi_cells(spark, d):
    c = table(spark, d, "cells")
    s, t = c.select("sheet_id", "row_num", "src"), c.select("sheet_id", "row_num", "tgt")
    return s.join(t, ["sheet_id", "row_num"]).filter("trim(src) <> '' AND trim(tgt) <> ''")


# checks

def _nums(column: str) -> str:
    return "SELECT id, value, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(" + sql.fold(f"coalesce({column}, '')") + ", '[0-9]+(?:[.,][0-9]+)*')) AS value FROM records) GROUP BY ALL"


_QC_NUMBERS = f"""SELECT id, value, side FROM (SELECT coalesce(s.id, t.id) AS id, coalesce(s.value, t.value) AS value, CASE WHEN coalesce(s.n, 0) > coalesce(t.n, 0) THEN 'target' ELSE 'source' END AS side,
    abs(coalesce(s.n, 0) - coalesce(t.n, 0)) AS times FROM ({_nums('source')}) s FULL JOIN ({_nums('target')}) t ON s.id = t.id AND s.value = t.value) x, range(1000) k WHERE k.range < times"""


@query(_QC_NUMBERS)
def qc_numbers(spark, d):
    return checks.numbers(table(spark, d, "records"))


_QC_CAPS = f"""SELECT id, word FROM (SELECT id, coalesce(target, '') AS t, unnest(regexp_extract_all(source, '[A-Z][A-Z0-9]+')) AS word FROM records WHERE source IS NOT NULL)
    WHERE NOT contains(t, word) AND {sql.fold('word')} NOT IN (SELECT {sql.fold('term')} FROM glossary WHERE term <> '')"""


@query(_QC_CAPS)
def qc_capitals(spark, d):
    return checks.capital_words(table(spark, d, "records"), table(spark, d, "glossary"))


_QC_TERMS = f"""SELECT r.id, g.id AS term_id, term, translation FROM (SELECT id, {sql.fold('source')} AS s, {sql.fold("coalesce(target, '')")} AS t FROM records) r
    JOIN (SELECT id, term, translation, {sql.fold('term')} AS tf, {sql.bounded(sql.fold('term'))} AS tp, {sql.bounded(sql.fold('translation'))} AS xp FROM glossary WHERE term <> '' AND translation <> '') g
    ON contains(s, tf) AND regexp_matches(s, tp) WHERE s <> '' AND NOT regexp_matches(t, xp)"""


@query(_QC_TERMS)
def qc_terms(spark, d):
    return checks.terms(table(spark, d, "records"), table(spark, d, "glossary"), folded_edges=True)


@query(
    f"""WITH n AS ({_QC_NUMBERS}), c AS ({_QC_CAPS}), t AS ({_QC_TERMS}), u AS (SELECT id, 'number' AS type FROM n UNION ALL SELECT id, 'allcaps' FROM c UNION ALL SELECT id, 'glossary' FROM t)
    SELECT type, count(DISTINCT id) AS flagged, count(*) AS issues FROM u GROUP BY type"""
)
def qc_totals(spark, d):
    return checks.totals(checks.check(table(spark, d, "records"), table(spark, d, "glossary"), folded_edges=True))


# find and replace


@query(f"SELECT id, CASE WHEN contains({sql.fold('source')}, 'anvil') THEN 'source' WHEN contains({sql.fold('target')}, 'anvil') THEN 'target' WHEN contains({sql.fold('context')}, 'anvil') THEN 'context' END AS match_field FROM records WHERE match_field IS NOT NULL")
def snr_find(spark, d):
    return snr.find(table(spark, d, "records").select("id", "source", "target", "context", F.lit("").alias("created_by"), F.lit("").alias("modified_by")), "Anvil").select("id", "match_field")


@query(r"SELECT id, 'source' AS match_field FROM records WHERE regexp_matches(source, '(?i)after [0-9]+ failed')")
def snr_find_regex(spark, d):
    empty = [F.lit(None).cast("string").alias(c) for c in ("target", "context", "created_by", "modified_by")]
    return snr.find(table(spark, d, "records").select("id", "source", *empty), "regex:after [0-9]+ failed").select("id", "match_field")


@query("SELECT id, 'reliability' AS match_field FROM records WHERE contains(CAST(reliability AS VARCHAR), '7')")
def snr_find_field(spark, d):
    return snr.find(table(spark, d, "records"), "reliability:7").select("id", "match_field")


@query(r"SELECT id, regexp_replace(source, '([0-9]+) (seconds|days)', '\2 \1', 'gi') AS source, regexp_matches(source, '(?i)[0-9]+ (seconds|days)') AS changed FROM records WHERE source IS NOT NULL")
def snr_replace_regex(spark, d):
    r = table(spark, d, "records").filter("source IS NOT NULL").select("id", "source")
    return snr.replace(r, "regex:([0-9]+) (seconds|days)", "$2 $1")


@query("SELECT id, CASE WHEN reliability = 5 THEN 0 ELSE reliability END AS reliability, coalesce(reliability = 5, false) AS changed FROM records")
def snr_replace_number(spark, d):
    return snr.replace(table(spark, d, "records").select("id", "reliability"), "reliability:5", "0")


@query("SELECT id, 'Ryan' AS created_by, true AS changed FROM records")
def snr_overwrite(spark, d):
    return snr.replace(table(spark, d, "records").select("id", "created_by"), "created-by:*", "Ryan")


_LANTERN = "".join(f"[{c}{c.upper()}{chr(ord(c) + 0xFEE0)}{chr(ord(c.upper()) + 0xFEE0)}]" for c in "lantern")


@query(
    f"""WITH r AS (SELECT id, source AS s, target AS t, regexp_replace(source, '{_LANTERN}', 'lamp', 'g') AS source, regexp_replace(target, '{_LANTERN}', 'lamp', 'g') AS target FROM records)
    SELECT id, source, target, {sql.make_cmp('source')} AS source_cmp, coalesce(s <> source, false) OR coalesce(t <> target, false) AS changed FROM r"""
)
def snr_replace_text(spark, d):
    return snr.replace(table(spark, d, "records").select("id", "source", "target", "source_cmp"), "lantern", "lamp")


@query("SELECT count(*) FILTER (reliability = 5) AS changed, count(*) AS scanned_fields FROM records")
def snr_counts(spark, d):
    return snr.replaced_counts(snr.replace(table(spark, d, "records").select("id", "reliability"), "reliability:5", "0"))


# placement, differences, rendering


def _best(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict], list[dict]]:
    """The sheet texts and the records their targets were taken from, as pairs to place."""
    pairs = _pairs(spark, d).filter("target IS NOT NULL").select("sheet_id", "row_num", F.col("src").alias("query"), F.col("source").alias("tm_source"), F.col("target").alias("tm_target"))
    return pairs, placement.terms_of(table(spark, d, "glossary")), placement.rules_of(table(spark, d, "rules"))


@query()
def plc_resolve(spark, d):
    pairs, terms, rules = _best(spark, d)
    return placement.resolve(pairs, terms, rules)


@query()
def plc_terms(spark, d):
    pairs, terms, _ = _best(spark, d)
    return placement.place_terms(pairs, terms)


@query()
def plc_numbers(spark, d):
    pairs, terms, _ = _best(spark, d)
    return placement.place_numbers(pairs, terms)


@query()
def plc_numbers_strict(spark, d):
    return placement.place_numbers(_best(spark, d)[0], strict=True)


@query()
def plc_rules(spark, d):
    pairs, _, rules = _best(spark, d)
    return placement.place_rules(pairs, rules)


@query()
def dif_lexical(spark, d):
    pairs, terms, _ = _best(spark, d)
    return placement.lexical_diffs(pairs, terms)


@query()
def dif_regions(spark, d):
    pairs, terms, rules = _best(spark, d)
    return placement.changed_regions(placement.resolve(pairs, terms, rules).select("sheet_id", "row_num", F.col("tm_target").alias("original"), F.col("target").alias("placed")))


@query()
def dif_highlight(spark, d):
    pairs, terms, _ = _best(spark, d)
    return placement.highlight(pairs, terms)


@query()
def mrk_terms(spark, d):
    terms = placement.terms_of(table(spark, d, "glossary"))
    return placement.mark_terms(table(spark, d, "cells").select("sheet_id", "row_num", F.col("src").alias("text")), terms)


@query()
def mrk_query(spark, d):
    pairs, terms, _ = _best(spark, d)
    return placement.render_query(pairs, terms)


# plans


def _statuses(spark: SparkSession, d: str, overwrite: bool) -> DataFrame:
    terms, rules = placement.terms_of(table(spark, d, "glossary")), placement.rules_of(table(spark, d, "rules"))
    cells = table(spark, d, "cells").select("sheet_id", "row_num", "src", "tgt")
    return materialize(planner.statuses(cells, table(spark, d, "records"), terms, rules, 0.8, overwrite), "statuses")


@query()
def pln_selection(spark, d):
    return planner.selection_plan(_statuses(spark, d, False))


@query()
def pln_walk(spark, d):
    return planner.walk_stops(_statuses(spark, d, True), 2)


@query()
def pln_actions(spark, d):
    s = _statuses(spark, d, True)
    plan = planner.walk_plan(s, 2)
    return planner.actions(plan).join(planner.landing_rows(plan, planner.walk_stops(s, 2), 2), "sheet_id")


def _trimmed(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{sql.BLANKS}|{sql.BLANKS}$', '', 'g')"


_EXACT_PLAN = f"""WITH c AS (SELECT sheet_id, row_num, {_trimmed('src')} AS s, {_trimmed('tgt')} AS t FROM cells),
    m AS (SELECT f, target, row_number() OVER (PARTITION BY f ORDER BY refcount DESC NULLS LAST, id) AS k FROM (SELECT *, {sql.make_cmp('source')} AS f FROM records) WHERE f <> ''),
    j AS (SELECT c.*, m.f IS NOT NULL AS met, m.target FROM c LEFT JOIN m ON {sql.make_cmp('c.s')} = m.f AND m.k = 1)"""


@query(
    _EXACT_PLAN + """ SELECT sheet_id, row_num, CASE WHEN s = '' THEN 'empty_source' WHEN t <> '' THEN 'filled' WHEN met THEN 'exact' ELSE 'no_match' END AS status,
    CASE WHEN s <> '' AND t = '' AND met THEN coalesce(target, '') END AS value, s <> '' AND t = '' AND met AS written FROM j"""
)
def pln_exact(spark, d):
    cells = table(spark, d, "cells").select("sheet_id", "row_num", "src", "tgt")
    return planner.selection_plan(planner.statuses(cells, table(spark, d, "records"), [], [], 1.0)).select("sheet_id", "row_num", "status", "value", "written")


@query(
    _EXACT_PLAN + """ SELECT sheet_id, min(row_num) FILTER (s = '' OR NOT met) AS stop_row, coalesce(arg_min(CASE WHEN s = '' THEN 'empty_source' ELSE 'no_match' END, row_num) FILTER (s = '' OR NOT met), 'end_of_batch') AS stop_reason
    FROM j WHERE row_num >= 2 GROUP BY sheet_id"""
)
def pln_exact_walk(spark, d):
    cells = table(spark, d, "cells").select("sheet_id", "row_num", "src", "tgt")
    return planner.walk_stops(planner.statuses(cells, table(spark, d, "records"), [], [], 1.0, True), 2).select("sheet_id", "stop_row", "stop_reason")


# exchange formats: written and read again


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, which for these formats must be a mounted file system."""
    base = shared_dir(spark)
    base = base[7:] if base.startswith("file://") else base[5:] if base.startswith("file:") else base
    if "://" in base:
        raise ValueError(f"exchange formats need a mounted folder, not {base}")
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix=f"{name}-", dir=base)


_BOTH = "source IS NOT NULL AND target IS NOT NULL AND source <> '' AND target <> ''"


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").filter(_BOTH).select("source", "target", "context", "refcount", "created_by")


@query(f"SELECT source, target, coalesce(context, '') AS context, CAST(coalesce(refcount, 0) AS INTEGER) AS refcount, coalesce(created_by, '') AS created_by FROM records WHERE {_BOTH}")
def io_tmx(spark, d):
    to = _folder(spark, "tmx")
    datasource.write_memory(_whole(spark, d), to, "tmx")
    return datasource.read_memory(spark, to, "tmx", sourceLang="en", targetLang="ja").select("source", "target", "context", "refcount", "created_by")


@query(f"SELECT source, target FROM records WHERE {_BOTH}")
def io_xliff(spark, d):
    to = _folder(spark, "xliff")
    datasource.write_memory(_whole(spark, d), to, "xliff", version="2.0")
    return datasource.read_memory(spark, to, "xliff").select("source", "target")


@query(rf"SELECT regexp_replace(source, '^{sql.BLANKS}|{sql.BLANKS}$', '', 'g') AS source, regexp_replace(target, '^{sql.BLANKS}|{sql.BLANKS}$', '', 'g') AS target FROM records WHERE {_BOTH} AND regexp_matches(source || target, '[^\s\x0B\x{{85}}\p{{Z}}]')")
def io_xlsx(spark, d):
    to = _folder(spark, "xlsx")
    datasource.write_memory(_whole(spark, d), to, "xlsx")
    return datasource.read_memory(spark, to, "xlsx").select("source", "target")


@query(rf"SELECT regexp_replace(source, '^{sql.BLANKS}|{sql.BLANKS}$', '', 'g') AS source, regexp_replace(target, '^{sql.BLANKS}|{sql.BLANKS}$', '', 'g') AS target FROM records WHERE {_BOTH} AND regexp_matches(source || target, '[^\s\x0B\x{{85}}\p{{Z}}]')")
def io_tsv(spark, d):
    to = _folder(spark, "tsv") + "/out"
    tsv.write_tsv(_whole(spark, d), f"file://{to}")
    return tsv.read_tsv(spark, f"file://{to}")


@query(rf"SELECT regexp_replace(source, '^{sql.BLANKS}|{sql.BLANKS}$', '', 'g') AS source, regexp_replace(target, '^{sql.BLANKS}|{sql.BLANKS}$', '', 'g') AS target FROM records WHERE {_BOTH} AND regexp_matches(source, '[^\s\x0B\x{{85}}\p{{Z}}]') AND regexp_matches(target, '[^\s\x0B\x{{85}}\p{{Z}}]')")
def io_tsv_pairs(spark, d):
    to = _folder(spark, "pairs") + "/out"
    tsv.write_tsv(_whole(spark, d), f"file://{to}")
    return tsv.read_pairs(spark, f"file://{to}")


@query("SELECT coalesce(term, '') AS term, coalesce(translation, '') AS translation, coalesce(notes, '') AS notes FROM glossary")
def io_glossary_sheet(spark, d):
    to = "file://" + _folder(spark, "sheet") + "/out"
    tsv.write_glossary_sheet(table(spark, d, "glossary"), to)
    back = spark.read.options(sep="\t", quote='"', escape='"', multiLine=True, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(to)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c.lower()) for c in ("Term", "Translation", "Notes")])


# streams


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    to = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"
    q = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", f"{to}-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(to)


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # the folder is watched, the pattern picks the table
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


@query(f"SELECT c.sheet_id * 1000000 + c.row_num AS query_id, r.id FROM cells c JOIN records r ON {sql.make_cmp('c.src')} = {sql.make_cmp('r.source')} WHERE {sql.make_cmp('c.src')} <> ''")
def str_exact(spark, d):
    q = _stream(spark, d, "cells").select((F.col("sheet_id") * 1_000_000 + F.col("row_num")).alias("query_id"), F.col("src").alias("query"))
    return _drained(streams.exact_stream(q, table(spark, d, "records")).select("query_id", "id"), "exact")


@query("SELECT DISTINCT lookup_id FROM lookups")
def str_once(spark, d):
    once = streams.deduplicated(_stream(spark, d, "lookups").select("lookup_id", F.col("looked_at").cast("timestamp").alias("looked_at")), "lookup_id", "looked_at", "3650 days")
    return _drained(once.select("lookup_id"), "once")


def _cell_queries(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, "cells").select((F.col("sheet_id") * 1_000_000 + F.col("row_num")).alias("query_id"), F.col("src").alias("query"))


@query(
    f"""WITH q AS (SELECT sheet_id * 1000000 + row_num AS query_id, {sql.make_cmp('src')} AS q FROM cells), m AS (SELECT id, refcount, {sql.make_cmp('source')} AS s FROM records),
    r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY refcount DESC NULLS LAST, id) AS match_rank FROM q JOIN m ON q.q = m.s WHERE q.q <> '')
    SELECT query_id, match_rank, id FROM r WHERE match_rank <= 20"""
)
def str_lookups(spark, d):
    to = f"{shared_dir(spark)}/stream-lookups-{uuid.uuid4().hex[:12]}"
    sink = lambda df, epoch: df.select("query_id", "match_rank", "id").write.mode("overwrite").parquet(f"{to}/epoch={epoch}")
    streams.lookup_stream(_cell_queries(spark, d), lambda: table(spark, d, "records"), sink, f"{to}-state", 1.0).awaitTermination()
    return spark.read.schema("query_id bigint, match_rank bigint, id bigint").parquet(f"{to}/epoch=*")


@query(ORACLES["ups_merged"])
def str_merged(spark, d):
    to = f"{shared_dir(spark)}/stream-merged-{uuid.uuid4().hex[:12]}"
    latest = [table(spark, d, "records").select("id", "source", "target", "refcount")]

    def save(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{to}/{epoch}")
        latest[0] = spark.read.schema(df.schema).parquet(f"{to}/{epoch}")

    pairs = _stream(spark, d, "cells").select((F.col("sheet_id") * 1_000_000 + F.col("row_num")).alias("seq"), F.col("src").alias("source"), F.col("tgt").alias("target"))
    streams.upsert_stream(pairs, lambda: latest[0], save, f"{to}-state").awaitTermination()
    return latest[0].select(C.make_cmp("source").alias("a"), C.make_cmp("target").alias("b"), F.col("refcount").cast("int").alias("refcount"))


@query("SELECT sheet_id AS batch_id, 'B' || row_num AS range, tgt AS value FROM cells WHERE sheet_id IN (SELECT DISTINCT sheet_id FROM cells ORDER BY sheet_id DESC LIMIT 50)")
def str_undo(spark, d):
    done = table(spark, d, "cells").select(F.col("sheet_id").alias("batch_id"), F.concat(F.lit("B"), F.col("row_num").cast("string")).alias("range"), F.col("src").alias("value"), F.col("tgt").alias("old_value"))
    return streams.undo_entries(done)


@query(f"SELECT {sql.make_cmp('src')} AS source_cmp, {sql.make_cmp('tgt')} AS target_cmp, CAST(count(*) - 1 AS BIGINT) AS refcount FROM cells WHERE {sql.make_cmp('src')} <> '' AND {sql.make_cmp('tgt')} <> '' GROUP BY ALL")
def str_counts(spark, d):
    to = f"{shared_dir(spark)}/stream-counts-{uuid.uuid4().hex[:12]}"
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    was = spark.conf.get(name)
    spark.conf.set(name, rocks)
    try:
        counts = streams.counted_pairs(_stream(spark, d, "cells").select(F.col("src").alias("source"), F.col("tgt").alias("target")))
        sink = lambda df, epoch: df.write.mode("overwrite").parquet(f"{to}/epoch={epoch}")
        counts.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{to}-state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, was)
    return spark.read.schema(counts.schema).parquet(f"{to}/epoch=*")
