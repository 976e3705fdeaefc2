"""Golden cases as queries: the operators over small literal tables, and the rows they must give as SQL VALUES.

They stand beside the queries over whole tables, for operators whose results SQL cannot compute.  Inputs and results are
fixed values of the engine's behaviour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextra.functions import columns as C
from bitextra.operators import placement, planner
from bitextra.plans.sql import quoted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def golden(columns: str, inputs: list[tuple], want: str, rows: list[tuple]) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Register ``f(table of n and inputs)`` with the rows of ``want`` that it must give, n being the place of the case."""

    def value(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return quoted(x) if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else f"{x}::INTEGER"

    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, _: str) -> DataFrame:
            return f(spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], f"n int, {columns}"))

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, (i, *r))) + ')' for i, r in enumerate(rows))}) v(n, {want})"
        return run

    return add


def _terms(**terms: str) -> list[dict]:
    return [{"term": k, "translation": v, "cmp": None} for k, v in terms.items()]


_PAIR = "a string, b string"
_TRIPLE = "query string, tm_source string, tm_target string"


@golden(_PAIR, [("日本語", "中国語"), ("kitten", "sitting"), ("", "abc"), ("abc", "abc")], "distance", [(2,), (3,), (3,), (0,)])
def gold_edit_distance(df):
    return df.select("n", F.levenshtein("a", "b").alias("distance"))


_SCORED = [("hello", "jello"), ("a", "abcdefghij"), ("aaaa", "bbbb"), ("", ""), ("日本語のテスト", "中本語のテスト"), ("the cat sat", "the dog sat"), ("光属性のダメージを20%UP", "闇属性のダメージを15%UP")]


@golden(_PAIR, _SCORED, "score", [(0.8,), (0.0,), (0.0,), (1.0,), (6 / 7,), (2 / 3,), (11 / 14,)])
def gold_fuzzy_score(df):
    return df.select("n", C.fuzzy_score("a", "b", 0.5).alias("score"))


@golden(_PAIR, [("attack", "the attck is strong"), ("attack", "an attack"), ("", "x")], "score", [(5 / 6,), (1.0,), (0.0,)])
def gold_substring_score(df):
    return df.select("n", C.substring_score("a", "b", 0.7).alias("score"))


@golden(_PAIR, [("DARK ELEMENT", "light element"), ("dark element", "Light Element"), ("Dark Element", "light element"), ("日本語", "Light"), ("Dark element", "light element")], "cased", [("LIGHT ELEMENT",), ("light element",), ("Light Element",), ("Light",), ("Light element",)])
def gold_casing(df):
    return df.select("n", C.apply_casing("a", "b").alias("cased"))


@golden("a string", [("<b>ＨＥＬＬＯ</b>　ひらがな\t x ",), ("①ﬁ㍻",)], "plain, nfkc", [("hello ヒラガナ x", "hello ヒラガナ x"), ("①ﬁ㍻", "1fi平成")])
def gold_forms(df):
    return df.select("n", C.make_cmp("a").alias("plain"), C.make_cmp_nfkc("a").alias("nfkc"))


@golden("a string", [("the cat's (end).",)], "tokens", [("the|cat|'|s|(|end|)|.",)])
def gold_tokens(df):
    return df.select("n", F.array_join(C.tokens("a"), "|").alias("tokens"))


@golden("a string", [("b2:C",), ("Sheet!A2",), ("A1",), ("A",), ("aa10:AB12",)], "c1, r1, c2, r2", [("B", 2, "C", None), (None, None, None, None), ("A", 1, None, None), ("A", None, None, None), ("AA", 10, "AB", 12)])
def gold_a1(df):
    p = C.parse_a1("a")
    return df.select("n", p["col"].alias("c1"), p["row"].alias("r1"), p["col2"].alias("c2"), p["row2"].alias("r2"))


@golden(_TRIPLE, [("光のダメージ", "闇のダメージ", "Dark damage"), ("光のダメージ", "闇のダメージ", "Darkens the area by 50")], "placed, placed_target", [(True, "Light damage"), (False, "Darkens the area by 50")])
def gold_place_terms(df):
    return placement.place_terms(df, _terms(光="Light", 闇="Dark")).select("n", "placed", "placed_target")


_RULES = [{"source_pattern": "[unclosed", "target_template": ""}, {"source_pattern": r"(\d+)(\d)億円", "target_template": r"\1.\2 billion yen", "enabled": None}, {"source_pattern": r"(\d+)円", "target_template": r"$\1"}]


@golden(_TRIPLE, [("22億円を投資しました。", "85億円を投資しました。", "Invested 8.5 billion yen."), ("200円", "100円", "Cost: $100")], "placed, placed_target", [(True, "Invested 2.2 billion yen."), (True, "Cost: $200")])
def gold_place_rules(df):
    return placement.place_rules(df, _RULES).select("n", "placed", "placed_target")


_STRICT = [
    ("Vamos a ir el 10 de Mayo", "Vamos a ir el 5 de Mayo", "Let's go on May 5"), ("Version 2.0 ships", "Version 1.5 ships", "Version 1.5 ships"),
    ("Number ３１４ here", "Number 1 here", "Number 1 here"), ("a 5", "b 5 and 10", "b 5 and 10"),
]


@golden(_TRIPLE, _STRICT, "placed, placed_target", [(True, "Let's go on May 10"), (True, "Version 2.0 ships"), (True, "Number 314 here"), (False, "b 5 and 10")])
def gold_place_numbers(df):
    return placement.place_numbers(df, strict=True).select("n", "placed", "placed_target")


_RESOLVE = [
    ("ダメージ30%、20ターン継続", "ダメージ15%、10ターン継続", "Deals 15% damage for 10 turns"), ("光属性のダメージを20%UP", "闇属性のダメージを15%UP", "Increases dark element damage by 15%"),
    ("光属性のダメージ", "闇属性のダメージ", "DARK ELEMENT DAMAGE"), ("光属性のダメージ", "闇属性のダメージ", "Dark element damage"),
]


@golden(_TRIPLE, _RESOLVE, "target, covered", [("Deals 30% damage for 20 turns", True), ("Increases light element damage by 20%", True), ("LIGHT ELEMENT DAMAGE", True), ("Light element damage", True)])
def gold_resolve(df):
    return placement.resolve(df, _terms(光属性="light element", 闇属性="dark element"), []).select("n", "target", "covered")


_MIND = ("MATK110%のダメージを与え、味方全体のMINDを5%UPする", "MATK150%のダメージを与え、味方全体の光属性ダメージを35%UPする", "造成MATK150%傷害，我方全體的光屬性傷害提升35%")


@golden(_TRIPLE, [_MIND], "missing, known", [("MIND=光属性ダメージ", "true/false")])
def gold_uncovered(df):
    u = F.col("uncovered")
    rows = placement.resolve(df, _terms(MIND="精神"), [])
    show = lambda a, b, sep: F.array_join(F.transform(u, lambda d: F.concat(d[a].cast("string"), F.lit(sep), d[b].cast("string"))), "|")
    return rows.select("n", show("q_text", "s_text", "=").alias("missing"), show("q_registered", "s_registered", "/").alias("known"))


@golden("query string, tm_source string", [("味方全体のMINDを5%UPする", "味方全体のCRTを45%UPする")], "diffs", [("MIND=CRT",)])
def gold_lexical_diffs(df):
    return placement.lexical_diffs(df).select("n", F.array_join(F.transform("diffs", lambda d: F.concat(d["q_text"], F.lit("="), d["s_text"])), "|").alias("diffs"))


@golden("original string, placed string", [("Deals 15% damage", "Deals 30% damage"), ("abc", "abc")], "changed, uncertain", [("6+2", "0+6|8+8"), ("", "0+3")])
def gold_regions(df):
    show = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["idx"].cast("string"), F.lit("+"), x["len"].cast("string"))), "|")
    return placement.changed_regions(df).select("n", show("changed").alias("changed"), show("uncertain").alias("uncertain"))


_CAT = ('<span class="diff-match">the</span><span class="diff-sub">cat</span>', '<span class="diff-match">the</span> <span class="diff-sub">dog</span>')


@golden("query string, tm_source string", [("the cat", "the dog")], "query_html, source_html", [_CAT])
def gold_highlight(df):
    return placement.highlight(df).select("n", "query_html", "source_html")


@golden("text string", [("a lamp",), ("none",)], "html", [('a <span class="gloss_match" data-tip="&quot;L&quot;">lamp</span>',), (None,)])
def gold_mark_terms(df):
    return placement.mark_terms(df, [{"term": "Lamp", "translation": '"L"'}]).select("n", "html")


_SHEET = [("Invested 22 million yen.", ""), ("hello", "old"), ("absolutely unrelated text here", None), ("world", ""), (None, "")]


def _plan(df: DataFrame, overwrite: bool) -> DataFrame:
    m = df.sparkSession.createDataFrame(
        [(1, "hello", "こんにちは"), (2, "world", "世界"), (3, "Invested 85 million yen.", "8500万円を投資した。")], "id bigint, source string, target string"
    ).select("*", F.lit("").alias("context"), F.lit(0).alias("reliability"), F.lit(False).alias("validated"), F.lit(0).alias("refcount"))
    cells = df.select(F.lit(1).alias("sheet_id"), (F.col("n") + 2).alias("row_num"), "src", "tgt")
    return planner.statuses(cells, m, [], [], 0.7, overwrite)


@golden("src string, tgt string", _SHEET, "status, written", [("placed", True), ("filled", False), ("no_match", False), ("exact", True), ("empty_source", False)])
def gold_selection(df):
    return planner.selection_plan(_plan(df, False)).select((F.col("row_num") - 2).alias("n"), "status", "written")


@golden("src string, tgt string", _SHEET, "stop_row, stop_reason, landing_row", [(4, "no_match", 4)])
def gold_walk(df):
    s = _plan(df, True)
    stops = planner.walk_stops(s, 2)
    return stops.join(planner.landing_rows(planner.walk_plan(s, 2), stops, 2), "sheet_id").select(F.lit(0).alias("n"), "stop_row", "stop_reason", "landing_row")


@golden("src string, tgt string", _SHEET, "range, back", [("'1'!B2", ""), ("'1'!B3", "old")])
def gold_undo(df):
    done = planner.actions(planner.walk_plan(_plan(df, True), 2))
    return planner.undo(done).select((F.col("row_num") - 2).alias("n"), "range", F.col("value").alias("back"))
