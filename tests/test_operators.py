"""Operators on small tables against brute force and golden cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from bitextra.functions import columns as C
from bitextra.functions import strings as S
from bitextra.operators import checks, lookup, placement, planner
from bitextra.operators import replace as snr
from bitextra.operators import upsert as up

TM = "id bigint, source string, target string, context string, reliability int, validated boolean, refcount int"
TEXTS = [
    ("The file has been saved.", "ファイルが保存されました。"), ("The file has been deleted.", "ファイルが削除されました。"), ("Save the file.", "ファイルを保存してください。"), ("Open the file.", "ファイルを開いてください。"),
    ("翻訳メモリシステム", "Translation memory system"), ("翻訳メモリの検索", "Translation memory search"), ("ＨＥＬＬＯ", "こんにちは"), ("hello", "やあ"), ("jello", "ゼリー"), ("<b>the cat sat</b>", "猫"), ("the dog sat", "犬"),
    ("", "空"), (None, None), ("a" * 3000, "長い"),
]


@pytest.fixture(scope="module")
def tm(spark):
    return spark.createDataFrame([(i, s, t, "", 0, False, 5 if s == "hello" else 0) for i, (s, t) in enumerate(TEXTS, 1)], TM)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_columns_equal_strings(spark):
    texts = [t for pair in TEXTS for t in pair if t is not None] + ["ｱ <i>ひら</i>　x\t\ny ", "İß", "'", "3.5 and ３１４", "ABc HP"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", C.fold("t"), C.make_cmp("t"), C.make_cmp_nfkc("t"), C.tokens("t"), C.contains_cjk("t"), C.numbers("t"), C.caps_words("t")).collect()
    for r in rows:
        t = r[0]
        assert list(r[1:]) == [S.fold(t), S.make_cmp(t), S.make_cmp_nfkc(t), S.tokenize(t), S.contains_cjk(t), S.NUMBER.findall(S.fold(t)), S.CAPS.findall(t)]


def test_scores_equal_strings(spark):
    texts = [S.make_cmp(t) for pair in TEXTS[:11] for t in pair] + [""]
    pairs = list(itertools.product(texts, texts))
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", C.fuzzy_score("a", "b", 0.5), C.edit_score("a", "b", 0.6), C.bag_distance("a", "b"), C.edit_lower_bound("a", "b"), C.substring_score("a", "b", 0.7)).collect()
    for r in rows:
        a, b = r[0], r[1]
        want = [S.fuzzy_score(a, b, 0.5), S.edit_score(a, b, 0.6), S.bag_distance(a, b), S.edit_lower_bound(a, b), S.substring_score(a, b, 0.7)]
        assert list(r[2:]) == pytest.approx(want), (a, b)


@pytest.mark.parametrize("mode, least", [("auto", 0.5), ("char", 0.6), ("char", 0.8), ("auto", 0.0)])
def test_fuzzy_lookup_is_exact(spark, tm, mode, least):
    extra = spark.createDataFrame([(100 + i, f"The file number {i % 9} has been {w}.", "x", None, None, None, None) for i, w in enumerate(["saved", "save", "deleted", "opened"] * 9)], TM)
    memory = tm.unionByName(extra)
    queries = ["The file has been updated.", "翻訳メモリの管理", "hello", "HELLO", "the cat sat", "The file number 3 has been saved.", "", None, "zzz"]
    got = {(r["query_id"], r["id"]): r["score"] for r in lookup.fuzzy_lookup(ask(spark, *queries), memory, least, mode, k=None).collect()}
    want = {}
    for q, text in enumerate(queries):
        for r in memory.collect():
            if text and r["source"] is not None:
                a, b = S.make_cmp(text), S.make_cmp(r["source"])
                score = S.fuzzy_score(a, b, least) if mode == "auto" else S.edit_score(a, b, least)
                if score >= least:
                    want[q, r["id"]] = pytest.approx(score)
    assert got == want


def test_ranks_and_ties(spark, tm):
    rows = lookup.fuzzy_lookup(ask(spark, "hello"), tm, 0.5).orderBy("match_rank").collect()
    assert [(r["source"], r["score"]) for r in rows] == [("hello", 1.0), ("ＨＥＬＬＯ", 1.0), ("jello", 0.8)]
    assert lookup.reverse_lookup(ask(spark, "Translation memory"), tm, 0.5).count() == 2
    assert [r["id"] for r in lookup.exact_lookup(ask(spark, "THE FILE has been saved."), tm).collect()] == [1]
    assert lookup.fuzzy_lookup(ask(spark, "the cat sat"), tm, 0.9, penalty=True).first()["score"] == pytest.approx(0.99)


def test_concordance(spark, tm):
    assert [r["id"] for r in lookup.concordance(tm, "FILE").collect()] == [1, 2, 3, 4]
    assert lookup.concordance(tm, "[unclosed", regex=True).count() == 0
    assert [(r["id"], r["match_field"]) for r in lookup.concordance(tm, "c.t|猫", regex=True).collect()] == [(10, "source")]
    assert lookup.phrase_concordance(tm, "been SAVED").count() == 1 and lookup.phrase_concordance(tm, "ave").count() == 0
    assert lookup.phrase_concordance(tm, "保存", "target").count() == 0
    with pytest.raises(ValueError):
        lookup.phrase_concordance(tm, "x", "notes")


def test_glossary(spark):
    g = spark.createDataFrame([(1, "up", "", None), (2, "attack damage up", "a", ""), (3, "damage", "b", "damage"), (4, None, "c", None)], "id int, term string, translation string, cmp string")
    rows = lookup.glossary_lookup(ask(spark, "attack damage up", "the damge", None), g).orderBy("query_id", "match_rank").collect()
    assert [(r["query_id"], r["id"]) for r in rows] == [(0, 2), (0, 3), (0, 1)]
    fuzzy = lookup.glossary_lookup(ask(spark, "the damge is"), g, 0.7).collect()
    assert [(r["id"], r["score"]) for r in fuzzy] == [(3, pytest.approx(5 / 6))]
    both = lookup.glossary_hits(ask(spark, "attack"), g, bidirectional=True)
    assert {r["id"] for r in both.collect()} == {2}
    terms = ["ab", "abcdefghij", "kitten sits", "x", "翻訳メモリ", "aaaa"]
    texts = ["abd", "abcdxfghij", "the kiten sit", "x", "y", "翻訳のメモリ", "aaba", ""]
    g = spark.createDataFrame([(i, t, "-", None) for i, t in enumerate(terms)], "id int, term string, translation string, cmp string")
    for least in (0.0, 0.5, 0.6, 0.8, 0.9, 1.0):
        got = {(r["query_id"], r["id"]): r["score"] for r in lookup.glossary_hits(ask(spark, *texts), g, least).collect()}
        want = {(i, j): s for i, q in enumerate(texts) for j, t in enumerate(terms) if q and (s := S.substring_score(t, q, least)) >= least and (least < 1 or t in q)}
        assert got == pytest.approx(want), least


def test_upsert(spark):
    m = spark.createDataFrame([(3, "Cat", "猫", 1), (5, "cat", "猫", 0), (9, "dog", None, None)], "id bigint, source string, target string, refcount int")
    new = spark.createDataFrame([(1, "CAT", "猫"), (2, "bird", "鳥"), (3, " bird ", "鳥"), (4, "", "x"), (5, None, None), (6, "cat", "ネコ")], "seq int, source string, target string")
    got = sorted((r["id"], r["source"], r["refcount"]) for r in up.upsert(m, new).collect())
    assert got == [(3, "Cat", 2), (5, "cat", 0), (9, "dog", None), (10, "bird", 1), (11, "cat", 0)]
    assert up.tallies(up.merged_pairs(m, new)).first().asDict() == {"added": 2, "updated": 2, "total": 4}
    assert sorted(r["id"] for r in up.append(m, new.drop("seq")).collect()) == [3, 5, 9, *range(10, 16)]
    assert up.merged_pairs(m, new.limit(0)).count() == 0
    rules = spark.createDataFrame([(1, "a", "b", True), (2, "[", "b", None), (3, "a", "b", True), (4, None, None, None)], "rule_id int, source_pattern string, target_template string, enabled boolean")
    assert [(r["rule_id"], r["valid"], r["repeat"]) for r in up.valid_rules(rules).orderBy("rule_id").collect()] == [(1, True, False), (2, False, False), (3, True, True), (4, False, False)]


def test_checks(spark):
    r = spark.createDataFrame([
        (1, "Deals 15% damage in 3 turns", "Deals damage"), (2, "5 of 5", "5 of 6"), (3, "３１４", "314"), (4, "MATK and ATK boost", "ATKを上昇"), (5, "Stat DOWN by 50%", "50%"), (6, "光属性のダメージ", "Element damage"),
        (7, "Darken the area", "Lighten the area"), (8, None, None), (9, "", "7"),
    ], "id int, source string, target string")
    g = spark.createDataFrame([(1, "光属性", "Light element"), (2, "Dark", "暗"), (3, "DOWN", "50"), (4, None, None), (5, "x", None)], "id int, term string, translation string")
    assert sorted(tuple(x) for x in checks.numbers(r).collect()) == [(1, "15", "target"), (1, "3", "target"), (2, "5", "target"), (2, "6", "source"), (9, "7", "source")]
    assert sorted(tuple(x) for x in checks.capital_words(r, g).collect()) == [(4, "MATK")]
    assert [(x["id"], x["term"]) for x in checks.terms(r, g).collect()] == [(6, "光属性")]
    assert {(x["type"], x["flagged"], x["issues"]) for x in checks.totals(checks.check(r, g)).collect()} == {("number", 3, 5), ("allcaps", 1, 1), ("glossary", 1, 1)}
    assert checks.check(r, g, number=False, capitals=False, glossary_terms=False).count() == 0
    assert checks.first_flagged(checks.numbers(r), 1).count() == 2


def test_find_and_replace(spark):
    schema = "id int, source string, target string, context string, created_by string, modified_by string, reliability int, validated boolean, refcount int"
    r = spark.createDataFrame([(1, "The Cat", "x", None, "", "", 5, False, 0), (2, "dog 1234 yen", "a cat", "about cats", "", "", 3, None, None), (3, None, None, None, None, None, 5, True, 1)], schema)
    assert [(x["id"], x["match_field"]) for x in snr.find(r, "cat").orderBy("id").collect()] == [(1, "source"), (2, "target")]
    assert snr.find(r, r"regex:dog \d+").count() == 1 and snr.find(r, "regex:[unclosed").count() == 0 and snr.find(r, "unknown:cat").count() == 0
    done = {x["id"]: x for x in snr.replace(r, "CAT", "feline").collect()}
    assert done[1]["source"] == "The feline" and done[2]["context"] == "about felines" and not done[3]["changed"]
    assert {x["id"]: x["source"] for x in snr.replace(r, r"regex:(\d+) yen", "¥$1").collect()}[2] == "dog ¥1234"
    assert snr.replaced_counts(snr.replace(r, "reliability:5", "0")).first()["changed"] == 2
    assert {x["created_by"] for x in snr.replace(r, "created-by:*", "Ryan").collect()} == {"Ryan"}
    assert {x["validated"] for x in snr.replace(r, "validated:*", "yes").collect()} == {True}
    assert snr.replaced_counts(snr.replace(r, "regex:[", "x")).first()["changed"] == 0
    assert snr.parse("trans:x") == snr.Expression("x", "target") and snr.parse(None) == snr.Expression("")


def _cells(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "sheet_id int, row_num int, src string, tgt string")


def test_plans(spark):
    m = spark.createDataFrame([(1, "hello", "こんにちは"), (2, "world", "世界"), (3, "Invested 85 million yen.", "8500万円を投資した。")], "id bigint, source string, target string").select(
        "*", F.lit("").alias("context"), F.lit(0).alias("reliability"), F.lit(False).alias("validated"), F.lit(0).alias("refcount")
    )
    rows = _cells(spark, (2, "Invested 22 million yen.", ""), (3, "hello", "old"), (4, "absolutely unrelated text here", None), (5, "world", ""), (6, None, ""))
    s = planner.statuses(rows, m, [], [], 0.7, overwrite=True).cache()
    got = {r["row_num"]: (r["status"], r["value"]) for r in s.collect()}
    assert got[2][0] == "placed" and "22" in got[2][1] and got[3] == ("exact", "こんにちは") and got[4][0] == "no_match" and got[6][0] == "empty_source"
    stop = planner.walk_stops(s, 2).first()
    assert (stop["stop_row"], stop["stop_reason"]) == (4, "no_match")
    plan = planner.walk_plan(s, 2)
    acts = planner.actions(plan).orderBy("row_num").collect()
    assert [(a["range"], a["old_value"]) for a in acts] == [("'1'!B2", ""), ("'1'!B3", "old")]
    assert planner.undo(planner.actions(plan)).filter("row_num = 3").first()["value"] == "old"
    assert planner.landing_rows(plan, planner.walk_stops(s, 2), 2).first()["landing_row"] == 4
    sel = planner.selection_plan(planner.statuses(rows, m, [], [], 0.7), 2, 6)
    assert planner.selection_summary(sel).first().asDict() == {"sheet_id": 1, "total": 5, "written": 2, "skipped_empty": 1, "skipped_filled": 1, "skipped_no_match": 1, "skipped_uncovered": 0, "stop_reason": "end_of_range"}
    assert "停止" in planner.describe({"written": 2, "stop_reason": "no_match", "stop_row": 4}) and planner.describe({"written": 1, "no_match": [{"row_num": 4}], "uncovered": []}).startswith("完了: 1 行挿入、スキップ 1 行")
    assert planner.statuses(rows.limit(0), m, [], []).count() == 0


def test_placement_tables(spark):
    df = spark.createDataFrame([(1, "光のダメージ", "闇のダメージ", "Dark damage", "clash"), (2, None, "x", "y", None)], "k int, query string, tm_source string, tm_target string, target string")
    terms = [{"term": "光", "translation": "Light"}, {"term": "闇", "translation": "Dark"}]
    rows = {r["k"]: r for r in placement.resolve(df, terms, []).collect()}
    assert rows[1]["target"] == "Light damage" and rows[1]["covered"] and rows[2]["covered"] is None
    assert placement.place_terms(df, terms).filter("placed").count() == 1
    assert placement.highlight(df).filter("query_html IS NULL").count() == 1


def test_no_least_score_reaches_long_texts(spark):
    texts = spark.createDataFrame([("a" * 40_000,), ("b",), ("abc",)], "s string")
    got = lookup.block_scores(spark.createDataFrame([("abc",)], "q string"), texts, 0.0).collect()
    assert sorted(len(r["s"]) for r in got) == [1, 40_000]


def test_blocks_equal_strings():
    import random

    from bitextra.functions import blocks

    r = random.Random(5)
    words = ["the", "file", "has", "been", "saved", "savd", "deleted", "(stop)", "don't", "x", "保存", "ファイル", "ａ"]
    base = [" ".join(r.choices(words, k=r.randint(1, 30))) for _ in range(25)]
    edited = ["".join(c for c in t if r.random() > 0.06) for t in base] + [t.replace("the", "a").strip() for t in base] + [t[7:] + t[:7] for t in base]
    queries, texts = sorted({*base, "a b"}), sorted({*base, *edited, "", "a", "saved file " * 60})
    for least, mode in itertools.product((0.0, 0.4, 0.55, 0.7, 0.9), ("auto", "char")):
        got = {(i, j): s for i, j, s in zip(*map(list, blocks.scored(queries, texts, least, mode)))}
        want = {}
        for (i, q), (j, t) in itertools.product(enumerate(queries), enumerate(texts)):
            if q != t:
                s = S.fuzzy_score(q, t, least) if mode == "auto" else S.edit_score(q, t, least)
                if s >= least and min(len(q), len(t)) >= least * max(len(q), len(t)):
                    want[i, j] = s
        assert got == want, (least, mode)


def test_term_check_at_its_limit(spark):
    """A glossary one entry larger than what travels with the tasks gives the same rows."""
    g = spark.createDataFrame([(1, "dark", "闇"), (2, "up", "x"), (3, "ダーク", "dark"), (4, "d", "e"), (5, "", "y")], "id int, term string, translation string")
    r = spark.createDataFrame([(1, "Darkens dark", "闇の"), (2, "dark UP", None), (3, "ＤＡＲＫ up", "X"), (4, "だーくd", "dark e"), (5, None, "x")], "id int, source string, target string")
    for edges in (False, True):
        want = sorted(map(tuple, checks.terms(r, g, edges).collect()))
        assert want and sorted(map(tuple, checks.terms(r, g, edges, small=4).collect())) == want == sorted(map(tuple, checks.terms(r, g, edges, small=3).collect()))
