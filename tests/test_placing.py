"""Golden cases of scoring, differences and placement (values of FIXTURES.md)."""

import random

import pytest

from bitextra.functions import alignment as al
from bitextra.functions import placing as pl
from bitextra.functions import strings as st


def glossary(**terms):
    return al.Glossary([{"term": k, "translation": v} for k, v in terms.items()])


@pytest.mark.parametrize("a, b, want", [("日本語", "中国語", 2), ("kitten", "sitting", 3), ("", "abc", 3), ("abc", "abc", 0)])
def test_levenshtein(a, b, want):
    assert st.levenshtein(a, b) == want


def test_levenshtein_against_full_table():
    rng = random.Random(12345)
    pool = "abcde123 光闇"
    for _ in range(200):
        a, b = ("".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in "ab")
        d = al.table(a, b)[len(a)][len(b)]
        assert st.levenshtein(a, b) == d
        for most in (d + 5, d, max(0, d - 1), 0):
            got = st.levenshtein(a, b, most)
            assert got == d if d <= most else got == most + 1
        assert st.edit_lower_bound(a, b) <= d
        assert st.bag_distance(a, b) <= 2 * d


@pytest.mark.parametrize(
    "q, s, least, want",
    [
        ("hello", "jello", 0.6, 0.8), ("hello", "jello", 0.8, 0.8), ("hello", "jello", 0.81, 0), ("a", "abcdefghij", 0.5, 0),
        ("aaaa", "bbbb", 0.5, 0), ("abcdef", "ghijkl", 0.5, 0), ("", "", 0.99, 1), ("日本語のテスト", "中本語のテスト", 0.5, 6 / 7),
        ("the cat sat", "the dog sat", 0.3, 2 / 3), ("光属性のダメージを20%UP", "闇属性のダメージを15%UP", 0.5, 11 / 14),
    ],
)
def test_fuzzy_score(q, s, least, want):
    assert st.fuzzy_score(q, s, least) == pytest.approx(want)


def test_substring_score():
    assert st.substring_score("attack", "the attck is strong", 0.7) == pytest.approx(5 / 6)
    assert st.substring_score("attack", "an attack", 1.0) == 1.0
    assert st.substring_score("", "x", 0.5) == 0.0


@pytest.mark.parametrize(
    "pattern, text, want",
    [("DARK ELEMENT", "light element", "LIGHT ELEMENT"), ("dark element", "Light Element", "light element"), ("Dark Element", "light element", "Light Element"), ("日本語", "Light", "Light"), ("Dark element", "light element", "Light element")],
)
def test_casing(pattern, text, want):
    assert st.apply_casing(pattern, text) == want


def test_boundaries():
    assert st.find_bounded("Darkens the area", "dark") == -1
    assert st.find_bounded("type: Dark", "dark") == 6
    assert st.find_bounded("闇属性傷害", "闇") == 0
    assert st.find_bounded("15%UP", "5%up") == -1


def test_term_placement():
    g = glossary(光="Light", 闇="Dark")
    assert pl.place_term("光のダメージ", "闇のダメージ", "Dark damage", g) == ("Light damage", "闇", "光")
    assert pl.place_term("光のダメージ", "闇のダメージ", "Darkens the area by 50", g) is None


def test_rule_placement():
    rules = pl.compile_rules([{"source_pattern": "[unclosed", "target_template": ""}, {"source_pattern": r"(\d+)(\d)億円", "target_template": r"\1.\2 billion yen", "enabled": None}])
    assert pl.place_rules("22億円を投資しました。", "85億円を投資しました。", "Invested 8.5 billion yen.", rules) == "Invested 2.2 billion yen."
    assert pl.place_rules("200円", "100円", "Cost: $100", pl.compile_rules([{"source_pattern": r"(\d+)円", "target_template": r"$\1"}])) == "Cost: $200"


@pytest.mark.parametrize(
    "q, s, t, want",
    [
        ("Vamos a ir el 10 de Mayo", "Vamos a ir el 5 de Mayo", "Let's go on May 5", "Let's go on May 10"),
        ("Version 2.0 ships", "Version 1.5 ships", "Version 1.5 ships", "Version 2.0 ships"),
        ("Number ３１４ here", "Number 1 here", "Number 1 here", "Number 314 here"), ("a 5", "b 5 and 10", "b 5 and 10", None),
    ],
)
def test_strict_numbers(q, s, t, want):
    assert pl.place_numbers_strict(q, s, t) == want


RESOLVE = [
    ("ダメージ30%、20ターン継続", "ダメージ15%、10ターン継続", "Deals 15% damage for 10 turns", {}, "Deals 30% damage for 20 turns", True),
    ("光属性のダメージを20%UP", "闇属性のダメージを15%UP", "Increases dark element damage by 15%", {"光属性": "light element", "闇属性": "dark element"}, "Increases light element damage by 20%", True),
    ("光属性のダメージ", "闇属性のダメージ", "DARK ELEMENT DAMAGE", {"光属性": "light element", "闇属性": "dark element"}, "LIGHT ELEMENT DAMAGE", True),
    ("光属性のダメージ", "闇属性のダメージ", "Dark element damage", {"光属性": "light element", "闇属性": "dark element"}, "Light element damage", True),
    ("光のダメージ", "闇のダメージ", "闇傷害效果", {"光": "光", "闇": "闇"}, "光傷害效果", True),
]


@pytest.mark.parametrize("q, s, t, terms, want, covered", RESOLVE)
def test_resolve(q, s, t, terms, want, covered):
    got = pl.resolve(q, s, t, glossary(**terms), [])
    assert (got.target, got.covered) == (want, covered)


def test_resolve_uncovered():
    got = pl.resolve("光属性のダメージを20%UP", "闇属性のダメージを20%UP", "", glossary(光属性="Light", 闇属性="Dark"), [])
    assert (got.target, len(got.uncovered), got.uncovered[0].q_registered, got.uncovered[0].s_registered) == ("", 1, True, True)
    q, s = "MATK110%のダメージを与え、味方全体のMINDを5%UPする", "MATK150%のダメージを与え、味方全体の光属性ダメージを35%UPする"
    t = "造成MATK150%傷害，我方全體的光屬性傷害提升35%"
    for terms, flags in (({}, (False, False)), ({"MIND": "精神"}, (True, False))):
        u = pl.resolve(q, s, t, glossary(**terms), []).uncovered
        assert [(d.q_text, d.s_text, d.q_registered, d.s_registered) for d in u] == [("MIND", "光属性ダメージ", *flags)]


def test_lexical_diffs():
    d = al.lexical_diffs("味方全体のMINDを5%UPする", "味方全体のCRTを45%UPする")
    assert [(x.q_text, x.s_text) for x in d] == [("MIND", "CRT")]
    d = al.lexical_diffs("与え、UPする", "与え、自身の神絆ゲージを1%UPし、UPする")
    assert len(d) == 1 and d[0].q_text == "" and not d[0].s_text.startswith("、")


def test_masked_numbers():
    g = glossary(**{"ランダム4体": "隨機4體", "全体": "全體"})
    got = pl.resolve("/ランダム4体/ ATK130%を5%UP", "/全体/ ATK150%を15%UP", "/全體/ 造成ATK150%提升15%", g, [])
    assert "ATK130%" in got.target and "提升5%" in got.target


def test_regions_and_runs():
    assert al.changed_regions("Deals 15% damage", "Deals 30% damage") == [(6, 2)]
    assert al.changed_regions("abc", "abc") == []
    assert al.uncertain_regions([(3, 3)], 10) == [(0, 3), (6, 4)]
    assert al.format_runs("ABCDEFGHIJ", [(3, 6)], [(0, 10)]) == [(0, "unverified"), (3, "placed"), (6, "unverified")]


def test_rendering():
    assert al.mark_terms("a lamp", [{"term": "Lamp", "translation": '"L"'}]) == 'a <span class="gloss_match" data-tip="&quot;L&quot;">lamp</span>'
    q, s = al.highlight("the cat", "the dog")
    assert q == '<span class="diff-match">the</span><span class="diff-sub">cat</span>'
    assert s == '<span class="diff-match">the</span> <span class="diff-sub">dog</span>'
    assert al.render_query("x", [], []) is None
    d = [al.Diff("b", "", 1, 2, 0, 0)]
    assert al.mark_uncovered("abc", d, "q") == 'a<span class="diff-uncovered-missing diff-uncovered-add">b</span>c'


def test_make_cmp():
    assert st.make_cmp("<b>ＨＥＬＬＯ</b>　ひらがな\t x ") == "hello ヒラガナ x"
    assert st.make_cmp_nfkc("①ﬁ㍻") == "1fi平成"
    assert st.tokenize("the cat's (end).") == ["the", "cat", "'", "s", "(", "end", ")", "."]
    assert st.parse_a1("b2:C") == {"col": "B", "row": 2, "col2": "C", "row2": None} and st.parse_a1("Sheet!A2") is None
