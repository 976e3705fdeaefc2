"""Record operations against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from bitextra.llm import copies, langid, looks, near

SCHEMA = "id bigint, memory string, source string, target string, context string, source_cmp string, src_lang string, tgt_lang string, reliability int, validated boolean, refcount int, created string, modified string, created_by string, modified_by string, ingested timestamp"


def table(spark, *rows):
    """Records from dicts; extra columns named like the operators' own."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)
    return df.withColumns({k: F.lit("clash") for k in ("_s", "_t", "k1", "group_id", "rank", "n", "s", "t", "rep", "lang", "side", "v1", "tz", "copies")})


@pytest.fixture(scope="module")
def memories(spark):
    return spark.createDataFrame([("m", "Europe/Berlin", "dmy")], "memory string, tz string, date_order string")


def bare(text):
    return "".join(c for c in (text or "").lower() if unicodedata.category(c)[0] in "LN")


COPIES = [
    dict(id=5, memory="m", source="Open file.", target="開く", refcount=1, reliability=3, modified="2020-01-01", context=" "), dict(id=3, memory="m", source="OPEN  FILE", target="開く!", refcount=None, reliability=12, modified="2021-01-01", context="help"),
    dict(id=9, memory=None, source="開く", target="open-file", refcount=2, reliability=3, validated=None, modified="2020-01-02", context="menu"), dict(id=7, source="12", target="3"), dict(id=8, source="12", target="3"),
    dict(id=10, source=None, target="x"), dict(id=11, source="", target=""), dict(id=12, source="a" * 100_000, target="b"), dict(id=13, source="a" * 100_000 + "!", target="B"),
    dict(id=14, source="openfile", target="other"), dict(id=14, source="openfile", target="other"),
]


def test_copies(spark):
    df = table(spark, *COPIES)
    assert sorted(tuple(r) for r in copies.members(df).collect()) == [(3, 3), (3, 5), (3, 9), (12, 12), (12, 13), (14, 14), (14, 14)]
    got = sorted(tuple(r) for r in copies.collapse(df).collect())
    assert got == [(3, 3, 3), (12, 2, 0), (14, 2, 0)]
    assert copies.collisions(df).count() == 0
    assert copies.members(df.limit(0)).count() == 0 and copies.collapse(df.limit(0)).count() == 0


def test_survivors(spark, memories):
    df = table(spark, *COPIES)
    assert sorted(tuple(r) for r in copies.survivors(df, memories).collect()) == [(3, 9), (12, 12), (14, 14)]
    gold = {r["group_id"]: r for r in copies.golden(df, memories).collect()}
    assert gold[3]["id"] == 9 and gold[3]["context"] == "menu" and gold[3]["copies"] == 3 and gold[3]["refcount_sum"] == 3
    best = table(spark, *COPIES, dict(id=20, source="open file", target="開く", validated=True), dict(id=19, source="open file", target="開く", validated=True))
    assert copies.survivors(best, memories).filter("group_id = 3").first()["id"] == 19
    assert copies.golden(best, memories).filter("group_id = 3").first()["context"] == "menu"
    assert copies.survivors(df.limit(0), memories).count() == 0


def _near_rows():
    rng = random.Random(5)
    words = [w for w in ("the file harbor lantern was saved before night falls over small garden while keeper opened bridge mirror and nobody remembers who built it").split()]
    rows, k = [], 0
    for _ in range(40):
        base = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(10, 25))]
        for edits in (0, 0, 1, 2, 4):
            k += 1
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = rng.choice(words)
            if edits == 2:
                text = text[5:] + text[:5]
            rows.append(dict(id=k, source=" ".join(text).upper() if k % 3 else " ".join(text), target="。".join(text[::-1])))
    return rows + [dict(id=900, source="1" * 40, target="2" * 40), dict(id=901, source="1" * 40, target="2" * 40), dict(id=902, source=None, target="x" * 50), dict(id=903, source="z" * 200_000, target="y" * 60), dict(id=904, source="z" * 100_000, target="y" * 50)]


def test_near_duplicates_against_brute_force(spark):
    rows = _near_rows()
    texts = {r["id"]: (bare(r["source"]), bare(r["target"])) for r in rows}
    want = set()
    for a, b in itertools.combinations(sorted(texts), 2):
        (s1, t1), (s2, t2) = texts[a], texts[b]
        if min(map(len, (s1, t1, s2, t2))) < 30:
            continue
        lettered = all(re.search(r"[^\d]", x) for x in (s1, t1))
        if lettered and sorted((s1, t1)) == sorted((s2, t2)):
            continue
        if near.likeness(s1, s2) >= near.THRESHOLD and near.likeness(t1, t2) >= near.THRESHOLD:
            want.add((a, b))
    got = {tuple(r) for r in near.similar_records(table(spark, *rows)).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.98 * len(want)
    assert (900, 901) in got and (903, 904) in got
    links = {r["id"]: r for r in near.record_links(table(spark, *rows)).collect()}
    assert links[1]["class_id"] == links[2]["class_id"] == 1 and 902 not in links and links[904]["links"] == 1
    assert near.similar_records(table(spark, *rows).limit(0)).count() == 0


def test_fingerprints_find_alike_texts():
    """Agreement of symbols follows the likeness."""
    a = "".join(random.Random(1).choices("abcdefghij", k=400))
    b = a[:360] + "".join(random.Random(2).choices("abcdefghij", k=40))
    m = near.minima([a, b], 2000, 3)
    assert abs((m[:, 0] == m[:, 1]).mean() - near.likeness(a, b)) < 0.05


def test_sketch_bound_keeps_pairs_at_the_threshold():
    """Of pairs just above 0.7 on both sides the sketch distance loses hardly any."""
    rng = random.Random(3)

    def sides(n):
        texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(102)) for _ in range(n)]
        return texts, [t[:85] + "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(17)) for t in texts]

    (s1, s2), (t1, t2) = sides(3000), sides(3000)
    assert all(near.THRESHOLD <= near.likeness(a, b) < 0.72 for a, b in zip(s1 + t1, s2 + t2))
    one, two = near.fingerprints(s1, t1)[1], near.fingerprints(s2, t2)[1]
    far = [sum((x ^ y).bit_count() for x, y in zip(p, q)) for p, q in zip(zip(*[w.view("u8").tolist() for w in one]), zip(*[w.view("u8").tolist() for w in two]))]
    assert sum(d > near.MAX_BITS for d in far) <= 3


@pytest.mark.parametrize(
    "stored, look",
    [
        ("\uff2f\uff50\uff45\uff4e\uff11", "Open1"), ("\u041ep\u0435n", "Open"), ("e\u0301", "\u00e9"), ("a\u00a0b\u3000c", "a b c"), ("a\u200bb\u00ad\ufeff", "ab"), ("\uff8a\uff9f\uff8a\uff9e", "\u30d1\u30d0"),
        ("\ufb01le", "file"), ("\u2f08", "\u4eba"), ("\u1100\u1161", "\uac00"), ("\u53e3", "\u30ed"), ("x\u00b2", "x\u00b2"), ("\uff21\uff1a\uff0c", "A\uff1a\uff0c"), ("a\tb\n", "a\tb\n"), ("", ""),
    ],
)
def test_looks(stored, look):
    assert looks.look(stored) == look and looks.look(look) == look


def test_look_alikes(spark):
    acute, apart = "\u00e9", "e\u0301"
    rows = [
        dict(id=1, source="Open file", target=acute), dict(id=2, source="\u041epen file", target=acute), dict(id=3, source="Open file", target=apart), dict(id=4, source="open file", target=acute), dict(id=5, source="Open  file", target=acute),
        dict(id=6, source="Open file", target="e"), dict(id=7, source="Open file", target=acute), dict(id=8, source=None, target=acute), dict(id=9, source=" ", target=acute), dict(id=10, source="\u00a0", target=acute),
    ]
    got = {tuple(r) for r in looks.look_alikes(table(spark, *rows)).collect()}
    assert got == set(itertools.combinations((1, 2, 3, 7), 2)) - {(1, 7)}
    forms = {r["id"]: r for r in looks.record_forms(table(spark, *rows)).collect()}
    assert forms[1]["source"] == forms[4]["source"] == forms[5]["source"] == "open file" and forms[8]["source"] is None
    assert looks.look_alikes(table(spark, *rows).limit(0)).count() == 0
    assert looks.canonical("STRASSE") == looks.canonical("straße")


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet("/root/testdata/sf0.001/langsamples.parquet")


def test_labels(spark):
    labels = {"en-US": "en", "EN": "en", "English": "en", "jpn": "ja", "zh-Hans": "zh", "de_AT": "de", "und": None, "": None, None: None, " ko-KR": "ko", "xx": None}
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    assert {r[0]: r[1] for r in df.select("l", langid.label_language(F.col("l"))).collect()} == labels


def test_held_out_accuracy(samples):
    rows = [(r["lang"], r["text"]) for r in samples.orderBy("sample_id").collect()]
    profiles = langid.Profiles([r for i, r in enumerate(rows) if i % 3])
    held = [r for i, r in enumerate(rows) if not i % 3]
    found = [lang for _, got in zip(held, langid.languages([t for _, t in held], profiles)) for lang, _, _ in got[:1]]
    assert sum(a == b for a, (b, _) in zip(found, held)) >= 0.98 * len(held)


def test_mislabelled(spark, samples):
    en = "The glossary is small on purpose, for a long list of terms is rarely read by anyone."
    de = "Das Glossar ist mit Absicht kurz, denn eine lange Liste liest kaum jemand."
    ja = "用語集をわざと小さくしているのは、長い一覧はだれも読まないためです。"
    rows = [
        dict(id=1, source=en, target=ja, src_lang="en-GB", tgt_lang="Japanese"), dict(id=2, source=en, target=ja, src_lang=None, tgt_lang="zh"), dict(id=3, source=f"{de} ({en})", target=f'Klicken Sie auf "Open the file" und lesen Sie <b>{de}</b>', src_lang="de", tgt_lang="DE"),
        dict(id=4, source="short", target=None, src_lang="de"), dict(id=5, source="1" * 50, target="", src_lang=None),
    ]
    got = sorted(tuple(r) for r in langid.mislabelled(table(spark, *rows), samples).collect())
    assert got == [(2, "source", "en"), (2, "target", "ja"), (3, "source", "de"), (3, "source", "en")]
    spoken = langid.record_passages(table(spark, *rows), samples).filter("id = 3 AND side = 'source'").orderBy("passage").collect()
    assert [r["lang"] for r in spoken] == ["de", "en"] and all(r["confidence"] > 0 for r in spoken)
    assert langid.mislabelled(table(spark, *rows).limit(0), samples).count() == 0
    assert langid.record_languages(table(spark, *rows), samples).filter("id = 1").count() == 2


def test_short_sides_have_a_language(spark, samples):
    rows = [
        dict(id=1, source="Open file", target="ファイルを開く", src_lang="en", tgt_lang=None), dict(id=2, source="「保存する」", target="파일 열기", src_lang="en", tgt_lang="und"),
        dict(id=3, source="12", target="<b>{0}</b>"), dict(id=4, source=None, target=" "), dict(id=5, source="Ж", target="<b>诺纳普萨兹</b> Lv.58", tgt_lang="zh"),
    ]
    df = table(spark, *rows)
    got = {(r["id"], r["side"]): r for r in langid.record_languages(df, samples).collect()}
    assert {k: r["lang"] for k, r in got.items()} == {(1, "source"): "en", (1, "target"): "ja", (2, "source"): "ja", (2, "target"): "ko", (5, "source"): None, (5, "target"): "zh"}
    assert all(0 <= r["confidence"] < 1 for r in got.values()) and got[5, "source"]["confidence"] == 0
    assert {(r["id"], r["side"]) for r in langid.record_passages(df, samples).collect()} == set(got)
    assert langid.mislabelled(df, samples).count() == 0


def test_distances_of_a_long_piece():
    """Runs are ranked by their counts however often they occur."""
    rng = random.Random(7)
    profiles = langid.Profiles([("en", "the small harbour keeps its lantern lit before the night falls over it"), ("de", "der kleine hafen hat seine laterne vor der nacht angezündet")])
    words = "the lantern hafen keeps nacht der over small it".split()
    pieces = [" ".join(rng.choices(words, weights=range(9, 0, -1), k=4000)), "the lantern der"]
    want = []
    for p in pieces:
        codes = langid._runs([p])[1].tolist()
        at = profiles._find(langid.np.array(codes))
        counts = collections.Counter(k for k in at.tolist() if k >= 0)
        ranked = sorted(counts, key=lambda k: (-counts[k], profiles.prior[k], k))
        off = [[langid.PLACES if r == langid.PLACES else abs(min(i, langid.PLACES) - r) for r in profiles.ranks[k].tolist()] for i, k in enumerate(ranked)]
        want.append([sum(col) / (len(ranked) * langid.PLACES) for col in zip(*off)])
    assert max(counts.values()) < 127 and profiles.distances(pieces) == pytest.approx(langid.np.array(want))


def test_golden_fills_every_gap(spark, memories):
    rows = [
        dict(id=1, memory="m", source="open file", target="開く", validated=True, src_lang="und", tgt_lang=None, reliability=12, created="rubbish", modified=None, context=None),
        dict(id=2, memory="m", source="開く", target="Open file!", validated=False, src_lang="ja", tgt_lang="en", reliability=4, created="2020-01-01", source_cmp="開く", refcount=2),
        dict(id=3, memory="m", source="Open file", target="開く", src_lang="EN", reliability=2, created="2019-01-01", modified="2019-02-02", source_cmp="open file", context="menu"),
    ]
    gold = copies.golden(table(spark, *rows), memories).collect()
    assert len(gold) == 1 and gold[0].asDict() | {"ingested": None} == dict(
        group_id=1, id=1, copies=3, refcount_sum=2, source="open file", target="開く", memory="m", context="menu", created="2020-01-01", modified="2019-02-02", created_by=None, modified_by=None,
        reliability=4, validated=True, refcount=2, ingested=None, src_lang="en", tgt_lang="ja", source_cmp="open file",
    )


def test_look_forms_and_classes(spark):
    assert looks.canonical("ＡＢＣ！①") == "abc!1" and looks.canonical("ＴＥＸＴ\u200b\u00a0x") == "text x"
    for word in ("Тhis", "тhis", "τhe", "Βring", "βring"):
        assert looks.canonical(word).isascii()
    # an accented look-alike is one, stored composed or apart; a visible format character stays
    assert looks.look("Кӧln") == looks.look("Ko\u0308ln") == "K\u00f6ln" and looks.canonical("\u0600a") == "\u0600a"
    assert looks.look("クり") == looks.look("クリ") and looks.look("！") == "！"
    r = spark.createDataFrame([(1, "ABC", "x y"), (2, "ABC", "x y"), (3, "ＡBC", "x y"), (4, "AВC", "x\u00a0y"), (5, "abc", "x y"), (6, None, "x y")], "id bigint, source string, target string")
    assert {tuple(x) for x in looks.look_alikes(r).collect()} == {(1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}
    assert {tuple(x) for x in looks.look_classes(r).collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 21), (5, 1)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(30)]
    got = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**dict.fromkeys(range(1, 6), 1), **dict.fromkeys((7, 8, 9), 7), **dict.fromkeys((20, 21), 20), **dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(200, 231), 200)}
    assert got == want
    assert near.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hot_keys_lose_no_pair(spark, monkeypatch):
    base = "the quick brown fox jumps over the lazy dog and runs away into the dark forest number"
    rows = [dict(id=i, source=f"{base} {i}", target=f"{base} again {i}") for i in range(40)]
    plain = {tuple(r) for r in near.similar_records(table(spark, *rows)).collect()}
    monkeypatch.setattr(near, "HOT", 6)
    monkeypatch.setattr(near, "SAMPLE", 1)
    monkeypatch.setattr(near, "HOT_SHARE", 0)
    assert {tuple(r) for r in near.similar_records(table(spark, *rows)).collect()} == plain and len(plain) > 300
    groups = {r["group_id"] for r in near.record_groups(table(spark, *rows)).collect()}
    assert groups == {0}
