"""Document operations: exact round trips, packing invariants and decisions on plain cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitextra.llm import packing, quality, tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.vocabulary())


@pytest.mark.parametrize("leaf", [1, 2, 5, 64])
def test_tree_equals_direct(encoder, leaf):
    rng = random.Random(leaf)
    pool = "ab'sdtl lv 12  \n\t.,é漢 🙂　!"
    texts = ["", " ", "   ", "'", "don't  stop\n\n x", "x" * 300, " " * 50, "漢字" * 40] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for t in texts:
        ids = encoder.encode(t, leaf)
        assert np.array_equal(ids, encoder.direct(t)), t
        assert encoder.decode(ids) == t


def test_join_is_associative(encoder):
    a, b, c = (encoder.leaf(t) for t in ("Hello wor", "ld, it'", "s   fine"))
    one, two = encoder.join(encoder.join(a, b), c), encoder.join(a, encoder.join(b, c))
    assert np.array_equal(one.ids, two.ids) and one.text == two.text and one.starts == two.starts and one.firsts == two.firsts


def test_encode_table(spark, encoder):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "hello"), (5, "long text, " * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("clash"), "tokens": F.lit(1)})
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "doc_id").collect()}
    assert got[2] is None and got[3] == [] and got[1] == got[4] == encoder.direct("hello").tolist() and got[5] == encoder.direct(rows[4][1]).tolist()
    counts = {r["doc_id"]: r["tokens"] for r in tokens.encode(df, "doc_id", counts_only=True).collect()}
    assert counts == {k: None if v is None else len(v) for k, v in got.items()}
    assert {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df, "doc_id"), "doc_id").collect()} == dict(rows)
    assert tokens.encode(df.limit(0), "doc_id").count() == 0


def test_pack():
    rng = random.Random(3)
    for capacity in (1, 3, 10, 512):
        sizes = np.array([rng.randint(1, capacity) for _ in range(400)])
        at = packing.pack(sizes, capacity)
        fill = np.bincount(at, sizes)
        assert fill.max() <= capacity and (fill > 0).all()
        # first-fit decreasing is the plain bound to keep up with
        bins = []
        for s in sorted(sizes, reverse=True):
            for k, b in enumerate(bins):
                if b + s <= capacity:
                    bins[k] += s
                    break
            else:
                bins.append(s)
        assert len(fill) <= len(bins) * 1.03 + 1


def test_containers(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice((rng.randint(1, 90), rng.randint(100, 1000)))) for i in range(600)] + [(1000, None), (1001, 0), (1002, 512), (1003, 5000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, tokens bigint").withColumns({"container": F.lit("clash"), "n": F.lit(7)})
    kinds = spark.createDataFrame([("small", 512), ("big", 2048), (None, 5), ("bad", None)], "batch_kind string, capacity int")
    out = packing.containers(sizes, kinds, block_items=150).toPandas()
    for kind, cap in (("small", 512), ("big", 2048)):
        own = out[out.batch_kind == kind]
        real = own[own.container.notna()]
        assert real.groupby("container").tokens.sum().max() <= cap
        assert real.groupby("doc_id").tokens.sum().to_dict() == {i: n for i, n in rows if n}
        for i, n in rows:
            pieces = real[real.doc_id == i].sort_values("piece")
            assert list(pieces.first_token) == list(range(0, n or 0, cap)) and (len(pieces) <= 1 or n > cap)
        assert set(own[own.container.isna()].doc_id) == {1000, 1001}
    fill = {r["batch_kind"]: r["fill"] for r in packing.fill(packing.containers(sizes, kinds, 150), kinds).collect()}
    assert fill["small"] > 0.97 and fill["big"] > 0.95
    assert packing.containers(sizes.limit(0), kinds).count() == 0


EN = "The glossary is small on purpose, for a long list of terms is rarely read by anyone. When the reviewer rejects a match, the record stays in the store but its reliability is lowered."
KINDS = {
    EN: "prose", EN.lower().replace(".", "").replace(",", ""): "prose", "<p>" + EN + "</p>": "prose", EN.replace(" ", "\n", 40).replace("\n", " ", 35): "prose",
    "- " + EN.replace(". ", "\n- "): "list", "Items:\n1. lamp\n2. bell / drum\n3. Open gate": "list", "lamp\nbell\nOpen gate\nSell ring?": "list", "Sell ring?, Open gate, lamp / bell, drum, harbor": "list",
    "| a | b |\n|---|---|\n| " + EN + " | 3 |": "table", "source;target;ok;n\n\"Open lamp\";\"Lampe\";\"1\";\"\"": "table", "a\tb\tc\nd\te\tf": "table", "Open gate      Tor öffnen      7": "table",
    "34974 72528 53189\n13841 12676": "junk", "H9gcVmhszpJL4FTOpHiuDlysZTaJqCgA2BmwuQ5ICpMZFjyHxzkrUNSg\nj+QnqaCG+Pu7kXpz8TC6rYR4cQdGP14hbJupRG": "junk", '{"id":617252,"cmp":"konudo"}\n{"id":522686,"ok":true}': "junk",
    "lamp post " * 40: "junk", '<div class="nav"><span id="s1"></span><br/>&nbsp;</div>': "junk", "▀▀▀▀ ▄▄▄▄\n§§§§": "junk", " \n\t": "blank", "": "blank", EN * 300: "prose",
    "用語集をわざと小さくしているのは、長い一覧はだれも読まないためです。": "prose", "ズコグゼの市場\nフビヂハの外套\nナキソの港町\nゴソリの高塔を編集": "list", "术语表故意做得很小，太长的话根本没有人会去看。": "prose",
}


def test_kinds(spark):
    d = "/root/testdata/sf0.001"
    common, samples = spark.read.parquet(f"{d}/commonwords.parquet"), spark.read.parquet(f"{d}/langsamples.parquet")
    texts = list(KINDS)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id bigint, text string").withColumns({"kind": F.lit("clash"), "words": F.lit(1)})
    rows = {r["doc_id"]: r for r in quality.document_figures(df, common, samples).collect()}
    assert {texts[i][:60]: rows[i]["kind"] for i in range(len(texts))} == {t[:60]: k for t, k in KINDS.items()}
    assert rows[-1]["kind"] is None and rows[-1]["words"] is None
    first = rows[0]
    assert first["lang"] == "en" and first["words"] == 34 and first["lines"] == 1 and first["ended_lines"] == 1.0 and 0.3 < first["common_words"] < 0.7
    hit = {r["doc_id"] for r in quality.not_prose(df, common, samples).collect()}
    assert hit == {i for i, t in enumerate(texts) if KINDS[t] not in ("prose", "blank")}
    assert quality.not_prose(df.limit(0), common, samples).count() == 0


def test_divergence():
    assert quality.divergence([1, 0], [0, 1]) == pytest.approx(1) and quality.divergence([0.5, 0.5], [0.5, 0.5]) == 0


def test_long_word_tables_keep_every_language(spark):
    """A language late in the alphabet keeps its words however many the first one has."""
    words = spark.range(25_000).selectExpr("'de' AS lang", "concat('w', id) AS word", "CAST(id AS INT) AS freq_rank")
    words = words.unionByName(spark.createDataFrame([("zh", "的", 1), ("zh", "了", 2)], "lang string, word string, freq_rank int"))
    prose = quality.fit(words, spark.createDataFrame([("zh", "我们的文件已经保存了。")], "lang string, text string"))
    assert list(prose.words["zh"]) == ["的", "了"] and "zh" in prose.function and prose.words["de"]["w0"] == 0


def test_every_block_gets_the_nearest_profile(monkeypatch):
    words = [("en", w) for w in "the of and to a in is that it was for on are with as".split()] + [("zh", "我们"), ("zh", "的")]
    prose = quality.Prose(words, [("en", "It was the best of times and it is a rule that the news is on the front page, as it was in the past."), ("zh", "我们的文件已经保存了。")])
    text = "- it is the rule of the house that the door to the garden was left open, and it is as it was.\n"
    assert quality.kinds(text, prose)[0]["list"] > 0
    # without the weight of the layout the same entry is nearest to prose: no rule decides before the divergence
    monkeypatch.setattr(quality, "LAYOUT", 0.0)
    assert quality.kinds(text, prose)[0]["prose"] > 0
    assert quality.unspaced_words("我们保存文件了", prose.pieces["zh"]) == ["我们", "保存", "文件", "了"]
    assert quality.unspaced_words("ファイルを保存", None) == ["ファイル", "を", "保存"]
