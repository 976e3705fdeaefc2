"""Round trips of the store, the exchange formats and the streams."""

import io

import pytest
from pyspark.sql import functions as F

from bitextra.api import Engine
from bitextra.sources import datasource, formats, tsv
from bitextra.store import Store
from bitextra.streaming import lookups as streams

TMX = """<?xml version="1.0"?><tmx version="1.4"><header srclang="{src}"/><body>
<tu creationid="alice" changeid="bob" usagecount="7" creationdate="20250101T120000Z" changedate="bad"><prop type="x-context">ctx</prop>
<tuv xml:lang="en-US"><seg>Click <bpt>[</bpt>here<ept>]</ept> to {{0}} &amp; &lt;tag&gt;</seg></tuv><tuv xml:lang="ja"><seg>こんにちは</seg></tuv></tu>
<tu><tuv xml:lang="en"><seg>alone</seg></tuv></tu></body></tmx>"""


def test_tmx_reader():
    got = list(formats.read_tmx(io.BytesIO(TMX.format(src="en").encode())))
    assert len(got) == 1
    r = got[0]
    assert (r["source"], r["target"], r["context"], r["created_by"], r["refcount"], r["modified"]) == ("Click [here] to {0} & <tag>", "こんにちは", "ctx", "alice", 7, None)
    assert r["created"].isoformat() == "2025-01-01T12:00:00"
    swapped = list(formats.read_tmx(io.BytesIO(TMX.format(src="").encode()), "ja", "en"))
    assert swapped[0]["source"] == "こんにちは"
    assert list(formats.read_tmx(io.BytesIO(TMX.format(src="en").encode()), flavour="py"))[0]["context"] == ""


RECORDS = [{"source": 'a & <b> "q"\r\n\x01x', "target": "ü\t訳", "context": "c", "refcount": 2}, {"source": "plain", "target": "", "context": None}]


@pytest.mark.parametrize("version", ["1.2", "2.0"])
def test_xliff_round_trip(version):
    f = io.BytesIO()
    formats.write_xliff(f, RECORDS, version=version)
    got = list(formats.read_xliff(io.BytesIO(f.getvalue())))
    assert got == [{"source": 'a & <b> "q"\r\nx', "target": "ü\t訳"}, {"source": "plain", "target": ""}]


def test_xlsx_round_trip():
    f = io.BytesIO()
    formats.write_xlsx(f, RECORDS)
    assert [r["source"] for r in formats.read_xlsx(io.BytesIO(f.getvalue()))] == ['a & <b> "q"\r\nx', "plain"]
    with pytest.raises(ValueError):
        list(formats.read_xlsx(io.BytesIO(f.getvalue()), sheet="none"))


def test_dispatch():
    assert datasource.format_of("x.sdlxliff") == "xliff" and datasource.format_of("x", "CSV") == "tsv"
    with pytest.raises(ValueError):
        datasource.format_of("x.pdf")


def test_tsv(spark, tmp_path):
    p = tmp_path / "g.tsv"
    p.write_text('term\ttranslation\tnotes\nlamp\t"a\tb"\nlamp\n', encoding="utf-8")
    assert [tuple(r) for r in tsv.read_glossary(spark, str(p)).collect()] == [("lamp", "a\tb", ""), ("lamp", "", "")]
    q = tmp_path / "r.tsv"
    q.write_text("source_pattern\ttarget_template\n(\\d+)\t\\1\n[\tx\n(\\d+)\t\\1\n", encoding="utf-8")
    assert tsv.read_rules(spark, str(q)).count() == 1
    rows = spark.createDataFrame([("a", "b\tc\n\"d\""), (" ", "e"), ("", "")], "source string, target string")
    tsv.write_tsv(rows, f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in tsv.read_tsv(spark, f"file://{tmp_path}/out").collect()) == [("", "e"), ("a", 'b\tc\n"d"')]


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("Open 5 files", "5 ファイルを開く"), ("Save", "保存"), ("Save", "保存")], "source string, target string")
    assert e.store.upsert(rows) == {"added": 2, "updated": 1, "total": 3} and e.store.count() == 2
    e.store.append(rows.limit(1))
    assert e.store.count() == 3
    assert e.search("Open 5 files").count() == 2 and e.search("save", "concordance").count() == 1
    best = e.lookup_with_placement("Open 7 files", least=0.6).first()
    assert best["target"] == "7 ファイルを開く" and best["covered"]
    assert e.store.add_terms(spark.createDataFrame([("a", "b"), ("A", "b"), ("c", None)], "term string, translation string")) == {"added": 2, "exists": 0}
    assert e.store.add_rules(spark.createDataFrame([("a", "b"), ("[", "b"), ("a", "b")], "source_pattern string, target_template string")) == {"added": 1, "invalid": 1, "exists": 1}
    assert e.replace("Save", "Keep") == 1 and e.find("source:keep").count() == 1
    e.store.set_meta(source_lang="en", x="1")
    assert e.store.meta("x") == "1" and e.store.meta("min_score") == "0.7" and e.statistics().first()["records"] == 3
    out = f"{tmp_path}/export.tmx"
    assert e.export_file(out, sourceLang="en", targetLang="ja") == 3
    assert datasource.read_memory(spark, out, "tmx").count() == 3
    assert e.import_file(out, "tmx", merge=True) == 0
    e.store.delete(e.store.memory.filter("source = 'Keep'").select("id"))
    assert e.store.count() == 2 and e.browse("open").count() == 2 and e.records("open").count() == 2
    e.store.clear()
    assert e.store.count() == 0


def test_streams(spark, tmp_path):
    memory = spark.createDataFrame([(1, "Hello", "a"), (2, "hallo", "b")], "id bigint, source string, target string").select("*", F.lit("").alias("context"), F.lit(0).alias("reliability"), F.lit(False).alias("validated"), F.lit(0).alias("refcount"))
    spark.createDataFrame([(1, "hello"), (2, "hello"), (3, None)], "query_id bigint, query string").write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema("query_id bigint, query string").parquet(f"{tmp_path}/q")
    got = []
    streams.lookup_stream(stream, lambda: memory, lambda df, _: got.extend(df.collect()), f"{tmp_path}/state").awaitTermination()
    assert sorted((r["query_id"], r["id"], r["score"]) for r in got) == [(1, 1, 1.0), (1, 2, 0.8), (2, 1, 1.0), (2, 2, 0.8)]
    kept = {"m": memory}
    spark.createDataFrame([(1, "HELLO", "a"), (2, "new", "n")], "seq bigint, source string, target string").write.parquet(f"{tmp_path}/p")
    pairs = spark.readStream.schema("seq bigint, source string, target string").parquet(f"{tmp_path}/p")
    streams.upsert_stream(pairs, lambda: kept["m"], lambda df, _: kept.update(m=spark.createDataFrame(df.collect(), df.schema)), f"{tmp_path}/state2").awaitTermination()
    assert sorted((r["source"], r["refcount"]) for r in kept["m"].collect()) == [("Hello", 1), ("hallo", 0), ("new", 0)]
    log = spark.createDataFrame([(b, f"B{b}", "v", "o") for b in range(60)], "batch_id int, range string, value string, old_value string")
    assert streams.undo_entries(log).count() == 50


def test_store_keeps_versions_for_readers(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/versions.store")
    store.append(spark.createDataFrame([("a", "b")], "source string, target string"))
    reader = store.memory
    store.append(spark.createDataFrame([("c", "d")], "source string, target string"))
    assert reader.count() == 1 and store.memory.count() == 2
    # a version without a pointer, as a crash leaves it, changes nothing
    store.memory.limit(0).write.parquet(f"file://{tmp_path}/versions.store/memory-dead")
    assert Store.open(spark, f"file://{tmp_path}/versions.store").memory.count() == 2
    for i in range(4):
        store.append(spark.createDataFrame([(str(i), "x")], "source string, target string"))
    assert len(store._versions("memory")) == 3 and store.memory.count() == 6
