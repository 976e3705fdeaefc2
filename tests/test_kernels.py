"""Compiled kernels against the plain functions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bitextra.functions import columns as C
from bitextra.functions import kernel
from bitextra.functions import strings as S


@pytest.mark.parametrize("mode", ["auto", "char"])
def test_block_scores_equal_strings(spark, mode):
    r = random.Random(7)
    words = ["the", "file", "has", "been", "saved", "savd", "deleted", "(stop)", "don't", "x", "保存", "ファイル", "ａ", "𝒳y"]
    base = [" ".join(r.choices(words, k=r.randint(1, 30))) for _ in range(30)]
    edited = ["".join(c for c in t if r.random() > 0.06) for t in base] + [t.replace("the", "a").strip() for t in base] + [t[7:] + t[:7] for t in base]
    queries, texts = sorted({*base, "a b"}), sorted({*base, *edited, "", "a", "saved file " * 60, "y" * 3000})
    block = spark.createDataFrame([(queries, texts)], "q array<string>, s array<string>").repartition(1)
    for least in (0.0, 0.55, 0.7, 0.8, 0.9):
        rows = block.select(F.inline(kernel.call("BlockScores", F.col("q"), F.col("s"), F.lit(least), F.lit(mode == "char")))).collect()
        want = {}
        for q, s in itertools.product(queries, texts):
            if q != s and min(len(q), len(s)) >= least * max(len(q), len(s)):
                score = S.fuzzy_score(q, s, least) if mode == "auto" else S.edit_score(q, s, least)
                if score >= least:
                    want[q, s] = score
        assert len(rows) == len(want) and {(x["q"], x["s"]): x["score"] for x in rows} == want, least


def test_compare_form_equals_expressions(spark):
    r = random.Random(3)
    pool = "aAｂＢ <>/あアａ　\t\n\x0b\r\x1c\x1f\x85\xa0  ​᠎Σσİß😀ゖゝ～￠"
    texts = [None, "", "<>", "<<b>x</b>", "a < b", *("".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    plain = C.collapse_blanks(C.fold(C.strip_tags("t")))
    assert df.select("t", C.make_cmp("t").alias("got"), plain.alias("want")).filter("NOT got <=> want").collect() == []
