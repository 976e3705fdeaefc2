"""Lookups of the best few: nothing is lost, and blocks give no more than can be among them."""

import random

import pytest
from pyspark.sql import functions as F

from bitextra.functions import kernel
from bitextra.functions import strings as S
from bitextra.operators import lookup

WORDS = "the file has been saved savd deleted (stop) don't x opens keeper gates of tower bridges shadow restores health each turn".split()


def _texts(seed: int, n: int, most: int) -> list[str]:
    """Texts with near copies: letters left out, words swapped, pieces moved to the other end."""
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS, k=r.randint(1, most))) for _ in range(n)] + ["".join(r.choices("保存ファイル開く", k=r.randint(2, 3 * most))) for _ in range(n // 3)]
    out = set(base)
    for t in base:
        for rate in (0.02, 0.08, 0.15, 0.25):
            out.add("".join(c for c in t if r.random() > rate))
            out.add(" ".join(r.choice(WORDS) if r.random() < rate else w for w in t.split(" ")))
        out.add(t[9:] + t[:9])
    return sorted(S.make_cmp(t) for t in out if t.strip())


def _score(q: str, s: str, least: float, mode: str) -> float:
    if q == s:
        return 1.0
    if min(len(q), len(s)) < least * max(len(q), len(s)):
        return -1.0
    return S.fuzzy_score(q, s, least) if mode == "auto" else S.edit_score(q, s, least)


@pytest.mark.parametrize("mode", ["auto", "char"])
def test_long_texts_keep_all_pairs(spark, mode):
    """Few edits over few diagonals, many over two words of them, more over whole columns; quarters and strips lose none."""
    texts = _texts(11, 14, 90)
    block = spark.createDataFrame([(texts[::5], texts)], "q array<string>, s array<string>").repartition(1)
    for least in (0.55, 0.7, 0.8, 0.9):
        got = {(x["q"], x["s"]): x["score"] for x in block.select(F.inline(kernel.call("BlockScores", F.col("q"), F.col("s"), F.lit(least), F.lit(mode == "char")))).collect()}
        want = {(q, s): x for q in texts[::5] for s in texts if q != s and (x := _score(q, s, least, mode)) >= least}
        assert got == want, least


@pytest.mark.parametrize("mode", ["auto", "char"])
def test_blocks_give_the_best_alone(spark, mode):
    texts = _texts(5, 40, 8)
    q = spark.createDataFrame([(t,) for t in texts[::4]], "q string").withColumns({"slack": F.lit(0.0), "floor": F.lit(0.6)})
    s = spark.createDataFrame([(t,) for t in texts], "s string").withColumns({"slack": F.lit(0.0), "n": F.lit(1)})
    got = {}
    for x in lookup.block_scores(q, s, 0.6, mode, 2).collect():
        got.setdefault(x["q"], {})[x["s"]] = x["score"]
    few = 0
    for t in texts[::4]:
        want = {u: x for u in texts if u != t and (x := _score(t, u, 0.6, mode)) >= 0.6}
        second = sorted(want.values(), reverse=True)[:2][-1:]
        best = {u: x for u, x in want.items() if x >= (second or [0])[0]}
        mine = got.get(t, {})
        assert best.items() <= mine.items() <= want.items()
        few += len(mine) < len(want)
    assert few


@pytest.mark.parametrize("penalty", [False, True])
@pytest.mark.parametrize("k", [1, 3])
def test_best_rows_equal_brute_force(spark, penalty, k):
    """Copies fill the ranks, equal texts leave room for ties alone, and tags may turn the order."""
    r = random.Random(3)
    made = _texts(8, 30, 6)
    made += ["a .", "a."] + r.choices(made, k=60)
    tagged = [(f"<b>{t}</b>" if r.random() < 0.3 else f"<i><br>{t}</i>" if r.random() < 0.2 else t) for t in made]
    rows = [(i, t, "x", "", 0, True, r.randint(0, 3)) for i, t in enumerate(tagged)]
    memory = spark.createDataFrame(rows, "id long, source string, target string, context string, reliability int, validated boolean, refcount int")
    asked = [(i, t) for i, t in enumerate(tagged) if i % 3 == 0]
    got = {}
    for x in lookup.fuzzy_lookup(spark.createDataFrame(asked, "query_id long, query string"), memory, 0.7, k=k, penalty=penalty).orderBy("query_id", "match_rank").collect():
        got.setdefault(x["query_id"], []).append((x["id"], x["score"]))
    tags = lambda t: {x: t.count(f"<{x}>") for x in ("b", "i", "br")}
    for i, t in asked:
        want = []
        for row in rows:
            score = _score(S.make_cmp(t), S.make_cmp(row[1]), 0.7, "auto")
            if score >= 0.7:
                score -= sum(abs(tags(t)[x] - tags(row[1])[x]) for x in tags(t)) / 100 if penalty else 0
                if score >= 0.7:
                    want.append((-score, -row[6], row[0]))
        assert got.get(i, []) == [(x[2], -x[0]) for x in sorted(want)[:k]], t
