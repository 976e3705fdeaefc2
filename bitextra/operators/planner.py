"""Pre-translation of sheet rows: what to write, what to skip and why.

``statuses`` decides every row by itself, in one distributed pass.  The two plans read it: a selection takes every row
of its range, a walk goes down from a start row and ends at the first row that cannot be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.operators import placement
from bitextra.operators.lookup import fuzzy_lookup

EMPTY, FILLED, NO_MATCH, UNCOVERED, EXACT, PLACED = "empty_source", "filled", "no_match", "fuzzy_uncovered", "exact", "placed"
STOPS = (EMPTY, NO_MATCH, UNCOVERED)


def statuses(cells: DataFrame, memory: DataFrame, terms: list[dict], rules: list[dict], least: float = 0.7, overwrite: bool = False) -> DataFrame:
    """sheet_id, row_num, source, old_value, status, value, match_source, match_score, missing.

    ``cells`` has sheet_id, row_num, src and tgt; null and blank texts count as empty.  Filled targets are left alone
    unless ``overwrite``.  Repeated source texts are looked up once.
    """
    rows = cells.select(
        "sheet_id", "row_num", F.trim(F.regexp_replace(F.coalesce("src", F.lit("")), r"(?U)^\s+|\s+$", "")).alias("source"),
        F.trim(F.regexp_replace(F.coalesce("tgt", F.lit("")), r"(?U)^\s+|\s+$", "")).alias("old_value"),
    )
    asked = rows.filter((F.col("source") != "") & (F.lit(overwrite) | (F.col("old_value") == "")))
    texts = asked.select(F.col("source").alias("query")).distinct().withColumn("query_id", F.col("query"))
    best = placement.pairs_with_best(texts, fuzzy_lookup(texts, memory, least, k=1))
    exact = best.filter("score >= 1").select("query", "score", "tm_source", F.col("tm_target").alias("value"), F.lit(EXACT).alias("found"))
    fuzzy = placement.resolve(best.filter("score < 1"), terms, rules)
    missing = F.transform("uncovered", lambda d: F.struct(d["q_text"].alias("query"), d["s_text"].alias("source")))
    fuzzy = fuzzy.select(
        "query", "score", "tm_source", F.when(F.col("covered"), F.col("target")).alias("value"),
        F.when(F.coalesce("covered", F.lit(False)), PLACED).otherwise(UNCOVERED).alias("found"), F.when(~F.col("covered"), missing).alias("missing"),
    )
    answers = exact.unionByName(fuzzy, allowMissingColumns=True)
    joined = rows.join(answers, rows["source"] == answers["query"], "left")
    status = (
        F.when(F.col("source") == "", EMPTY)
        .when((F.col("old_value") != "") & ~F.lit(overwrite), FILLED)
        .otherwise(F.coalesce("found", F.lit(NO_MATCH)))
    )
    live = status.isin(EXACT, PLACED, UNCOVERED)
    return joined.select(
        "sheet_id", "row_num", "source", "old_value", status.alias("status"), F.when(status.isin(EXACT, PLACED), F.coalesce("value", F.lit(""))).alias("value"),
        F.when(live, F.col("tm_source")).alias("match_source"), F.when(live, F.col("score")).alias("match_score"), F.when(live, F.col("missing")).alias("missing"),
    )


def selection_plan(status: DataFrame, start_row: int | Column | None = None, end_row: int | Column | None = None) -> DataFrame:
    """Rows of the range with ``written`` (bool); every row is handled by itself."""
    rows = status
    if start_row is not None:
        rows = rows.filter(F.col("row_num") >= start_row)
    if end_row is not None:
        rows = rows.filter(F.col("row_num") <= end_row)
    return rows.withColumn("written", F.col("status").isin(EXACT, PLACED))


def selection_summary(plan: DataFrame) -> DataFrame:
    """One row a sheet: total and the number of each outcome; stop_reason is 'end_of_range'."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return plan.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("total"), n(EXACT, PLACED).alias("written"), n(EMPTY).alias("skipped_empty"), n(FILLED).alias("skipped_filled"),
        n(NO_MATCH).alias("skipped_no_match"), n(UNCOVERED).alias("skipped_uncovered"), F.lit("end_of_range").alias("stop_reason"),
    )


def walk_stops(status: DataFrame, start_row: int = 0) -> DataFrame:
    """One row a sheet: stop_row and stop_reason of a walk down from ``start_row``.

    The first row that cannot be written is a minimum, taken with partial aggregation, so sheet sizes do not matter.
    """
    stop = F.min(F.when(F.col("status").isin(*STOPS), F.struct("row_num", "status", "source", "match_source", "match_score", "missing")))
    out = status.filter(F.col("row_num") >= start_row).groupBy("sheet_id").agg(stop.alias("at"))
    return out.select("sheet_id", F.col("at.row_num").alias("stop_row"), F.coalesce("at.status", F.lit("end_of_batch")).alias("stop_reason"), F.col("at.source").alias("stop_source"), F.col("at.match_source").alias("match_source"), F.col("at.match_score").alias("match_score"), F.col("at.missing").alias("missing"))


def walk_plan(status: DataFrame, start_row: int = 0) -> DataFrame:
    """Rows that a walk writes, filled ones included (``status`` is to be made with ``overwrite``)."""
    stops = walk_stops(status, start_row).select("sheet_id", "stop_row")
    rows = status.filter(F.col("row_num") >= start_row).join(stops, "sheet_id")
    return rows.filter(F.col("stop_row").isNull() | (F.col("row_num") < F.col("stop_row"))).drop("stop_row").withColumn("written", F.lit(True))


def cell_range(column: str, row: Column, sheet: Column | None = None) -> Column:
    cell = F.concat(F.lit(column), row.cast("string"))
    return cell if sheet is None else F.concat(F.lit("'"), sheet.cast("string"), F.lit("'!"), cell)


def actions(plan: DataFrame, column: str = "B", with_sheet: bool = True) -> DataFrame:
    """sheet_id, row_num, range, value, old_value of the rows that are written; the old values undo them."""
    at = cell_range(column, F.col("row_num"), F.col("sheet_id") if with_sheet else None)
    return plan.filter("written").select("sheet_id", "row_num", at.alias("range"), "value", "old_value")


def undo(done: DataFrame) -> DataFrame:
    """The inverse of ``actions``: range and the value to put back; one batch is one undo."""
    return done.select("sheet_id", "row_num", "range", F.col("old_value").alias("value"), F.col("value").alias("old_value"))


def landing_rows(plan: DataFrame, stops: DataFrame | None, start_row: int) -> DataFrame:
    """sheet_id, landing_row: where the cursor goes, the stop row or below what was written."""
    n = plan.groupBy("sheet_id").agg(F.count_if("written").alias("n"))
    if stops is None:
        return n.select("sheet_id", (F.lit(start_row) + F.col("n")).cast("int").alias("landing_row"))
    j = stops.select("sheet_id", "stop_row").join(n, "sheet_id", "left")
    return j.select("sheet_id", F.coalesce("stop_row", (F.lit(start_row) + F.coalesce("n", F.lit(0))).cast("int")).alias("landing_row"))


def describe(summary: dict, column: str = "A", least: float = 0.7) -> str:
    """Report of a plan in Japanese. ``summary``: written, and either the skipped rows or a stop with its details."""
    wrote = summary.get("written", 0)
    nothing = "挿入なし（候補や対象がありません）"
    if "no_match" in summary or "uncovered" in summary:
        none, open_ = summary.get("no_match", []), summary.get("uncovered", [])
        skipped = len(none) + len(open_)
        parts = [f"候補なし: {len(none)}"] * bool(none) + [f"未対応の差分: {len(open_)}"] * bool(open_)
        if wrote and skipped:
            lines = [f"完了: {wrote} 行挿入、スキップ {skipped} 行 （{', '.join(parts)}）"]
        elif wrote:
            lines = [f"完了: {wrote} 行挿入"]
        else:
            lines = [f"挿入なし、スキップ {skipped} 行" if skipped else nothing]
        lines += [f"  ・候補なし: {column}{r['row_num']}" for r in none[:3]]
        lines += [f"  ・未対応 {_percent(r.get('match_score'))}%: {column}{r['row_num']}" for r in open_[:3]]
        more = max(0, len(none) - 3) + max(0, len(open_) - 3)
        return "\n".join(lines + [f"  ・他 {more} 件"] * bool(more))
    reason, row = summary.get("stop_reason"), summary.get("stop_row")
    if reason in (None, "end_of_batch", "end_of_range"):
        return f"完了: {wrote} 行挿入" if wrote else nothing
    if reason == EMPTY:
        return f"完了: {wrote} 行挿入" + (f" ({column}{row} でデータ末尾)" if row is not None else "")
    if row is None:
        return f"停止: {reason}"
    head = f"{column}{row} で停止（{f'{wrote} 行挿入済み' if wrote else '挿入なし'}）"
    if reason == NO_MATCH:
        return f"{head}\n類似候補なし（最低マッチ率 {_percent(least)}% 未満）\nTM に近い原文がないため自動処理できません"
    if reason == UNCOVERED:
        missing = summary.get("missing") or []
        lines = [head, f"{_percent(summary.get('match_score'))}% マッチ — 自動置換では対応できない差分:"]
        lines += [f"  ・「{m['query']}」⇔「{m['source']}」" for m in missing[:4]]
        return "\n".join(lines + [f"  ・他 {len(missing) - 4} 件"] * (len(missing) > 4))
    return f"{head}\n({reason})"


def _percent(score: float | None) -> str:
    return "?" if score is None else str(int(score * 100 + 0.5))
