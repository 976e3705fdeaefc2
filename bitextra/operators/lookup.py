"""Lookups of many queries in a memory: fuzzy, exact, reverse, concordance and glossary.

Queries are a table (query_id, query); one query is the case of one row.  The similarity join is exact at every
score.  Equal comparison forms meet in a hash join.  All others meet in blocks: each text falls into one bucket of
lengths, each query is sent to the buckets its score allows, and both are cut into blocks of bounded size, so neither
a common length nor a large memory ends in one task.  A pair of blocks is one call of a compiled kernel
(``functions/BlockScores.java``) that rules out most pairs by lengths and by hashed characters and bigrams.  Texts that
occur many times are scored once.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitextra.functions import columns as C
from bitextra.functions import kernel
from bitextra.scratch import materialize

#: texts, queries and characters of a block, at most (about, as blocks are told by hashes)
TEXTS, QUERIES, CHARACTERS = 32_768, 8192, 8_000_000
#: texts and queries of a block where so low a score is asked that most pairs may come out
LOW, FEW = 0.5, 1024
#: characters of a term, or of a part of it, that must stand in a text as they are
GRAM = 3
#: columns of a memory that results carry
CARRIED = ("id", "source", "target", "context", "reliability", "validated", "refcount")


def prepared(memory: DataFrame, normalizer: str = "fold") -> DataFrame:
    """A memory with its comparison forms and lengths computed anew; stored ones may be out of date. Null texts stay null."""
    make = C.make_cmp_nfkc if normalizer == "nfkc" else C.make_cmp
    out = memory.withColumns({"source_cmp": make("source"), "target_cmp": make("target")})
    return out.withColumns({"source_len": F.length("source_cmp"), "target_len": F.length("target_cmp")})


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _per_bucket(df: DataFrame, text: str, size: int) -> dict[int, int]:
    """How many blocks each bucket is cut into; there are as many buckets as lengths have magnitudes."""
    rows = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars")).collect()
    return {r["bucket"]: max(-(-r["n"] // size), -(-r["chars"] // CHARACTERS)) for r in rows}


def block_scores(queries: DataFrame, texts: DataFrame, least: float, mode: str = "auto", keep: int | None = None) -> DataFrame:
    """(q, s, score) of all pairs of different forms that reach ``least``; ``queries`` has q, ``texts`` has s, both distinct.

    With ``least`` of 0 or less every length is allowed and every pair comes out.  ``keep``: of each query and block only
    the best rows, at least so many and all that tie with them; then both have slack, which may be taken off a score later,
    ``queries`` a floor, the score below which one needs nothing, and ``texts`` n, the rows that one stands for.
    """
    ratio = log(max(1 / least, 1.1)) if least > 0 else 0

    def bucket(n: Column) -> Column:
        return F.floor(F.log(F.greatest(n, F.lit(1))) / ratio).cast("int") if ratio else F.lit(0)

    def sent(text: str) -> Column:
        if keep is None:
            return F.col(text)
        return F.struct(text, "slack", "floor", F.lit(keep)) if text == "q" else F.struct(text, "slack", F.lit(0.0), F.col("n").cast("int"))

    s = texts.select("s", sent("s").alias("sent"), bucket(F.length("s")).alias("bucket"))
    n = F.length("q")
    # a character more on either side, for rounding
    reach = F.sequence(bucket(n * least - 1), bucket(n / least + 2)) if ratio else F.array(F.lit(0))
    q = queries.select("q", sent("q").alias("sent"), F.explode(reach).alias("bucket"))
    tasks = _tasks(queries)
    most_s, most_q = (FEW, FEW) if least < LOW else (TEXTS, QUERIES)
    size = min(most_s, max(512, texts.count() // tasks))
    many_s, many_q = _per_bucket(s, "s", size), _per_bucket(q, "q", most_q)
    both = sorted(many_s.keys() & many_q.keys())
    if not both:
        return queries.select("q", F.col("q").alias("s"), F.lit(1.0).alias("score")).limit(0)

    def cut(of: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for b in both for x in (b, of[b])]), F.col("bucket"))

    def placed(df: DataFrame, text: str, own: str, other: str, mine: dict[int, int], theirs: dict[int, int]) -> DataFrame:
        df = df.filter(F.col("bucket").isin(both)).withColumn(own, F.pmod(F.xxhash64(text), cut(mine)).cast("int"))
        df = df.groupBy("bucket", own).agg(F.collect_list("sent").alias(text))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), cut(theirs) - 1)))
        # a block is much work however few bytes it has: a fixed number of tasks, which AQE does not merge
        return df.repartition(max(tasks, 2 * sum(many_s[b] * many_q[b] for b in both)), "bucket", "sb", "qb")

    met = placed(q, "q", "qb", "sb", many_q, many_s).join(placed(s, "s", "sb", "qb", many_s, many_q).hint("shuffle_hash"), ["bucket", "sb", "qb"])
    return met.select(F.inline(kernel.call("BlockScores", F.col("q"), F.col("s"), F.lit(float(least)), F.lit(mode == "char"))))


def similar_texts(queries: DataFrame, texts: DataFrame, least: float, mode: str = "auto", k: int | None = None) -> DataFrame:
    """(q, s, score) of all pairs of comparison forms that reach ``least``, equal ones included.

    ``mode`` 'char' compares by characters, 'auto' by words where the query has blanks and no CJK.  With ``k`` pairs may be
    missing that are not among the ``k`` best rows of ``texts`` for a query, ties included; both tables then have
    slack, which is the most that is taken off a score later.
    """
    if k is None:
        q = materialize(queries.select("q").filter(F.col("q") != "").distinct(), "asked-forms")
        s = materialize(texts.select("s").filter(F.col("s").isNotNull()).distinct(), "held-forms")
        equal = q.join(s, F.col("q") == F.col("s")).withColumn("score", F.lit(1.0))
        return equal.unionByName(block_scores(q, s, least, mode)).filter(F.col("score") >= least)
    s = materialize(texts.filter(F.col("s").isNotNull()).groupBy("s").agg(F.max("slack").alias("slack"), F.count(F.lit(1)).alias("n")), "held-forms")
    q = queries.filter(F.col("q") != "").groupBy("q").agg(F.max("slack").alias("slack"))
    q = q.join(s.select(F.col("s").alias("q"), F.col("slack").alias("s_slack"), "n"), "q", "left")
    # enough equal ones leave room for ties alone
    floor = F.when(F.col("n") >= k, F.lit(1.0) - F.col("slack") - F.col("s_slack") - F.when(F.col("slack") + F.col("s_slack") > 0, 1e-9).otherwise(0.0)).otherwise(F.lit(float(least)))
    q = materialize(q.select("q", "slack", floor.alias("floor"), F.col("n").isNotNull().alias("held")), "asked-forms")
    equal = q.filter("held").select("q", F.col("q").alias("s"), F.lit(1.0).alias("score"))
    return equal.unionByName(block_scores(q, s, least, mode, k)).filter(F.col("score") >= least)


def fuzzy_lookup(
    queries: DataFrame, memory: DataFrame, least: float = 0.7, mode: str = "auto", on: str = "source", k: int | None = 20,
    penalty: bool = False, order: tuple[str, ...] = ("refcount",), prefilter: str = "bound",
) -> DataFrame:
    """query_id, match_rank, score and the record, best first: score, then ``order`` falling (nulls last), then id.

    Blank queries find nothing.  ``prefilter`` 'symmetric' leaves out what the legacy prefilter turns down.  ``penalty`` takes off a hundredth for each inline tag that only one side has.
    """
    q = queries.select("query_id", "query", C.make_cmp("query").alias("q"))
    best = k if prefilter != "symmetric" else None
    side = prepared(memory.select(*CARRIED)).withColumnRenamed(f"{on}_cmp", "s").drop("source_cmp", "target_cmp", "source_len", "target_len")
    # every tag in either text is a hundredth at most
    slack = lambda c: F.regexp_count(c, F.lit("<")) / 100 if penalty else F.lit(0.0)
    found = similar_texts(q.withColumn("slack", slack("query")), side.withColumn("slack", slack(on)), least, mode, best)
    if best is not None and not penalty:
        found = found.withColumn("at", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("at") <= best).drop("at")
    if prefilter == "symmetric":
        found = found.filter((F.col("q") == F.col("s")) | C.passes_symmetric_bag("q", "s", least))
    rows = q.join(found, "q").join(side, "s")
    if penalty:
        rows = rows.withColumn("score", F.col("score") - C.format_penalty("query", on)).filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *[F.desc_nulls_last(c) for c in order], "id")
    ranked = rows.withColumn("match_rank", F.row_number().over(w).cast("bigint"))
    ranked = ranked if k is None else ranked.filter(F.col("match_rank") <= k)
    return ranked.select("query_id", "match_rank", "score", *CARRIED)


PY_ORDER = ("refcount", "reliability", "validated")


def exact_lookup(queries: DataFrame, memory: DataFrame, k: int | None = 10) -> DataFrame:
    """Records whose source has the query's comparison form; a hash join."""
    q = queries.select("query_id", C.make_cmp("query").alias("source_cmp")).filter("source_cmp <> ''")
    rows = q.join(prepared(memory.select(*CARRIED)), "source_cmp")
    w = Window.partitionBy("query_id").orderBy(*[F.desc_nulls_last(c) for c in PY_ORDER], "id")
    ranked = rows.withColumn("match_rank", F.row_number().over(w).cast("bigint")).withColumn("score", F.lit(1.0))
    return (ranked if k is None else ranked.filter(F.col("match_rank") <= k)).select("query_id", "match_rank", "score", *CARRIED)


def reverse_lookup(queries: DataFrame, memory: DataFrame, least: float = 0.7, k: int | None = 20, mode: str = "auto", flavour: str = "js", penalty: bool = False) -> DataFrame:
    """As ``fuzzy_lookup`` on the target; flavour 'js' orders by score only, 'py' also by refcount and reliability."""
    return fuzzy_lookup(queries, memory, least, mode, "target", k, penalty, () if flavour == "js" else ("refcount", "reliability"))


def searched(queries: DataFrame, memory: DataFrame, least: float) -> DataFrame:
    """query_id, total_searched: how many records the length band leaves for each query.

    Lengths are counted first, so the join is between queries and distinct lengths.
    """
    sizes = prepared(memory).filter("source_len IS NOT NULL").groupBy("source_len").agg(F.count(F.lit(1)).alias("n"))
    q = queries.select("query_id", F.length(C.make_cmp("query")).alias("ql"))
    q = q.select("query_id", "ql", F.explode(F.sequence(F.floor(F.col("ql") * F.lit(float(least))).cast("int"), (F.floor(F.col("ql") / F.lit(float(least))) + 1).cast("int"))).alias("source_len"))
    return q.join(sizes, "source_len", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_searched"))


# concordance


def concordance(memory: DataFrame, query: str, regex: bool = False, k: int | None = 50) -> DataFrame:
    """Records that hold the query in source or target, regardless of case; an invalid pattern finds nothing.

    The first ``k`` by id; match_field names the first field that holds it.
    """
    if regex and C.pattern_groups(query) is None:
        return memory.select(*CARRIED).withColumn("match_field", F.lit("")).limit(0)

    def holds(c: str) -> Column:
        hit = F.regexp_like(F.col(c), F.lit(f"(?iu){query}")) if regex else F.contains(F.lower(c), F.lit(query.lower()))
        return F.coalesce(hit, F.lit(False))

    field = F.when(holds("source"), "source").when(holds("target"), "target")
    out = memory.select(*CARRIED, field.alias("match_field")).filter(F.col("match_field").isNotNull())
    return out if k is None else out.orderBy("id").limit(k)


def phrase_concordance(memory: DataFrame, phrase: str, field: str = "source") -> DataFrame:
    """Records whose field holds the phrase's words in sequence, regardless of case and accents; whole words only."""
    if field not in ("source", "target", "context"):
        raise ValueError(f"no field to search: {field}")

    def words(c: Column) -> Column:
        plain = F.lower(C.without_accents(c))
        return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{Co}]+", " ")), F.lit(" "))

    return memory.select(*CARRIED).filter(words(F.col(field)).contains(words(F.lit(phrase)))).withColumn("score", F.lit(1.0))


# glossary


def grams(text: Column) -> Column:
    """All runs of one to ``GRAM`` characters of a text, and the empty one."""
    def runs(n: int) -> Column:
        last = F.length(text) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))

    parts = [F.coalesce(runs(n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *parts))


def _anchors(term: Column, least: float) -> Column:
    """Runs of which at least one stands in every text that holds the term with a score of ``least``.

    Of d + 1 parts of a term one is left untouched by d edits; its first characters are the key.
    """
    n = F.length(term)
    edits = F.floor(n * F.lit(max(0.0, 1 - least)) + 1e-9)
    at = F.transform(F.sequence(F.lit(0), edits), lambda k: F.struct(F.floor(k * n / (edits + 1)).cast("int").alias("a"), F.floor((k + 1) * n / (edits + 1)).cast("int").alias("b")))
    return F.array_distinct(F.transform(at, lambda x: F.substring(term, x["a"] + 1, F.least(x["b"] - x["a"], F.lit(GRAM)))))


def glossary_hits(queries: DataFrame, glossary: DataFrame, least: float = 1.0, bidirectional: bool = False) -> DataFrame:
    """query_id, id, term, translation, score: terms in each query, by containment or, below 1, by substring distance.

    Queries and terms meet by short runs that a hit must share, whatever the size of the glossary; Spark broadcasts the
    terms where they are small.  With ``bidirectional`` a query inside a term is a hit too (containment only).
    """
    q = queries.select("query_id", C.make_cmp("query").alias("q")).filter("q <> ''")
    g = glossary.select("id", "term", "translation", F.coalesce(F.nullif("cmp", F.lit("")), C.make_cmp("term")).alias("t")).filter("t <> ''")
    terms = g.select(F.col("id").alias("gid"), "t")
    keyed = q.select("query_id", "q", F.explode(grams(F.col("q"))).alias("key"))
    met = keyed.join(terms.select("gid", "t", F.explode(_anchors(F.col("t"), least)).alias("key")), "key").drop("key")
    if least >= 1:
        met = met.filter(F.contains("q", F.col("t")))
    met = met.distinct().withColumn("score", F.lit(1.0) if least >= 1 else C.substring_score("t", "q", least)).filter(F.col("score") >= least)
    if bidirectional:
        inside = q.select("query_id", "q", F.substring("q", 1, GRAM).alias("key"))
        back = inside.join(terms.select("gid", "t", F.explode(grams(F.col("t"))).alias("key")), "key").filter(F.contains("t", F.col("q")) & ~F.contains("q", F.col("t"))).drop("key")
        met = met.unionByName(back.distinct().withColumn("score", F.lit(1.0)))
        met = met.groupBy("query_id", "q", "gid", "t").agg(F.max("score").alias("score"))
    rows = met.select("query_id", F.col("gid").alias("id"), "score").join(g.select("id", "term", "translation"), "id")
    return rows.select("query_id", "id", "term", "translation", "score", F.length("term").alias("term_len"))


def rows_with_terms(cells: DataFrame, glossary: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` of the rows whose text holds a glossary term, regardless of case."""
    terms = glossary.select(F.lower("term").alias("t")).filter("t <> ''").distinct()
    terms = terms.withColumn("key", F.substring("t", 1, GRAM))
    rows = cells.select(*keys, F.lower(text).alias("__text"))
    rows = rows.withColumn("key", F.explode(grams(F.col("__text"))))
    return rows.join(terms, "key").filter(F.contains("__text", F.col("t"))).select(*keys).distinct()


def glossary_lookup(queries: DataFrame, glossary: DataFrame, least: float = 1.0, bidirectional: bool = False, k: int | None = None) -> DataFrame:
    """``glossary_hits`` ranked by score, then longer terms, then id."""
    hits = glossary_hits(queries, glossary, least, bidirectional)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("term_len"), "id")
    out = hits.withColumn("match_rank", F.row_number().over(w).cast("bigint")).drop("term_len")
    return out if k is None else out.filter(F.col("match_rank") <= k)


def visible_terms(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits whose term stands in the raw query, regardless of case."""
    return hits.join(queries.select("query_id", "query"), "query_id").filter(F.contains(F.lower("query"), F.lower("term"))).drop("query")


def search(queries: DataFrame, memory: DataFrame, kind: str = "fuzzy", least: float = 0.7, glossary: DataFrame | None = None) -> DataFrame:
    """One door to the lookups: fuzzy, exact, reverse, glossary; concordance takes the text of a single query."""
    if kind == "fuzzy":
        return fuzzy_lookup(queries, memory, least)
    if kind == "exact":
        return exact_lookup(queries, memory)
    if kind == "reverse":
        return reverse_lookup(queries, memory, least)
    if kind == "glossary":
        return glossary_lookup(queries, memory.selectExpr("id", "source AS term", "target AS translation", "CAST(NULL AS STRING) AS cmp") if glossary is None else glossary, least, k=20)
    if kind == "concordance":
        first = queries.select("query").first()
        return concordance(memory, first["query"] if first and first["query"] else "\0")
    raise ValueError(f"no such kind of search: {kind}")


def inserts(found: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """query_id, value, record_id: the best match of each query, or the one chosen in ``ranks`` (query_id, match_rank)."""
    rows = found.filter("match_rank = 1") if ranks is None else found.join(ranks.select("query_id", "match_rank"), ["query_id", "match_rank"])
    return rows.select("query_id", F.col("target").alias("value"), F.col("id").alias("record_id"))


def statistics(memory: DataFrame, name: str | None = None, source_lang: str | None = None, target_lang: str | None = None) -> DataFrame:
    """One row: name, records, source_lang, target_lang ('N/A' where unknown)."""
    na = lambda x: F.lit(x if x else "N/A")
    return memory.agg(F.count(F.lit(1)).alias("records")).select(na(name).alias("name"), "records", na(source_lang).alias("source_lang"), na(target_lang).alias("target_lang"))
