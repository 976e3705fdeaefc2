"""Find and replace with tagged expressions: ``cat``, ``source:cat``, ``regex:c[ao]t``, ``reliability:5``, ``field:*``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.functions import columns as C
from bitextra.functions.strings import fold

TEXT_FIELDS = ("source", "target", "context", "created_by", "modified_by")
#: fixed values: tags and the fields they name
FIELDS = {
    "source": "source", "trans": "target", "target": "target", "context": "context", "created-by": "created_by", "modified-by": "modified_by",
    "reliability": "reliability", "validated": "validated", "refcount": "refcount", "created": "created", "modified": "modified",
}


@dataclass(frozen=True)
class Expression:
    value: str
    field: str | None = None
    regex: bool = False
    star: bool = False


def parse(text: str | None) -> Expression:
    """An unknown tag is part of the text."""
    text = text or ""
    if text[:6].lower() == "regex:":
        return Expression(text[6:], regex=True)
    tag, colon, value = text.partition(":")
    field = FIELDS.get(tag.lower()) if colon else None
    if field is None:
        return Expression(text)
    return Expression("" if value == "*" else value, field, star=value == "*")


def _template(new: str, groups: int) -> str:
    """The replacement with ``$1`` to ``$99`` and ``$&`` in the engine's notation; a number without a group stays as it is."""
    def written(m: re.Match) -> str:
        if m[0] == "$&":
            return "$0"
        if m[1] and 1 <= int(m[1]) <= groups:
            return f"${int(m[1])}"
        if m[1] and len(m[1]) == 2 and 1 <= int(m[1][0]) <= groups:
            return f"${m[1][0]}\\{m[1][1]}"
        return "".join("\\" + c if c in "\\$" else c for c in m[0])

    return re.sub(r"\$(\d{1,2})|\$&|[\\$]", written, new)


def find(records: DataFrame, text: str) -> DataFrame:
    """Records that hold the expression, with match_field, the first field that does. Invalid patterns find nothing.

    An empty value is in every field that is not null; numbers, flags and dates are matched as text.
    """
    e = parse(text)
    if e.regex and C.pattern_groups(e.value) is None:
        return records.withColumn("match_field", F.lit("")).limit(0)

    def holds(c: str) -> Column:
        s = F.col(c).cast("string")
        hit = F.regexp_like(s, F.lit(f"(?iu){e.value}")) if e.regex else F.contains(C.fold(s), F.lit(fold(e.value)))
        return F.coalesce(hit, F.lit(False))

    fields = [e.field] if e.field else TEXT_FIELDS
    field = F.coalesce(*[F.when(holds(c), F.lit(c)) for c in fields])
    return records.withColumn("match_field", field).filter(F.col("match_field").isNotNull())


def coerce(field: str, raw: str):
    """The value of a field from text: whole numbers by their leading digits, else 0; true, 1, yes; dates or None."""
    raw = raw.strip() if field not in TEXT_FIELDS else raw
    if field in ("refcount", "reliability"):
        m = re.match(r"[+-]?\d+", raw)
        return int(m[0]) if m else 0
    if field == "validated":
        return raw.lower() in ("true", "1", "yes")
    if field in ("created", "modified"):
        try:
            at = datetime.fromisoformat(raw)
            return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
        except ValueError:
            return None
    return raw


def replace(records: DataFrame, old: str, new: str) -> DataFrame:
    """All records after the replacement, with ``changed`` (bool); comparison forms, where present, are made anew.

    ``field:*`` overwrites the field everywhere.  Numbers, flags and dates are set where they equal the old value.
    Texts: every match of the pattern, with ``$1`` for groups, or every occurrence of the folded text.  An empty text
    and an invalid pattern change nothing.
    """
    a, b = parse(old), parse(new)
    if a.star and a.field:
        value = coerce(a.field, b.value)
        out = records.withColumns({a.field: F.lit(value).cast(records.schema[a.field].dataType), "changed": F.lit(True)})
        return _refreshed(out)
    if a.field and a.field not in TEXT_FIELDS:
        kind = records.schema[a.field].dataType
        was, will = (F.lit(coerce(a.field, x.value)).cast(kind) for x in (a, b))
        hit = F.col(a.field).eqNullSafe(was)
        return records.withColumn("changed", hit).withColumn(a.field, F.when(hit, will).otherwise(F.col(a.field)))
    fields = [f for f in ([a.field] if a.field else TEXT_FIELDS) if f in records.columns]
    groups = C.pattern_groups(a.value) if a.regex else None
    needle = fold(a.value)
    if not fields or (a.regex and groups is None) or (not a.regex and not needle):
        return records.withColumn("changed", F.lit(False))
    if a.regex:
        fresh = {f: F.regexp_replace(F.col(f), f"(?iu){a.value}", _template(b.value, groups)) for f in fields}
        differ = F.lit(False)
        for f, column in fresh.items():
            differ = differ | F.coalesce(column != F.col(f), F.lit(False))
        return _refreshed(records.withColumn("changed", differ).withColumns(fresh))
    # only rows that hold the text leave the JVM
    may = F.lit(False)
    for f in fields:
        may = may | F.coalesce(F.contains(C.fold(f), F.lit(needle)), F.lit(False))

    def edit(s: str | None) -> str | None:
        if s is None:
            return None
        low, out, at = fold(s), [], 0
        while (hit := low.find(needle, at)) >= 0:
            out.append(s[at:hit] + b.value)
            at = hit + len(needle)
        return "".join([*out, s[at:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            fresh = {f: p[f].map(edit, na_action="ignore") for f in fields}
            p["changed"] = False
            for f, column in fresh.items():
                p["changed"] |= (column != p[f]) & p[f].notna()
                p[f] = column
            yield p

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in records.schema) + ", changed boolean"
    touched = records.filter(may).mapInPandas(run, schema)
    return _refreshed(touched.unionByName(records.filter(~may).withColumn("changed", F.lit(False))))


def _refreshed(df: DataFrame) -> DataFrame:
    forms = {f"{c}_cmp": C.make_cmp(c) for c in ("source", "target") if f"{c}_cmp" in df.columns}
    if "source_len" in df.columns:
        forms["source_len"] = F.length(C.make_cmp("source"))
    return df.withColumns(forms) if forms else df


def replaced_counts(replaced: DataFrame, fields: int = 1) -> DataFrame:
    """One row: changed, scanned_fields."""
    return replaced.agg(F.count_if("changed").alias("changed"), (F.count(F.lit(1)) * fields).alias("scanned_fields"))
