"""Parts of the checking SQL (DuckDB)."""

from __future__ import annotations

from bitextra.functions.strings import WIDTH_FROM, WIDTH_TO

BLANKS = r"[\s\x0B\x{85}\p{Z}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"lower(translate({x}, {quoted(WIDTH_FROM)}, {quoted(WIDTH_TO)}))"


def make_cmp(x: str) -> str:
    stripped = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    return f"regexp_replace(regexp_replace({fold(stripped)}, '{BLANKS}', ' ', 'g'), '^ | $', '', 'g')"


#: the symbols that ``coded`` writes characters with
_SYMBOLS = "list_reduce(list_transform(range(1, 128), lambda i: chr(CAST(i AS INTEGER))), lambda x, y: x || y)"


def coded(rows: str, a: str, b: str) -> str:
    """Subquery: ``rows`` with a_code and b_code, the two texts with each character of either written as one byte.

    The edit distance of DuckDB counts bytes; so that of the codes counts characters.  A pair may hold 127 different ones.
    """
    return f"""(SELECT *, translate({a}, alphabet, left(symbols, length(alphabet))) AS a_code, translate({b}, alphabet, left(symbols, length(alphabet))) AS b_code
        FROM (SELECT *, array_to_string(list_distinct(string_split({a} || {b}, '')), '') AS alphabet FROM {rows}), (SELECT {_SYMBOLS} AS symbols))"""


def score(a: str, b: str) -> str:
    """Edit score of two texts of a ``coded`` subquery."""
    h = f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {h} = 0 THEN 1.0::DOUBLE ELSE ({h} - levenshtein(a_code, b_code))::DOUBLE / {h} END"


def bounded(term: str) -> str:
    """Pattern that finds a folded term where its letter or digit edges do not run on."""
    def edge(c: str, first: bool) -> str:
        anchor = "^" if first else "$"
        return f"CASE WHEN regexp_matches({c}, '[a-z]') THEN '(?:{anchor}|[^a-z])' WHEN regexp_matches({c}, '[0-9]') THEN '(?:{anchor}|[^0-9])' ELSE '' END"

    return f"concat({edge(f'left({term}, 1)', True)}, regexp_escape({term}), {edge(f'right({term}, 1)', False)})"
