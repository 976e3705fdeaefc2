"""Differences between two texts as spans, from an edit-distance table walked back with a chosen preference.

Spans are half-open character ranges.  All functions are plain Python on strings; ``operators.placement`` and
``operators.rendering`` run them over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from bitextra.functions.strings import by_char, escape_html, fold, make_cmp, tokenize

MATCH, SWAP, QUERY, SOURCE = "match", "swap", "query", "source"
_DIGITS = re.compile(r"[0-9.,０-９．，]")
_DIGITS_ONLY = re.compile(r"[0-9.,０-９．，]+")


@dataclass(frozen=True)
class Diff:
    """A stretch that differs: what the query has, what the source has, and where."""

    q_text: str
    s_text: str
    q_start: int
    q_end: int
    s_start: int
    s_end: int
    q_registered: bool = False
    s_registered: bool = False


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int
    kind: str  # 'atom', 'digit' or 'other'


class Glossary:
    """Terms for lookups: by comparison form (the first entry wins) and as one scanner for occurrences in folded text."""

    def __init__(self, entries: Sequence[dict]):
        self.entries = [e for e in entries if e.get("term")]
        self.by_cmp: dict[str, dict] = {}
        for e in self.entries:
            self.by_cmp.setdefault(e.get("cmp") or make_cmp(e["term"]), e)
        terms = sorted({fold(e["term"]) for e in self.entries}, key=len, reverse=True)
        self._scan = re.compile("|".join(map(re.escape, terms))) if terms else None

    def get(self, text: str) -> dict | None:
        return self.by_cmp.get(make_cmp(text))

    def atoms(self, text: str) -> list[tuple[int, int]]:
        """Occurrences of terms, leftmost and longest first, without overlap."""
        return [m.span() for m in self._scan.finditer(fold(text))] if self._scan else []


NO_GLOSSARY = Glossary(())


def table(a: Sequence, b: Sequence) -> list[list[int]]:
    """Edit distances of all prefixes."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        above, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] if x == y else 1 + min(above[j], row[-1], above[j - 1]))
        rows.append(row)
    return rows


def walk(a: Sequence, b: Sequence, prefer: Sequence[str]) -> Iterator[tuple[str, int, int]]:
    """Steps of a cheapest alignment from the end: (kind, i, j), with the indexes after the step.

    Equal elements on the diagonal are taken first; ``prefer`` orders the other kinds where several cost the same.
    """
    d, i, j = table(a, b), len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and d[i][j] == d[i - 1][j - 1]:
            i, j, kind = i - 1, j - 1, MATCH
        else:
            for kind in prefer:
                if kind == SWAP and i and j and d[i][j] == d[i - 1][j - 1] + 1:
                    i, j = i - 1, j - 1
                    break
                if kind == SOURCE and j and d[i][j] == d[i][j - 1] + 1:
                    j -= 1
                    break
                if kind == QUERY and i and d[i][j] == d[i - 1][j] + 1:
                    i -= 1
                    break
        yield kind, i, j


def glossary_tokens(text: str, glossary: Glossary, chars: bool) -> list[Token]:
    """Terms as one token each; between them single characters, or words between blanks."""
    out: list[Token] = []

    def plain(start: int, end: int) -> None:
        spans = ((k, k + 1) for k in range(start, end)) if chars else (m.span() for m in re.compile("[^ ]+").finditer(text, start, end))
        for a, b in spans:
            out.append(Token(text[a:b], a, b, "digit" if _DIGITS_ONLY.fullmatch(text[a:b]) else "other"))

    at = 0
    for a, b in glossary.atoms(text):
        plain(at, a)
        out.append(Token(text[a:b], a, b, "atom"))
        at = b
    plain(at, len(text))
    return out


def lexical_diffs(query: str, source: str, glossary: Glossary = NO_GLOSSARY) -> list[Diff]:
    """What differs besides numbers, from right to left.

    Insertions and deletions are preferred to replacements, so that a shared particle stays a match.  Neighbouring
    replacements whose kinds of token change on both sides are kept apart.  Stretches that differ in digits only are
    left out.  Stretches that hold terms on both sides are cut at the pairs that share most characters.
    """
    if not query or not source or query == source:
        return []
    chars = by_char(query)
    q, s = glossary_tokens(query, glossary, chars), glossary_tokens(source, glossary, chars)
    runs: list[list[tuple[str, int, int]]] = [[]]
    for step in walk([fold(t.text) for t in q], [fold(t.text) for t in s], (SOURCE, QUERY, SWAP)):
        kind, i, j = step
        if kind == MATCH:
            runs.append([])
            continue
        run = runs[-1]
        if kind == SWAP and run and all(k == SWAP for k, _, _ in run):
            _, pi, pj = run[-1]
            if q[i].kind != q[pi].kind and s[j].kind != s[pj].kind:
                runs.append([])
        runs[-1].append(step)
    out: list[Diff] = []
    for run in runs:
        if not run:
            continue
        qs = [i for k, i, _ in run if k in (SWAP, QUERY)]
        ss = [j for k, _, j in run if k in (SWAP, SOURCE)]
        a, b = (q[qs[-1]].start, q[qs[0]].end) if qs else (0, 0)
        c, e = (s[ss[-1]].start, s[ss[0]].end) if ss else (0, 0)
        if _DIGITS.sub("", query[a:b]) != _DIGITS.sub("", source[c:e]):
            out += _at_term_pairs(Diff(query[a:b], source[c:e], a, b, c, e), glossary)
    return [_rotated(x, query, source) for x in out]


def _at_term_pairs(diff: Diff, glossary: Glossary) -> list[Diff]:
    """Cut a stretch so that each pair of related terms stands by itself."""
    out: list[Diff] = []
    rest: Diff | None = diff
    while rest is not None:
        here, rest = rest, None
        qa, sa = glossary.atoms(here.q_text), glossary.atoms(here.s_text)
        pair = _closest(here, qa[0], sa) if qa and sa else None
        if pair is None:
            out.append(here)
            break
        (a, b), (c, e) = qa[0], pair
        if a or c:
            out += _at_term_pairs(_part(here, 0, a, 0, c), glossary)
        out.append(_part(here, a, b, c, e))
        if b < len(here.q_text) or e < len(here.s_text):
            rest = _part(here, b, len(here.q_text), e, len(here.s_text))
    return out


def _part(d: Diff, a: int, b: int, c: int, e: int) -> Diff:
    return Diff(d.q_text[a:b], d.s_text[c:e], d.q_start + a, d.q_start + b, d.s_start + c, d.s_start + e)


def _closest(d: Diff, atom: tuple[int, int], others: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The first source term that shares most characters with the query's term; None if none shares any."""
    own = set(fold(d.q_text[slice(*atom)]))
    shared = [sum(ch in own for ch in fold(d.s_text[slice(*o)])) for o in others]
    best = max(range(len(others)), key=shared.__getitem__)
    return others[best] if shared[best] else None


def _rotated(d: Diff, query: str, source: str) -> Diff:
    """Move a pure insertion or deletion to the right while that leaves the texts as they are."""
    if bool(d.q_text) == bool(d.s_text):
        return d
    text, a, b = (query, d.q_start, d.q_end) if d.q_text else (source, d.s_start, d.s_end)
    while b < len(text) and text[a] == text[b]:
        a, b = a + 1, b + 1
    if d.q_text:
        return replace(d, q_text=text[a:b], q_start=a, q_end=b)
    return replace(d, s_text=text[a:b], s_start=a, s_end=b)


def changed_regions(original: str, placed: str) -> list[tuple[int, int]]:
    """(start, length) of what placement changed, in the placed text, left to right."""
    if original == placed:
        return []
    if not original or not placed:
        return [(0, len(placed or ""))]
    head = 0
    while head < min(len(original), len(placed)) and original[head] == placed[head]:
        head += 1
    tail = 0
    while tail < min(len(original), len(placed)) - head and original[-1 - tail] == placed[-1 - tail]:
        tail += 1
    a, b = original[head : len(original) - tail], placed[head : len(placed) - tail]
    out: list[list[int]] = []
    fresh = True
    for kind, _, j in walk(a, b, (SWAP, SOURCE, QUERY)):
        if kind == MATCH:
            fresh = True
        elif kind != QUERY:
            if fresh:
                out.append([j, j + 1])
                fresh = False
            out[-1][0] = j
    return [(head + x, y - x) for x, y in reversed(out)]


def uncertain_regions(changed: Sequence[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """(start, length) of what lies between the changed regions."""
    out, at = [], 0
    for start, size in sorted(changed):
        if start > at:
            out.append((at, start - at))
        at = start + size
    return out + ([(at, length - at)] if at < length else [])


def format_runs(text: str, placed: Sequence[tuple[int, int]], unverified: Sequence[tuple[int, int]]) -> list[tuple[int, str]]:
    """(start, style) runs over ``text`` from half-open ranges; 'placed' beats 'unverified', the rest is 'plain'."""
    n = len(text or "")
    style = ["plain"] * n
    for name, ranges in (("unverified", unverified), ("placed", placed)):
        for a, b in ranges:
            style[a:b] = [name] * len(style[a:b])
    runs = [(0, style[0] if style else "plain")]
    starts = {a for a, _ in placed} | {b for _, b in placed}
    for k in range(1, n):
        if style[k] != style[k - 1] or style[k] == "placed" and k in starts:
            runs.append((k, style[k]))
    return runs


# rendering


def term_regions(text: str, hits: Sequence[dict]) -> list[tuple[int, int, str]]:
    """(start, end, translation) of the hits' terms, in the order of the hits, without overlap."""
    low, out = fold(text or ""), []
    for h in hits if text else ():
        term = fold(h["term"])
        for m in re.finditer(re.escape(term), low) if term else ():
            if all(m.end() <= a or m.start() >= b for a, b, _ in out):
                out.append((m.start(), m.end(), h.get("translation") or ""))
    return sorted(out)


def _tip(translation: str) -> str:
    return f'<span class="gloss_match" data-tip="{escape_html(translation, True)}">'


def mark_terms(text: str, hits: Sequence[dict]) -> str | None:
    """HTML with the terms marked; None if there are none."""
    regions = term_regions(text, hits)
    return _layers(text, [(a, b, _tip(t)) for a, b, t in regions]) if regions else None


def uncovered_regions(text: str, diffs: Sequence[Diff], side: str) -> list[tuple[int, int, str]]:
    """(start, end, classes) of unresolved stretches on side 'q' or 's'; earlier ones win over overlapping ones."""
    found = []
    for d in diffs if text else ():
        a, b, known = (d.q_start, d.q_end, d.q_registered) if side == "q" else (d.s_start, d.s_end, d.s_registered)
        if 0 <= a < b <= len(text):
            cls = f"diff-uncovered-{'present' if known else 'missing'}"
            if side == "q" and not d.s_text:
                cls += " diff-uncovered-add"
            if side == "s" and not d.q_text:
                cls += " diff-uncovered-remove"
            found.append((a, b, cls))
    out: list[tuple[int, int, str]] = []
    for r in sorted(found, key=lambda r: r[:2]):
        if not out or r[0] >= out[-1][1]:
            out.append(r)
    return out


def mark_uncovered(text: str, diffs: Sequence[Diff], side: str) -> str:
    return _layers(text, [(a, b, f'<span class="{c}">') for a, b, c in uncovered_regions(text, diffs, side)])


def render_query(text: str, hits: Sequence[dict], diffs: Sequence[Diff]) -> str | None:
    """HTML of a query with both its terms and its unresolved stretches; None without either."""
    terms = [(a, b, _tip(t)) for a, b, t in term_regions(text, hits)]
    open_ = [(a, b, f'<span class="{c}">') for a, b, c in uncovered_regions(text, diffs, "q")]
    return _layers(text, open_, terms) if terms or open_ else None


def _layers(text: str, *layers: Sequence[tuple[int, int, str]]) -> str:
    """Text with the spans of all layers, closed and opened again wherever any layer changes."""
    edges = sorted({0, len(text), *(e for layer in layers for a, b, _ in layer for e in (a, b))})
    out: list[str] = []
    for a, b in zip(edges, edges[1:]):
        tags = [tag for layer in layers for x, y, tag in layer if x <= a and b <= y]
        out.append("".join(tags) + escape_html(text[a:b]) + "</span>" * len(tags))
    return "".join(out)


def highlight(query: str, source: str, hits: Sequence[dict] = ()) -> tuple[str, str]:
    """HTML of the query and of the source, by match, replacement, insertion and deletion."""
    if not query or not source:
        return escape_html(query), escape_html(source)
    if query == source:
        same = f'<span class="diff-match">{escape_html(query)}</span>'
        return same, same
    chars = by_char(query)
    q, s = (list(t) if chars else tokenize(t) for t in (query, source))
    steps = list(walk([fold(t) for t in q], [fold(t) for t in s], (SWAP, QUERY, SOURCE)))[::-1]
    name = {MATCH: "match", SWAP: "sub", QUERY: "del", SOURCE: "ins"}
    groups: list[list] = []
    for kind, i, j in steps:
        if not groups or groups[-1][0] != name[kind]:
            groups.append([name[kind], [], []])
        if kind != SOURCE:
            groups[-1][1].append(q[i])
        if kind != QUERY:
            groups[-1][2].append(s[j])
    groups = _whole_numbers(groups, "" if chars else " ")
    glue = "" if chars else " "
    source_html = glue.join(f'<span class="diff-{g[0]}">{escape_html(glue.join(g[2]))}</span>' for g in groups if g[0] != "del")
    spans, at = [], 0
    for kind, tokens, _ in groups:
        if kind != "ins":
            size = sum(map(len, tokens))
            spans.append((at, at + size, f'<span class="diff-{kind}">'))
            at += size
    text = "".join("".join(g[1]) for g in groups if g[0] != "ins")
    terms = [(a, min(b, at), _tip(t)) for a, b, t in term_regions(query, hits) if a < at]
    return _layers(text, terms, [x for x in spans if x[1] > x[0]]), source_html


def _whole_numbers(groups: list[list], glue: str) -> list[list]:
    """Replacements that touch a number take the whole of it from the matches beside them."""
    def digit(t: str) -> bool:
        return len(t) == 1 and "0" <= t <= "9"

    for k, g in enumerate(groups):
        if g[0] != "sub" or not re.search("[0-9]", glue.join(g[1]) + glue.join(g[2])):
            continue
        for beside, end in ((k - 1, -1), (k + 1, 0)):
            if 0 <= beside < len(groups) and groups[beside][0] == "match":
                other = groups[beside]
                while other[1] and digit(other[1][end]):
                    for side in (1, 2):
                        if other[side]:
                            token = other[side].pop(end)
                            g[side].insert(0 if end else len(g[side]), token)
    return [g for g in groups if g[1] or g[2]]


def mark_changed(text: str, changed: Sequence[tuple[int, int]]) -> str:
    """HTML of a placed target with what placement changed."""
    return _layers(text, [(a, a + n, '<span class="placed">') for a, n in changed])
