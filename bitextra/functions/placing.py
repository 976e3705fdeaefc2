"""Rewriting a stored target so that it fits the query: numbers, glossary terms and rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from bitextra.functions.alignment import Diff, Glossary, lexical_diffs
from bitextra.functions.strings import NUMBER, apply_casing, contains_cjk, find_bounded, fold, make_cmp, numbers, tokenize

NUMBER_LABEL, TERM_LABEL, RULE_LABEL = "数値", "用語", "ルール"
_ANY_DIGIT = re.compile(r"[0-9０-９]")


@dataclass(frozen=True)
class Resolved:
    target: str
    covered: bool
    placements: tuple[str, ...]
    uncovered: tuple[Diff, ...]


def _splice(text: str, start: int, end: int, new: str) -> str:
    return text[:start] + new + text[end:]


def _blanked(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """The spans replaced by blanks, so that positions stay."""
    for a, b in spans:
        text = _splice(text, a, b, " " * (b - a))
    return text


def place_numbers(query: str, source: str, target: str, glossary: Glossary, diffs: Sequence[Diff] | None = None) -> str | None:
    """Target with the query's numbers in the places of the source's; None if nothing is placed.

    Places go by position, so the three texts must hold equally many numbers.  Where the two sides' differing
    stretches hold different numbers of digits, those belong to the wording and are left out of the count, as are
    the digits of the translations of such stretches.
    """
    if not query or not source or not target or query == source:
        return None
    diffs = lexical_diffs(query, source, glossary) if diffs is None else diffs
    count = lambda texts: sum(len(_ANY_DIGIT.findall(t)) for t in texts)
    q, s, t = query, source, target
    if count(d.q_text for d in diffs) != count(d.s_text for d in diffs):
        q = _blanked(query, [(d.q_start, d.q_end) for d in diffs])
        s = _blanked(source, [(d.s_start, d.s_end) for d in diffs])
        for d in diffs:
            entry = glossary.get(d.s_text)
            at = target.find(entry["translation"]) if entry and entry.get("translation") else -1
            if at >= 0:
                t = _blanked(t, [(at, at + len(entry["translation"]))])
    slots = [numbers(x) for x in (q, s, t)]
    if not slots[0] or len({len(x) for x in slots}) > 1:
        return None
    changes = [(c[1], c[2], a[0]) for a, b, c in zip(*slots) if a[0] != b[0]]
    for start, end, new in reversed(changes):
        target = _splice(target, start, end, new)
    return target if changes else None


def place_numbers_strict(query: str, source: str, target: str) -> str | None:
    """As ``place_numbers``, but a place counts only if source and target agree on the number there."""
    if not query or not source or not target or query == source:
        return None
    slots = [[(m[0], m.start(), m.end()) for m in NUMBER.finditer(fold(x))] for x in (query, source, target)]
    if not slots[0] or len({len(x) for x in slots}) > 1:
        return None
    changes = [(a, b, c) for a, b, c in zip(*slots) if a[0] != b[0]]
    if not changes or any(b[0] != c[0] for _, b, c in changes):
        return None
    for a, _, c in reversed(changes):
        target = _splice(target, c[1], c[2], a[0])
    return target


def compile_rules(rules: Sequence[dict]) -> list[tuple[re.Pattern, str]]:
    """Enabled rules in order; a null flag counts as enabled, invalid patterns are left out."""
    out = []
    for r in rules:
        if r.get("enabled") is not False and r.get("source_pattern") is not None:
            try:
                out.append((re.compile(r["source_pattern"]), r.get("target_template") or ""))
            except re.error:
                continue
    return out


def _filled(template: str, m: re.Match) -> str:
    groups = (m[0], *(g or "" for g in m.groups()))
    return re.sub(r"\\(\d+)", lambda k: groups[int(k[1])] if int(k[1]) < len(groups) else "", template)


def place_rules(query: str, source: str, target: str, rules: Sequence[tuple[re.Pattern, str]]) -> str | None:
    """Each rule's template, filled from the source, is replaced by the one filled from the query where it occurs once."""
    if not query or not source or not target or query == source:
        return None
    placed = False
    for pattern, template in rules:
        s, q = pattern.search(source), pattern.search(query)
        if s and q:
            old, new = _filled(template, s), _filled(template, q)
            at = target.find(old)
            if old != new and at >= 0 and target.find(old, at + len(old)) < 0:
                target, placed = _splice(target, at, at + len(old), new), True
    return target if placed else None


def place_term(query: str, source: str, target: str, glossary: Glossary) -> tuple[str, str, str] | None:
    """(target, from, to) where the texts differ in one stretch and both sides of it are terms; None otherwise."""
    if not query or not source or not target or query == source or not glossary.entries:
        return None
    qc, sc = make_cmp(query), make_cmp(source)
    chars = contains_cjk(query)
    q, s = (list(x) if chars else tokenize(x) for x in (qc, sc))
    head = 0
    while head < min(len(q), len(s)) and q[head] == s[head]:
        head += 1
    tail = 0
    while tail < min(len(q), len(s)) - head and q[-1 - tail] == s[-1 - tail]:
        tail += 1
    to, from_ = (("" if chars else " ").join(x[head : len(x) - tail]).strip() for x in (q, s))
    new, old = glossary.get(to) if to else None, glossary.get(from_) if from_ else None
    if qc == sc or not new or not old or not new.get("translation") or not old.get("translation"):
        return None
    needle = fold(old["translation"])
    at = find_bounded(target, needle)
    if at < 0 or find_bounded(target, needle, at + 1) >= 0:
        return None
    end = at + len(old["translation"])
    return _splice(target, at, end, apply_casing(target[at:end], new["translation"])), from_, to


def _unrelated(new: dict, old: dict, query: str, source: str) -> bool:
    """Two terms without a common character, one of which also stands on the other side: no counterparts."""
    a, b = fold(new["term"]), fold(old["term"])
    return not set(a) & set(b) and (a in fold(source) or b in fold(query))


def resolve(query: str, source: str, target: str, glossary: Glossary, rules: Sequence[tuple[re.Pattern, str]]) -> Resolved:
    """Apply numbers, then terms difference by difference, then rules; covered if no lexical difference is left."""
    diffs = lexical_diffs(query, source, glossary)
    placements: list[str] = []
    placed = place_numbers(query, source, target, glossary, diffs)
    if placed is not None:
        target = placed
        placements.append(NUMBER_LABEL)
    left: list[Diff] = []
    for d in diffs:
        new, old = glossary.get(d.q_text), glossary.get(d.s_text)
        if new and old and not _unrelated(new, old, query, source):
            translation = old.get("translation") or ""
            at = find_bounded(target, fold(translation))
            if at >= 0:
                end = at + len(translation)
                target = _splice(target, at, end, apply_casing(target[at:end], new.get("translation") or ""))
                if TERM_LABEL not in placements:
                    placements.append(TERM_LABEL)
                continue
        left.append(replace(d, q_registered=new is not None, s_registered=old is not None))
    placed = place_rules(query, source, target, rules)
    if placed is not None:
        target = placed
        placements.append(RULE_LABEL)
    return Resolved(target, not left, tuple(placements), tuple(left))
