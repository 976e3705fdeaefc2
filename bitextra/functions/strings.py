"""Text kernels on plain Python strings, for use inside Arrow functions and on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Sequence

#: full-width ASCII to ASCII, the wide blank to a blank, hiragana to katakana: one character for one
WIDTH_FROM = "".join(map(chr, (*range(0xFF01, 0xFF5F), 0x3000, *range(0x3041, 0x3097))))
WIDTH_TO = "".join(map(chr, (*range(0x21, 0x7F), 0x20, *range(0x30A1, 0x30F7))))
_WIDTH = str.maketrans(WIDTH_FROM, WIDTH_TO)
#: fixed values: ranges that count as CJK in each flavour
CJK_RANGES = {
    "js": ((0x3000, 0x9FFF), (0xF900, 0xFAFF)),
    "gs": ((0x3000, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF)),
    "py": ((0x3000, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x2A6DF)),
}
_CJK = {k: re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in r) + "]") for k, r in CJK_RANGES.items()}
TAG = re.compile(r"<[^>]+>")
_TOKEN = re.compile(r"[.,;:!?()\"'\[\]{}<>]|[^\s.,;:!?()\"'\[\]{}<>]+")
NUMBER = re.compile(r"[0-9]+(?:[.,][0-9]+)*")
_WIDE_NUMBER = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[０-９]+(?:[．，][０-９]+)*")
CAPS = re.compile(r"[A-Z][A-Z0-9]+")


def fold(text: str) -> str:
    """Width, kana and case folded; the length stays as it is for all but a few letters."""
    return text.translate(_WIDTH).lower()


def make_cmp(text: str) -> str:
    """Comparison form: tags out, folded, blanks collapsed and trimmed."""
    return " ".join(fold(TAG.sub("", text)).split())


def make_cmp_nfkc(text: str, case: bool = True, width: bool = True, kana: bool = True) -> str:
    """Comparison form by compatibility normalisation; each folding can be left out."""
    text = TAG.sub("", text)
    text = unicodedata.normalize("NFKC", text) if width else text
    text = text.lower() if case else text
    if kana:
        text = text.translate({a: a + 0x60 for a in range(0x3041, 0x3097)})
    return " ".join(text.split())


def without_accents(text: str) -> str:
    """Text without the combining marks of its decomposed form."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def contains_cjk(text: str, flavour: str = "js") -> bool:
    return _CJK[flavour].search(text) is not None


def tokenize(text: str) -> list[str]:
    """Words and single punctuation marks; blanks are dropped."""
    return _TOKEN.findall(text)


def by_char(text: str) -> bool:
    """Whether a query is compared by characters: it has CJK, or no blank."""
    return contains_cjk(text) or " " not in text


def numbers(text: str) -> list[tuple[str, int, int]]:
    """(narrow value, start, end) of each number, in either width."""
    return [(fold(m[0]), m.start(), m.end()) for m in _WIDE_NUMBER.finditer(text)]


def levenshtein(a: Sequence, b: Sequence, most: int | None = None) -> int:
    """Edit distance over characters or tokens; ``most + 1`` once it is known to exceed ``most``."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if len(a) > len(b):
        a, b = b, a
    if most is not None and len(b) - len(a) > most:
        return most + 1
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        last, row[0] = row[0], j
        for i, x in enumerate(a, 1):
            last, row[i] = row[i], last if x == y else 1 + min(last, row[i], row[i - 1])
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


def edit_score(a: str, b: str, least: float = 0.0) -> float:
    """(h - distance) / h with h the longer length; 0 beyond the budget h - floor(h * least)."""
    h = max(len(a), len(b))
    if not h:
        return 1.0
    budget = h - int(h * least)
    d = levenshtein(a, b, budget)
    return 0.0 if d > budget else (h - d) / h


def bag_distance(a: str, b: str) -> int:
    x, y = Counter(a), Counter(b)
    return ((x - y) + (y - x)).total()


def edit_lower_bound(a: str, b: str) -> int:
    return max(len(a), len(b)) - (Counter(a) & Counter(b)).total()


def substring_distance(term: str, text: str) -> int:
    """Least edit distance of ``term`` to any stretch of ``text``."""
    if not term or not text:
        return len(term)
    row = list(range(len(term) + 1))
    best = row[-1]
    for y in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(term, 1):
            last, row[i] = row[i], last if x == y else 1 + min(last, row[i], row[i - 1])
        best = min(best, row[-1])
    return best


def substring_score(term: str, text: str, least: float) -> float:
    """1 if contained, else the share of the term that survives; 0 below ``least`` or for an empty term."""
    if not term:
        return 0.0
    if term in text:
        return 1.0
    score = (len(term) - substring_distance(term, text)) / len(term)
    return score if score >= least else 0.0


_TOKEN_COST: dict[tuple[str, str], float] = {}
_TOKEN_FLOOR: dict[tuple[str, str], float] = {}
_KEPT = 500_000


def _token_cost(a: str, b: str) -> float:
    """1 - edit score of two tokens; kept, as texts share their words."""
    cost = _TOKEN_COST.get((a, b))
    if cost is None:
        if len(_TOKEN_COST) > _KEPT:
            _TOKEN_COST.clear()
        cost = _TOKEN_COST[a, b] = 1 - edit_score(a, b)
    return cost


def _token_floor(a: str, b: str) -> float:
    """A lower bound of the cost: characters that the other token lacks cannot stay."""
    cost = _TOKEN_FLOOR.get((a, b))
    if cost is None:
        if len(_TOKEN_FLOOR) > _KEPT:
            _TOKEN_FLOOR.clear()
        x, y = set(a), set(b)
        common = 0 if x.isdisjoint(y) else min(sum(c in y for c in a), sum(c in x for c in b))
        cost = _TOKEN_FLOOR[a, b] = 1 - common / max(len(a), len(b))
    return cost


def _align(x: list[str], y: list[str], cost_of, most: float) -> float:
    """Least cost of aligning two token lists; infinite once it must exceed ``most``."""
    row = [float(i) for i in range(len(x) + 1)]
    for j, t in enumerate(y, 1):
        last, row[0] = row[0], float(j)
        for i, s in enumerate(x, 1):
            here = last if s == t else last + cost_of(s, t)
            last = row[i]
            if last + 1 < here:
                here = last + 1
            if row[i - 1] + 1 < here:
                here = row[i - 1] + 1
            row[i] = here
        if min(row) > most:
            return float("inf")
    return row[-1]


def word_score(a: str, b: str, least: float = 0.0, stop: bool = False) -> float:
    """Token alignment in which replacing a token costs as much as the two differ.

    With ``stop``, 0 as soon as the score cannot reach ``least``: a cheap bound of the costs comes first.
    """
    x, y = tokenize(a), tokenize(b)
    if not x or not y:
        return edit_score(a, b, least)
    h = max(len(x), len(y))
    most = h * (1 - least) + 1e-9 if stop else float("inf")
    if stop and (abs(len(x) - len(y)) > most or _align(x, y, _token_floor, most) > most):
        return 0.0
    return max(0.0, min(1.0, (h - _align(x, y, _token_cost, most)) / h))


def fuzzy_score(query: str, source: str, least: float) -> float:
    """Score of two comparison forms; by characters or words, as the query asks for; 0 below ``least``."""
    if query == source:
        return 1.0
    h = max(len(query), len(source))
    if not h:
        return 1.0
    if min(len(query), len(source)) / h < least or edit_lower_bound(query, source) > h - int(h * least):
        return 0.0
    score = edit_score(query, source, least) if by_char(query) else word_score(query, source, least, stop=True)
    return score if score >= least else 0.0


def opening_tags(text: str) -> Counter:
    return Counter(t.lower() for t in re.findall(r"<([^>]+)>", text) if not t.startswith("/"))


def format_penalty(a: str, b: str) -> float:
    x, y = opening_tags(a), opening_tags(b)
    return ((x - y) + (y - x)).total() / 100


def char_class(c: str) -> str:
    return "L" if c.isascii() and c.isalpha() else "D" if c.isascii() and c.isdigit() else "O"


def find_bounded(text: str, folded: str, start: int = 0, low: str | None = None) -> int:
    """First place of a folded term in ``text`` whose letter or digit edges do not run on; -1 if none.

    ``low`` is the folded text, where it is at hand.
    """
    low = fold(text) if low is None else low
    at = low.find(folded, start)
    if not folded:
        return at
    head, tail = char_class(folded[0]), char_class(folded[-1])
    while at >= 0:
        end = at + len(folded)
        runs_in = head != "O" and at > 0 and char_class(text[at - 1]) == head
        runs_on = tail != "O" and end < len(text) and char_class(text[end]) == tail
        if not runs_in and not runs_on:
            return at
        at = low.find(folded, at + 1)
    return -1


def apply_casing(pattern: str, text: str) -> str:
    """``text`` in the casing of ``pattern``: upper, lower, title or sentence; as it is if the pattern has no Latin letter."""
    letters = re.findall(r"[A-Za-z]", pattern)
    if not letters:
        return text
    if pattern.upper() == pattern:
        return text.upper()
    if pattern.lower() == pattern:
        return text.lower()
    words = [re.search(r"[A-Za-z]", w) for w in pattern.split()]
    if len(words) > 1 and all(m is None or m[0].isupper() for m in words):
        return re.sub(r"(^|\s)([a-z])", lambda m: m[1] + m[2].upper(), text)
    if letters[0].isupper():
        return re.sub(r"[A-Za-z]", lambda m: m[0].upper(), text, count=1)
    return text


def escape_html(text: str | None, attribute: bool = False) -> str:
    out = (text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;") if attribute else out


def parse_a1(ref: str) -> dict | None:
    """Parts of an A1 reference: col, row, col2, row2; None if it is none."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)?(?::([A-Za-z]+)(\d+)?)?", ref or "")
    if not m:
        return None
    up = [g.upper() if g and i % 2 == 0 else g for i, g in enumerate(m.groups())]
    return {"col": up[0], "row": up[1] and int(up[1]), "col2": up[2], "row2": up[3] and int(up[3])}
