"""Text figures of each document, and whether it is running prose or a list, table or junk.

A document is cut into blocks of neighbouring lines of one layout; hard-wrapped lines of sentences belong together.
Every block is assigned the nearest structural profile.  A profile has a layout, shares of function words by rank,
shares of character classes and a way to end; the distance is the weighted sum of the Jensen-Shannon divergences of
these.  Prose has a profile for each language, with the function words of that language; lists have profiles of marked
entries, of items between commas and of bare lines; tables of rows; junk of markup, of data residue, of repeated words
and of runs without sentences.  A document is prose if at least half of its non-blank characters are.

Prose profiles come from the common-word table and at most ``MAX_SAMPLES`` labelled samples; the profiles without
sentences have no function words and the block's own character classes without punctuation.  The figures are null for
null texts; empty and blank texts have zero counts, null shares and the kind 'blank'.  In Chinese and Japanese, which
part no words by blanks, common word pieces count as words, and what is left is cut where the script changes and into
runs of at most two Han characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_SAMPLES = 20_000
#: common words of a language; those after the last of ``RANKS`` but one are one group, so far fewer would do
MAX_WORDS = 20_000
UNSPACED = frozenset({"ja", "zh", "ko"})
#: weights of the function words, the character classes, the layout and the ending
WORDS, CLASSES, LAYOUT, ENDING = 0.75, 0.25, 1.0, 0.001
#: function words are told apart by these ranks only
RANKS = (4, 12, 1_000)
#: what is added to the distance of prose for several lines that never end a sentence, for one, and with the end of a
#: statement; short prose scatters around 0
SHORT_LINES, LEAST, LEAST_STOPPED = 0.04, 0.0, -0.06
#: structural profiles without sentences: layout and kind, and for plain layouts the shares of endings (several lines,
#: one short line, a long one with separators, a long one, one without blanks)
STRUCTURES = (
    ("entry", "list", None), ("items", "list", None), ("row", "table", None), ("markup", "junk", None), ("data", "junk", None), ("repeat", "junk", None),
    ("run", "list", (0.4, 0.3, 0.3, 0.0, 0.0)), ("run", "junk", (0.0, 0.0, 0.0, 0.5, 0.5)),
)

_ENTRY = re.compile(r"\s*(?:[-*•‣◦▪·–—+>]|\[[ xX✓✔]?\]|[☐☑☒]|\(?\d{1,4}[.)）、](?!\d)|\(?[A-Za-z][.)](?=\s)|[①-⑳])\s*\S")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&(?:#\d+|[a-z]+);|<!--.*?-->")
_RULE = re.compile(r"[\s|:+=_*~#.\-─━═]+$")
_CELL = re.compile(r'\s*"?\s*(?:[\d.,%+\-:/ ]*|Yes|No|true|false|null)\s*"?\s*$', re.I)
_ENDS = re.compile(r"[.!?…。！？｡:：]['\"”’」』)\]）]*\s*$")
_WORD = re.compile(r"[^\W\d_]+")
_WIDE_GAP = re.compile(r"\S {2,}(?=\S)")
#: the end of a statement; a question mark also ends entries such as "Sell it?"
_STOP = re.compile(r"[^\W\d_][.!…](?=[\s'\"”’」』)\]）<]|$)|[。！｡]")
_RESIDUE = re.compile(r"<(?!/|(?:p|b|i|u|em|strong|br|span|a|sub|sup|div|color)\b)[A-Za-z]")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")


def _class(ch: str) -> int:
    k = unicodedata.category(ch)
    if ch in ".!?。！？…｡":
        return 0
    if ch in ",;:、，；：":
        return 1
    if k in ("Lu", "Lt"):
        return 2
    if k == "Ll":
        return 3
    if k[0] == "N":
        return 4
    if k[0] in "ZC":
        return 5
    if k[0] == "L":
        return 6 if "぀" <= ch <= "ヿ" else 7 if "㐀" <= ch <= "鿿" else 8 if "가" <= ch <= "힣" else 9
    return 10 if k[0] == "P" else 11


class _Classes(dict):
    def __missing__(self, point: int) -> str:
        self[point] = out = "abcdefghijkl"[_class(chr(point))]
        return out


_CLASSES = _Classes()


def _classes(text: str) -> list[float]:
    t = text.translate(_CLASSES)
    n = len(t) or 1
    return [t.count(c) / n for c in "abcdefghijkl"]


def divergence(p: list[float], q: list[float]) -> float:
    """Jensen-Shannon divergence in bits."""
    out = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        if a:
            out += a * log2(a / m) / 2
        if b:
            out += b * log2(b / m) / 2
    return out


class Prose:
    """Function words and profiles of each language."""

    def __init__(self, words: list[tuple[str, str]], samples: list[tuple[str, str]]):
        self.words: dict[str, dict[str, int]] = {}
        for lang, word in words:
            own = self.words.setdefault(lang, {})
            own.setdefault(word.lower(), len(own))
        self.pieces = {
            lang: re.compile("|".join(sorted(map(re.escape, own), key=len, reverse=True)))
            for lang, own in self.words.items() if lang in UNSPACED
        }
        self.group = {lang: {w: sum(k >= r for r in RANKS[:-1]) for w, k in own.items()} for lang, own in self.words.items()}
        self.function: dict[str, list[float]] = {}
        self.classes: dict[str, list[float]] = {}
        for lang in self.words:
            text = " ".join(t for at, t in samples if at == lang and t)
            if text:
                self.function[lang] = self.distribution(text.lower(), lang)
                self.classes[lang] = _classes(text)
        self.everywhere = frozenset(w for lang, own in self.words.items() if lang not in UNSPACED for w in own)

    def distribution(self, lower: str, lang: str, found: Counter | None = None) -> list[float]:
        """Share of the function words of ``lang`` by rank, coarsely, as short texts have few; last, everything else."""
        own = self.group[lang]
        out = [0.0] * (len(RANKS) + 1)
        if lang in UNSPACED:
            total = sum(map(str.isalpha, lower))
            for piece, k in Counter(self.pieces[lang].findall(lower)).items():
                out[own[piece]] += k * len(piece)
        else:
            found = Counter(_WORD.findall(lower)) if found is None else found
            total = found.total()
            for word, at in own.items():
                out[at] += found.get(word, 0)
        total = max(total, sum(out), 1)
        out[-1] = total - sum(out)
        return [x / total for x in out]

    def candidates(self, shape: list[float]) -> list[str]:
        """Languages whose script a text of these character classes is in."""
        kana, han, hangul = shape[6:9]
        if max(kana + han, hangul) < 0.33:
            return [lang for lang in self.function if lang not in UNSPACED]
        best = "ko" if hangul > kana + han else "ja" if kana * 5 > han else "zh"
        return [best] if best in self.function else []

    def nearest(self, text: str, layout: str, ending: int, offset: float, found: Counter | None = None) -> tuple[str, str | None]:
        """Kind and, for prose, language of the profile nearest to a block."""
        lower, shape = text.lower(), _classes(text)
        flat = [x if k not in (0, 1) else 0.0 for k, x in enumerate(shape)]
        total = sum(flat) or 1.0
        unpunctuated = CLASSES * divergence(shape, [x / total for x in flat])
        best, kind, lang = float("inf"), "junk", None
        plain = LAYOUT * (layout != "run") + offset
        languages = self.candidates(shape)
        wordless = 0.0 if not languages else float("inf")
        for at in languages:
            words = self.distribution(lower, at, found)
            prose = plain + WORDS * divergence(words, self.function[at]) + CLASSES * divergence(shape, self.classes[at])
            bare = WORDS * divergence(words, [0.0] * (len(words) - 1) + [1.0])
            # the language is that in which prose is nearest against no prose
            if prose - bare < best:
                best, lang, wordless, near = prose - bare, at, bare, prose
        near = near if languages else float("inf")
        own = [float(k == ending) for k in range(5)]
        best = near
        kind = "prose"
        for at, name, ends in STRUCTURES:
            d = LAYOUT * (at != layout) + wordless + unpunctuated + (ENDING * (divergence(own, list(ends)) - 1) if ends else 0.0)
            if d < best:
                best, kind = d, name
        return (kind, lang) if kind == "prose" else (kind, None)


def _delimited(lines: list[str]) -> list[bool]:
    """Rows of a table: framed by bars, quoted cells, or the same delimiters as a neighbouring row."""
    out = []
    counts = [[line.count(c) for c in ";,"] for line in lines]
    for i, line in enumerate(lines):
        s = line.strip()
        row = len(_WIDE_GAP.findall(s)) > 1 or (s.startswith("|") and s.count("|") > 1) or s.count(" | ") > 1 or s.count('";"') > 1 or s.count('","') > 1 or s.count("\t") > 1
        if not row:
            for k, c in enumerate(";,"):
                n = counts[i][k]
                if n > 2 and any(0 <= j < len(lines) and counts[j][k] == n for j in (i - 1, i + 1)):
                    cells = line.split(c)
                    if sum(1 for x in cells if _CELL.match(x)) > 0 or c == ";":
                        row = True
        out.append(row)
    return out


def _short(line: str) -> bool:
    return len(line) < 50 and len(line.encode()) < 50


def blocks(text: str, everywhere: frozenset[str] = frozenset()) -> list[tuple[str, str, int]]:
    """(layout, text, lines): layout is 'entry', 'row', 'markup', 'data' or 'run'; blank lines are left out."""
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    if not lines:
        return []
    rows = _delimited(lines) if any(c in text for c in ("|", ";", ",", "\t", "   ")) else [False] * len(lines)
    kinds = []
    for line, row in zip(lines, rows):
        s = line.strip()
        kind = "run"
        if "<" in s or "&" in s:
            rest = _TAG.sub("", s)
            if len(s) - len(rest) > 0.35 * len(s) or len(_RESIDUE.findall(s)) > 2:
                kind = "markup"
        if kind == "run":
            if row or _RULE.match(s):
                kind = "row"
            elif s[0] in "{[" and ('":' in s or '",' in s) or s[0] in "}]" and len(s) < 3:
                kind = "data"
            elif _ENTRY.match(s):
                kind = "entry"
            elif (" " not in s and len(s) > 12 and s.isascii()) or sum(map(str.isalpha, s)) * 2 < len(s) - s.count(" "):
                kind = "data"
        kinds.append(kind)
    out: list[tuple[str, str, int]] = []
    running: list[str] = []  # lines of sentences, however they are wrapped
    entries: list[str] = []  # neighbouring lines without the end of a sentence or any function word

    def close() -> None:
        if len(entries) > 2 or len(entries) == 2 and not _short(max(entries, key=len)):
            out.append(("run", "\n".join(entries), len(entries)))
        else:
            running.extend(entries)
        entries.clear()

    last = ""
    for line, kind in zip(lines, kinds):
        if kind != "run":
            close()
            if out and out[-1][0] == kind == last:
                out[-1] = (kind, f"{out[-1][1]}\n{line}", out[-1][2] + 1)
            else:
                out.append((kind, line, 1))
        elif not _STOP.search(line) and (_short(line) or everywhere.isdisjoint(line.lower().split()) and line.isascii()):
            entries.append(line.strip())
        else:
            close()
            running.append(line.strip())
        last = kind
    close()
    if running:
        out.append(("run", "\n".join(running), len(running)))
    return out


def _repeats(found: Counter) -> bool:
    """The same few words over and over."""
    return found.total() > 12 and len(found) < 8 and len(found) * 5 < found.total()


def _enumerates(text: str, stopped: bool) -> bool:
    """Short items between commas."""
    if stopped or text.count(",") + text.count("、") < 3:
        return False
    items = re.split("[,、]", text)
    return len(text.encode()) / len(items) < 34


def kinds(text: str, prose: Prose) -> tuple[dict[str, int], Counter]:
    """Characters (blanks apart) by kind: prose, list, table, junk; and prose characters by language."""
    got = {"prose": 0, "list": 0, "table": 0, "junk": 0}
    langs: Counter = Counter()
    for layout, block, n in blocks(text, prose.everywhere):
        size = sum(map(len, block.split()))
        plain = _TAG.sub(" ", block) if "<" in block or "&" in block else block
        letters = sum(map(str.isalpha, plain))
        found = Counter(_WORD.findall(plain.lower()))
        stopped = _STOP.search(plain) is not None
        if layout == "run":
            layout = "data" if letters * 2 < size else "repeat" if _repeats(found) else "items" if _enumerates(plain, stopped) else "run"
        if len(plain.split()) * 25 <= letters:
            ending = 4
        else:
            ending = 0 if n > 1 else 1 if letters < 60 else 3 if {",", "、", "/"}.isdisjoint(plain) else 2
        kind, lang = prose.nearest(plain, layout, ending, LEAST_STOPPED if stopped else SHORT_LINES if n > 1 else LEAST, found)
        got[kind] += size
        if lang is not None:
            langs[lang] += size
    return got, langs


#: runs of one script in texts without blanks, Han characters by two
_PARTS = re.compile(r"[㐀-鿿]{1,2}|[ぁ-ゟ]+|[゠-ヿ]+|[^\W\d_㐀-鿿ぁ-ヿ]+")


def unspaced_words(lower: str, pieces: re.Pattern | None) -> list[str]:
    """Words of a text that does not part them: common pieces, and what is left by script."""
    out = []
    for run in _WORD.findall(lower):
        rest = pieces.sub(lambda m: f" {m[0]} ", run).split() if pieces else [run]
        for part in rest:
            out += [part] if pieces and pieces.fullmatch(part) else _PARTS.findall(part)
    return out


_FIGURES = (
    ("words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("lines", pa.int64()),
    ("ended_lines", pa.float64()), ("common_words", pa.float64()), ("prose_share", pa.float64()), ("kind", pa.string()), ("lang", pa.string()),
)


def figures(text: str | None, prose: Prose) -> tuple:
    """words, mean word length, share of symbols, lines, share of lines that end a sentence, share of common words, ..."""
    if text is None:
        return (None,) * len(_FIGURES)
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    if not lines:
        return 0, None, None, 0, None, None, None, "blank", None
    got, langs = kinds(text, prose)
    total = sum(got.values())
    share = got["prose"] / total if total else 0.0
    kind = "prose" if share >= 0.5 else max(("list", "table", "junk"), key=lambda k: got[k])
    lang = langs.most_common(1)[0][0] if langs else None
    lower = text.lower()
    unspaced = lang in UNSPACED or lang is None and len(_UNSPACED.findall(text)) * 3 > total
    words = unspaced_words(lower, prose.pieces.get(lang)) if unspaced and lang != "ko" else _WORD.findall(lower)
    length = sum(map(len, words))
    if unspaced and lang in prose.pieces:
        common = sum(map(len, prose.pieces[lang].findall(lower))) / length if length else None
    else:
        known = prose.words.get(lang, prose.everywhere)
        common = sum(1 for w in words if w in known) / len(words) if words else None
    symbols = sum(1 for c in text.translate(_CLASSES) if c in "kl")
    return (
        len(words), length / len(words) if words else None, symbols / total if total else None, len(lines),
        sum(1 for x in lines if _ENDS.search(x)) / len(lines), common, share, kind, lang,
    )


def fit(common: DataFrame, samples: DataFrame) -> Prose:
    """Profiles from (lang, word, freq_rank) and (lang, text); rows with nulls are left out."""
    words = common.select("lang", "word", "freq_rank").dropna(subset=["lang", "word"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.asc_nulls_last("freq_rank"), "word"))
    words = words.withColumn("place", place).filter(F.col("place") <= MAX_WORDS).orderBy("lang", "place")
    texts = samples.select("lang", "text").dropna().limit(MAX_SAMPLES)
    return Prose([(r["lang"], r["word"]) for r in words.collect()], [tuple(r) for r in texts.collect()])


def document_figures(documents: DataFrame, common: DataFrame, samples: DataFrame) -> DataFrame:
    """doc_id with the figures and the kind ('prose', 'list', 'table', 'junk', 'blank'; null for null texts) of each document."""
    prose = fit(common, samples)
    names = ["doc_id", *[n for n, _ in _FIGURES]]
    sql = {pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [figures(t, prose) for t in b["text"].to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(_FIGURES)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(c, t) for c, (_, t) in zip(cols, _FIGURES)]], names=names)

    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{n} {sql[t]}" for n, t in _FIGURES)
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def not_prose(documents: DataFrame, common: DataFrame, samples: DataFrame) -> DataFrame:
    """doc_id of the documents that are not blank and mostly lists, tables or junk."""
    prose = fit(common, samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for text in b["text"].to_pylist():
                got, _ = kinds(text, prose)
                total = sum(got.values())
                hit.append(total > 0 and got["prose"] * 2 < total)
            yield b.select(["doc_id"]).filter(pa.array(hit, pa.bool_()))

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").filter(F.col("text").isNotNull()).mapInArrow(run, f"doc_id {id_type}")
