"""Language of each text and of each passage, by rank-order profiles.

A profile is the ranking of the most frequent one- to three-character runs of a language.  A passage is compared to
each profile by out-of-place distance: the sum, over its own ranked runs, of how far each is from its place in the
profile, with a full penalty for runs the profile lacks.  Confidence is the margin of the nearest profile over the
next, as a share of the latter's distance.

Texts are cut into sentences first; tags, placeholders and quoted labels are no part of any passage, and pieces too
short to tell by themselves belong to the passage before them.  All distances of an Arrow batch are computed at once
over flat arrays.  Profiles come from at most ``MAX_SAMPLES`` labelled rows.

Null, empty and letterless texts have no passage and give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.functions.forms import bare, has_letter
from bitextra.llm.looks import look

#: bound of the labelled rows that profiles are fitted on
MAX_SAMPLES = 20_000
#: places of a profile
PLACES = 400
_SLOT_BITS = 20
MIN_BARE = 30
LANGS = ("de", "en", "es", "fr", "ja", "ko", "zh")
#: fixed values: what a label may be besides its two-letter code
NAMES = {
    "en": "eng english", "ja": "jpn japanese", "zh": "zho chi chinese", "ko": "kor korean",
    "de": "deu ger german", "fr": "fra fre french", "es": "spa spanish",
}

_TAGS = re.compile(r"<[^<>]+>|\{[^{}]*\}|%\d*\$?[sd@]|\$\{[^{}]*\}|&[a-z]{2,8};|https?://\S+")
#: a quotation of a few words is a label; a longer one is judged as a passage
_QUOTED = re.compile(r"\"[^\"\n]{1,40}\"|“[^”\n]{1,40}”|「[^」\n]{1,20}」|『[^』\n]{1,20}』|‘[^’\n]{1,40}’|«[^»\n]{1,40}»")
_CUT = re.compile(r"(?<=[.!?…])[\"”’)\]]*\s+|(?<=[。！？｡])[」』）)]*|[\r\n\t]+|\s/\s|(?<=[.!?。！？])\s*(?=[(（])")
_GAP = re.compile(r"[\W\d_]+")
_QUOTE_MIN = 25
#: characters outside the plain forms of the scripts at hand
_ODD = re.compile(r"[^\x00-~\u00C0-\u00FF\u2010-\u2026\u3001-\u30FF\u3400-\u9FFF\uAC00-\uD7A3\uFF01\uFF08\uFF09\uFF0C\uFF1A\uFF1B\uFF1F]")
_MARKED, _QUOTES = frozenset("<{%$&:"), frozenset("\"“「『‘«")


def label_language(label: Column) -> Column:
    """Two-letter language of a label: codes with or without region or script, three-letter codes, English names.

    Null for a null, empty, undetermined or unknown label.
    """
    head = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1))
    known = F.create_map(*[F.lit(x) for k, names in NAMES.items() for n in (k, *names.split()) for x in (n, k)])
    return F.try_element_at(known, head)


def passages(text: str, quoted: bool = False) -> list[str]:
    """Sentences of ``text`` in comparable form: lower-cased letters, everything else one blank.

    With ``quoted``, a text that has letters only in quoted labels is read with these.
    """
    if not text.isascii() and _ODD.search(text):
        text = look(text)
    if not _MARKED.isdisjoint(text):
        text = _TAGS.sub(" ", text)
    if not _QUOTES.isdisjoint(text):
        # a quotation that is as long as a sentence is a passage, a short one a label
        told = _QUOTED.sub(lambda m: m[0] if len(m[0]) > _QUOTE_MIN and m[0][-2] in ".!?。！？" else " ", text)
        if not quoted or _GAP.sub("", told):
            text = told
    out = (_GAP.sub(" ", piece).strip() for piece in _CUT.split(text.lower()) if piece)
    return [piece for piece in out if piece]


def _weight(piece: str) -> int:
    """Length in which letters of scripts that need fewer of them count more: bytes of UTF-8."""
    return len(piece) if piece.isascii() else len(piece.encode())


def _runs(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece number, code) of every run of one to three characters; a blank stands before and after each piece."""
    flat = " " + " ".join(pieces) + "  "
    points = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.int64)
    length = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    owner = np.repeat(np.arange(len(pieces)), length)
    n = len(owner)
    a, b, c = points[:n], points[1 : n + 1], points[2 : n + 2]
    last = np.zeros(n, bool)  # a run of three must not reach into the next piece
    ends = np.cumsum(length)
    last[ends - 1] = True
    one, two, three = a, (a << 21) | b | (1 << 43), ((a << 42) ^ (b << 21) ^ c) | (1 << 62)
    keep1, keep3 = a != 32, ~last
    return np.concatenate([owner[keep1], owner, owner[keep3]]), np.concatenate([one[keep1], two, three[keep3]])


class Profiles:
    """Ranks of the runs of all languages: ``codes`` sorted, ``ranks`` of shape (codes, languages), ``prior`` order."""

    def __init__(self, samples: list[tuple[str, str]]):
        per = {lang: [p for at, text in samples if at == lang and text for p in passages(text)] for lang in LANGS}
        tops = {}
        for lang, pieces in per.items():
            if pieces:
                codes, counts = np.unique(_runs(pieces)[1], return_counts=True)
                tops[lang] = codes[np.lexsort((codes, -counts))][:PLACES]
        self.langs = [lang for lang in LANGS if lang in tops]
        self.codes = np.unique(np.concatenate([*tops.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), PLACES, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, tops[lang]), k] = np.arange(len(tops[lang]))
        self.prior = self.ranks.min(1).astype(np.int64)
        self.columns = [np.ascontiguousarray(self.ranks[:, k], dtype=np.int16) for k in range(len(self.langs))]
        self.slots = np.zeros(1 << _SLOT_BITS, np.int16)
        self.slots[self._slot(self.codes)] = np.arange(len(self.codes))
        at = self.slots[self._slot(self.codes)]
        self.crowded = np.flatnonzero(at != np.arange(len(self.codes)))  # codes that share a slot: found by search

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _find(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code, -1 if no profile has it."""
        at = self.slots[self._slot(codes)].astype(np.int64)
        at[self.codes[at] != codes] = -1
        for k in self.crowded:
            at[codes == self.codes[k]] = k
        return at

    def distances(self, pieces: list[str]) -> np.ndarray:
        """Out-of-place distance of each piece to each language, as a share of the greatest possible."""
        n = len(pieces)
        if not len(self.codes):
            return np.ones((n, len(self.langs)))
        owner, codes = _runs(pieces)
        at = self._find(codes)
        # runs in no profile count the full penalty for every language alike, so they are left out
        key = np.sort((owner[at >= 0] << 13) | at[at >= 0])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(key)])
        key = key[first]
        if counts.max(initial=0) > 127:
            # only their order counts: far fewer bits for very long pieces
            counts = np.unique(counts, return_inverse=True)[1]
        top = int(counts.max(initial=0))
        width = 22 + top.bit_length()
        # by piece, then falling count, then place in the profiles
        order = ((key >> 13) << width) | ((top - counts) << 22) | (self.prior[key & 8191] << 13) | (key & 8191)
        order.sort()
        owner, at = order >> width, order & 8191
        size = np.bincount(owner, minlength=n)
        some = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[some]
        place = np.minimum(np.arange(len(owner)) - np.repeat(starts, size[some]), PLACES).astype(np.int16)
        out = np.ones((n, len(self.langs)))
        for k in range(len(self.langs)):
            rank = self.columns[k][at]
            off = np.abs(place - rank)
            off[rank == PLACES] = PLACES
            out[some, k] = np.add.reduceat(off, starts, dtype=np.int32) / (size[some] * PLACES) if len(some) else 1.0
        return out


def fit(samples: DataFrame) -> Profiles:
    """Profiles of labelled texts (lang, text); rows without a known label or text are left out."""
    rows = samples.select(label_language(F.col("lang")).alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL").limit(MAX_SAMPLES)
    return Profiles([(r["lang"], r["text"]) for r in rows.collect()])


MIN_WEIGHT = 24
#: a passage belongs to its text's main language unless another is nearer by this share
MIN_MARGIN = 0.1
#: the same for fragments, shorter than a usual sentence
SHORT, SHORT_MARGIN = 60, 0.16
#: a label holds unless the main language is nearer by this share
LABEL_MARGIN = 0.02
#: the same for texts under ``MIN_BARE`` letters, which tell little
SHORT_LABEL_MARGIN = 0.16


_KANA, _HAN, _HANGUL, _LETTER = (re.compile(x) for x in ("[぀-ヿ]", "[㐀-鿿]", "[가-힣]", r"[^\W\d_]"))


def _barred(text: str) -> list[bool]:
    """For each of ``LANGS``, if a text of these letters cannot be in it by its script."""
    kana, han, hangul, all_ = (len(x.findall(text)) for x in (_KANA, _HAN, _HANGUL, _LETTER))
    if (kana + han + hangul) * 3 < all_:
        return [lang in ("ja", "ko", "zh") for lang in LANGS]
    fit = ("ko",) if hangul > kana + han else ("ja",) if kana else ("ja", "zh")
    return [lang not in fit for lang in LANGS]


def _pieces(text: str, quoted: bool) -> list[str]:
    """Passages long enough to tell; short ones join the one before (the first, the one after)."""
    out: list[str] = []
    held = ""
    for p in passages(text, quoted):
        p = f"{held} {p}" if held else p
        if _weight(p) < MIN_WEIGHT:
            held = p
        else:
            out.append(p)
            held = ""
    if held and out:
        out[-1] += " " + held
    elif held:
        out.append(held)
    return out


def languages(
    texts: list[str], profiles: Profiles, labels: list[str | None] | None = None, short: bool = False
) -> list[list[tuple[str | None, float, int]]]:
    """For each text its passages in order: (language, confidence, letters). ``labels`` settle what is almost even.

    A passage under ``MIN_WEIGHT`` is as much less sure as it is shorter.  The language of a text without label and
    without any run that a profile has is null.  With ``short``, texts under ``MIN_BARE`` letters are judged with more
    weight on script and label, and texts of quoted labels alone by these.
    """
    split = [_pieces(t, short) for t in texts]
    flat = [p for pieces in split for p in pieces]
    if not flat or not profiles.langs:
        return [[] for _ in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    weight = np.fromiter(map(_weight, flat), np.int64, len(flat))
    d = profiles.distances(flat)
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    letters = np.add.reduceat(size, starts)
    little = letters < (MIN_BARE if short else 0)
    for k in np.flatnonzero(little).tolist():
        at = slice(starts[k], starts[k] + n[some[k]])
        barred = dict(zip(LANGS, _barred(" ".join(flat[at]))))
        d[at, [j for j, lang in enumerate(profiles.langs) if barred[lang]]] = 2.0
    total = np.add.reduceat(d * size[:, None], starts, axis=0)
    main = total.argmin(1)
    # no run is known, nor does the script leave a single language
    blind = (total.min(1) >= letters) & ((total <= letters[:, None]).sum(1) != 1)
    if labels:
        index = {lang: k for k, lang in enumerate(profiles.langs)}
        label = np.array([index.get(lab, -1) for lab in labels], np.int64)[some]
        row = np.arange(len(some))
        told = total[row, label]
        margin = np.where(little, SHORT_LABEL_MARGIN, LABEL_MARGIN)
        held = (label >= 0) & (told - total[row, main] < margin * told)
        main = np.where(held, label, main)
        blind &= ~held
    main, blind = np.repeat(main, n[some]), np.repeat(blind, n[some])
    row = np.arange(len(flat))
    best = d.argmin(1)
    least = np.where(weight >= SHORT, MIN_MARGIN, SHORT_MARGIN)
    best = np.where(d[row, main] - d[row, best] < least * d[row, main], main, best)
    chosen = d[row, best]
    d[row, best] = np.inf
    rest = np.minimum(d.min(1), 1.0)
    sure = np.maximum(0.0, (rest - chosen) / np.maximum(rest, 1e-9)) * np.minimum(weight / MIN_WEIGHT, 1.0)
    rows = list(zip([None if no else profiles.langs[k] for k, no in zip(best.tolist(), blind.tolist())], sure.tolist(), size.tolist()))
    out, at = [], 0
    for k in n.tolist():
        out.append(rows[at : at + k])
        at += k
    return out


def _sides(records: DataFrame, least: int) -> DataFrame:
    """id, source, target (null without a letter or with a bare form under ``least``) and the labels' languages."""
    judged = {k: F.length(bare(k)) >= least if least else has_letter(k) for k in ("source", "target")}
    return records.select(
        "id", *[F.when(judged[k], F.col(k)).alias(k) for k in judged],
        label_language(F.col("src_lang")).alias("source_label"), label_language(F.col("tgt_lang")).alias("target_label"),
    ).filter(F.col("source").isNotNull() | F.col("target").isNotNull())


def _detect(records: DataFrame, samples: DataFrame, rows, schema: str, least: int = 0) -> DataFrame:
    """Run ``rows(passages, label)`` -> list of tuples over every judged side; the profiles travel with the tasks.

    Sides with a bare form under ``least`` are not judged; without such a floor every side with a letter is.
    """
    profiles = fit(samples)
    id_type = records.schema["id"].dataType.simpleString()
    names = ["id", "side", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for side in ("source", "target"):
                ids, texts, labels = b["id"].to_pylist(), b[side].to_pylist(), b[f"{side}_label"].to_pylist()
                # copies are judged once
                distinct = {(t, lab): None for t, lab in zip(texts, labels) if t is not None}
                found = dict(zip(distinct, languages([t for t, _ in distinct], profiles, [lab for _, lab in distinct], not least)))
                out = [(i, side, *r) for i, t, lab in zip(ids, texts, labels) if t is not None for r in rows(found[t, lab], lab)]
                cols = list(zip(*out)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[t.split()[-1]] for t in (f"id {id_type}", "side string", *schema.split(", "))]
    return _sides(records, least).mapInArrow(run, f"id {id_type}, side string, {schema}")


def _present(found: list[tuple[str | None, float, int]]) -> list[tuple[str | None, float]]:
    """Languages with their confidence: the surest passage of each."""
    best: dict[str | None, float] = {}
    for lang, sure, _ in found:
        best[lang] = max(best.get(lang, 0.0), sure)
    return list(best.items())


def mislabelled(records: DataFrame, samples: DataFrame) -> DataFrame:
    """id, side, lang: one row per language of each side whose label is missing, wrong, or short of a language.

    Sides with fewer than 30 letters and digits, null texts included, are not judged.
    """

    def rows(found, label):
        langs = {lang for lang, _, _ in found if lang}
        return [] if langs == {label} else [(lang,) for lang in sorted(langs)]

    return _detect(records, samples, rows, "lang string", MIN_BARE)


def record_languages(records: DataFrame, samples: DataFrame) -> DataFrame:
    """id, side, label, lang, confidence: every side with a letter outside tags and placeholders, with each of its languages."""
    return _detect(records, samples, lambda found, label: [(label, lang, sure) for lang, sure in _present(found)], "label string, lang string, confidence double")


def record_passages(records: DataFrame, samples: DataFrame) -> DataFrame:
    """id, side, passage, lang, letters, confidence: every passage of each such side, short ones too, numbered from 0."""
    return _detect(
        records, samples, lambda found, _: [(k, lang, size, sure) for k, (lang, sure, size) in enumerate(found)],
        "passage int, lang string, letters int, confidence double",
    )
