"""One form for texts that look the same but are stored with other characters.

``look`` keeps what a reader sees: wide, narrow, ligature and styled letters and digits take their plain form,
look-alike letters one representative, accents and syllables are composed, special blanks become a plain blank and
default-ignorable characters go.  Letter case, punctuation, and the number and kind of plain blanks stay.
``canonical`` is the form for comparisons: compatibility composition of everything, full case folding, mapped and
collapsed blanks, no default-ignorable characters, one representative of look-alike letters.

Both run once per distinct value of an Arrow batch.  Null stays null and '' ''.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextra.llm.hashing import hash128
from bitextra.scratch import materialize

#: fixed values: letters drawn alike in usual typefaces, and the letter that stands for them
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρι" "口卜夕力二八工一へり",
        "ABESIJKMHOPCTYXaeopcyxsijhdqw" "ABEZHIKMNOPTYXovapi" "ロトタカニハエーヘリ",
        strict=True,
    )
)
#: what lower-cased look-alike capitals stand for, where the small letter has no look-alike of its own
_SMALL = {ord(a.lower()): b.lower() for a, b in LOOK_ALIKE.items() if a != a.lower() and a.lower() not in LOOK_ALIKE}
#: kinds of compatibility decomposition that leave the look of a letter or digit as it is
_SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: fixed values: the characters with the property Default_Ignorable_Code_Point (ranges)
_IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


def _plain(ch: str) -> str | None:
    """What one character becomes; None if it goes."""
    kind = unicodedata.category(ch)
    if any(a <= ord(ch) <= b for a, b in _IGNORABLE):
        return None
    if kind == "Zs":
        return " "
    letter = kind[0] == "L" or kind == "Nd" or 0x2E80 <= ord(ch) <= 0x2FDF
    if letter and unicodedata.decomposition(ch).split(" ")[0] in _SAME_LOOK:
        ch = unicodedata.normalize("NFKC", ch)
    return "".join(LOOK_ALIKE.get(c, c) for c in ch)


class _Plain(dict):
    """Character table for str.translate that fills itself."""

    def __missing__(self, point: int) -> str | None:
        self[point] = out = _plain(chr(point))
        return out


_PLAIN = _Plain()


def look(text: str) -> str:
    """What a reader sees.  Accents come off before letters are replaced, so that an accented look-alike is one too."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_PLAIN))


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = look(unicodedata.normalize("NFKC", text)).casefold()
    small = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", folded)).translate(_SMALL)
    return " ".join(unicodedata.normalize("NFC", small).split())


def _map_distinct(values: pa.Array, f) -> pa.Array:
    """``f`` over the distinct values of ``values``, null for null."""
    coded = values.dictionary_encode()
    done = pa.array([f(v) for v in coded.dictionary.to_pylist()], pa.string())
    return done.take(coded.indices) if len(done) else pa.nulls(len(values), pa.string())


def unify(df: DataFrame, columns: list[str], fold: bool = True) -> DataFrame:
    """Replace each text column by its ``canonical`` form, or its ``look`` where ``fold`` is false."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = canonical if fold else look
        for b in batches:
            cols = [_map_distinct(b.column(i), f) if n in columns else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, df.schema)


def record_forms(records: DataFrame) -> DataFrame:
    """id with the comparison forms of source, target and source_cmp."""
    return unify(records.select("id", "source", "target", "source_cmp"), ["source", "target", "source_cmp"])


def _looking_alike(records: DataFrame) -> DataFrame:
    """id, k1, k2 (the look), v1, v2 (what is stored) of the records of a look that is stored in several ways."""
    texts = records.select("id", "source", "target").filter(F.col("source").isNotNull() & F.col("target").isNotNull())
    s1, s2 = hash128(F.col("source"), F.col("target"))
    stored = texts.select("id", s1.alias("v1"), s2.alias("v2"), "source", "target")
    unified = unify(stored, ["source", "target"], fold=False).filter((F.trim("source") != "") & (F.trim("target") != ""))
    k1, k2 = hash128(F.col("source"), F.col("target"))
    keys = materialize(unified.select("id", k1.alias("k1"), k2.alias("k2"), "v1", "v2"), "looks")
    variants = keys.groupBy("k1", "k2").agg(F.min("v1").alias("a1"), F.max("v1").alias("b1"), F.min("v2").alias("a2"), F.max("v2").alias("b2"))
    mixed = variants.filter((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))).select("k1", "k2")
    return materialize(keys.join(mixed, ["k1", "k2"], "left_semi"), "looks-mixed")


def look_alikes(records: DataFrame) -> DataFrame:
    """id_a, id_b (id_a < id_b): records that look the same and are stored with different characters.

    Records with a missing, empty or blank source or target take no part.  Only hashes of the stored and of the
    unified pair are shuffled.  The ways in which a look is stored are paired first, then each pair of ways takes its
    records, so records stored alike never meet.
    """
    some = _looking_alike(records)
    ways = some.select("k1", "k2", "v1", "v2").distinct()
    x, y = (ways.select("k1", "k2", F.col("v1").alias(f"{k}1"), F.col("v2").alias(f"{k}2")) for k in "ab")
    before = (F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2")))
    pairs = x.join(y, ["k1", "k2"]).filter(before)
    for k in "ab":
        held = some.select("k1", "k2", F.col("v1").alias(f"{k}1"), F.col("v2").alias(f"{k}2"), F.col("id").alias(f"id_{k}"))
        pairs = pairs.join(held, ["k1", "k2", f"{k}1", f"{k}2"])
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def look_classes(records: DataFrame) -> DataFrame:
    """One row per record of a look that is stored in several ways: id, look_id and way_id (the least ids of the look and of the way)."""
    some = _looking_alike(records)
    ways = some.groupBy("k1", "k2", "v1", "v2").agg(F.min("id").alias("way_id"))
    looks = ways.groupBy("k1", "k2").agg(F.min("way_id").alias("look_id"))
    return some.join(ways, ["k1", "k2", "v1", "v2"]).join(looks, ["k1", "k2"]).select("id", "look_id", "way_id")
