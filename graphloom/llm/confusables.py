"""Look-alike characters: one skeleton for all texts that look the same.

The skeleton of a text is built in the way of the Unicode confusables
algorithm: decompose, replace every character by the prototype of its
look-alike class, decompose again.  Two texts that look the same have equal
skeletons.  Unlike the general algorithm, upper and lower case, letters and
digits, and accented and plain letters stay apart here.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.sources.tables import written

#: Parts in which the nodes of one value are joined.
SLICES = 8

# Letters that look like a Latin letter, after the Unicode confusables data (prototype: look-alikes).
_LATIN = """
A: АΑᎪᗅꓮ𐊠
B: ВΒᏴᗷꓐ𐊂𐊡𐌁
C: СϹᏟꓚⲤ𐐕𐊢𐌂
D: Ꭰᗞꓓ
E: ЕΕᎬꓰ𐊆
F: Ϝᖴꓝ𐊇𐊥
G: ԌᏀꓖ
H: НΗᎻᕼꓧⲎ𐋏
I: ІΙӀꓲⲒ𐊊𐌉
J: ЈͿᎫᒍꓙ
K: КΚᏦꓗⲔ
L: Ꮮᒪꓡ𐐛
M: МΜϺᎷᗰꓟⲘ𐌑
N: ΝꓠՆⲚ
O: ОΟՕꓳⲞ𐐄𐊒𐊫𐓂
P: РΡᏢᑭꓑⲢ
Q: Ԛ
R: ᎡᏒᖇꓣ
S: ЅՏᏕꓢ𐐠𐊖
T: ТΤᎢꓔⲦ𐊗𐌕
U: Սሀᑌꓴ
V: ѴᏙᐯꓦ
W: ԜᎳᏔꓪ
X: ХΧ᙭ꓫⲬ𐊐𐌗
Y: УΥҮᎩꓬⲨ𐊲
Z: ΖᏃꓜⲌ
a: аαɑ⍺
b: ЬᏏᖯ
c: сϲᴄⲥ𐐽ꮯ
d: ԁᏧᑯ
e: еҽ℮
f: ẝꬵϝ
g: ɡցᶃ
h: һհᏂ
i: іιɩıӏ
j: јϳ
l: ⅼ
n: ոռ
o: оοօσᴏ၀ⲟ𐐬ഠ
p: рρϱ⍴ⲣ
q: ԛգզ
r: гᴦⲅⲅꭇ
s: ѕꜱ𐑈ꮪ
u: υսʋᴜꭎ𐓶
v: ѵνᴠꮩ
w: ԝաѡᴡꮃ
x: х×⤫
y: уүγʏꭚỿ
z: ᴢꮓ
ß: β
þ: ϸ
æ: ӕ
Æ: Ӕ
ə: ә
Ə: Ә
ĸ: кκ
ɜ: з
ʜ: н
ʙ: в
ᴛ: тτ
ʍ: м
"""

# Signs that look alike (prototype: look-alikes).
_SIGNS = """
-: ‐‑‒–﹘⁃−˗
': ’‘‛ʼʹ′ʻ
": ”“‟″
,: ‚
/: ⁄∕
:: ∶ː
.: ․
|: ∣
*: ∗⁎
~: ∼˜
_: ˍ
·: ・•‧∙⋅᛫
ー: ｰ
"""

#: Compatibility decompositions that change a character's width or form, not what is seen.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _invisible(char: str) -> bool:
    """Format characters, variation selectors and fillers: nothing is seen of them."""
    point = ord(char)
    return (
        unicodedata.category(char) == "Cf"
        or 0xFE00 <= point <= 0xFE0F
        or 0xE0100 <= point <= 0xE01EF
        or 0x180B <= point <= 0x180F
        or point in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
    )


def _same_look(char: str) -> str | None:
    """The plain form of a wide, narrow, ligated or styled character, or None."""
    tag, _, points = unicodedata.decomposition(char).partition(" ")
    if tag not in _SAME_LOOK:
        return None
    return "".join(_same_look(x) or x for x in (chr(int(p, 16)) for p in points.split()))


def _table() -> dict[int, str | None]:
    """Code point to what stands for it: built by rule from the Unicode data and the two fixed lists."""
    table: dict[int, str | None] = {}
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if 0xAC00 <= point <= 0xD7A3 or 0x4E00 <= point <= 0x9FFF or 0xD800 <= point <= 0xF8FF or 0x323B0 <= point < 0xE0000:
            continue
        if char.isspace():
            table[point] = " "
        elif _invisible(char):
            table[point] = None
        elif (plain := _same_look(char)) is not None:
            table[point] = " " if plain.isspace() else plain
        if point == 0xE0FFF:
            break
    for line in filter(None, (_LATIN + _SIGNS).split("\n")):
        prototype, looks = line[0], line[2:].strip()
        for char in looks:
            table[ord(char)] = prototype
    return table


_TABLE = _table()
#: A text of these characters only is its own skeleton; in Java's notation.
PLAIN = r"^[ -~]*\z"


def skeleton(text: str) -> str:
    """The one form of all texts that look like this one.

    Empty text stays empty; a text of invisible characters becomes empty.
    """
    if text.isascii() and text.isprintable():
        return text
    once = unicodedata.normalize("NFD", text).translate(_TABLE)
    twice = unicodedata.normalize("NFD", once)
    return unicodedata.normalize("NFD", twice.translate(_TABLE)) if not twice.isascii() else twice.translate(_TABLE)


@lru_cache(maxsize=1)
def _rewritten() -> re.Pattern:
    """Finds a character that the skeleton writes differently, or may, beyond the first plane."""
    points = (p for p in range(0x80, 0x10000) if not (0xAC00 <= p <= 0xD7A3 or 0x3400 <= p <= 0x9FFF or 0xD800 <= p <= 0xF8FF))
    changed = [p for p in points if unicodedata.normalize("NFC", skeleton(chr(p))) != chr(p)]
    return re.compile("[" + "".join(map(chr, changed)) + "\U00010000-\U0010ffff]")


def settled(text: str) -> bool:
    """Whether the skeleton would rewrite no letter of the text, but line breaks and tabs at most."""
    return text.isascii() or unicodedata.is_normalized("NFC", text) and not _rewritten().search(text)


def readable(text: str) -> str:
    """The skeleton, composed: the form in which a text is stored after clean-up."""
    if text.isprintable() and settled(text):
        return text
    return unicodedata.normalize("NFC", skeleton(text))


@F.pandas_udf(StringType())
def _skeletons(values: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return values.map(lambda x: known.setdefault(x, skeleton(x)) if x is not None else None)


@F.pandas_udf(StringType())
def _readable(values: pd.Series) -> pd.Series:
    return values.map(lambda x: readable(x) if x is not None else None)


def skeleton_of(column: Column) -> Column:
    """The skeleton of a text column; plain texts never leave the JVM.  Null stays null, empty stays empty."""
    return F.when(column.rlike(PLAIN), column).otherwise(_skeletons(F.when(~column.rlike(PLAIN), column)))


def readable_of(column: Column) -> Column:
    """A text column in the one consistent, composed form."""
    return F.when(column.rlike(PLAIN), column).otherwise(_readable(F.when(~column.rlike(PLAIN), column)))


def latest(nodes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each node's state: id and fields of its row with the greatest updated_at (then ingested_at, then the greatest fields)."""
    state = nodes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("updated_at", "ingested_at", *fields)).alias("s"))
    return state.select("id", *(F.col(f"s.{x}").alias(x) for x in fields))


def cells(nodes: DataFrame) -> DataFrame:
    """The texts of each node's state, one distinct row each: field, id, value.  Null and empty texts are no texts."""
    state = latest(nodes, ["label", "norm_label", "tags"])
    texts = F.concat(
        F.array(F.struct(F.lit("label").alias("field"), F.col("label").alias("value")), F.struct(F.lit("norm_label").alias("field"), F.col("norm_label").alias("value"))),
        F.transform(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda x: F.struct(F.lit("tags").alias("field"), x.alias("value"))),
    )
    return state.select("id", F.explode(texts).alias("t")).select("t.field", "id", "t.value").filter(F.coalesce("value", F.lit("")) != "")


def variants(texts: DataFrame) -> DataFrame:
    """The look-alike classes of a field: field, skeleton, value, n_nodes, for classes of two values or more.

    texts: as `cells` gives them.  Values are counted before they are
    shuffled, so a value that a third of all rows hold is one row here.
    """
    counted = texts.groupBy("field", "value").agg(F.count("*").alias("n_nodes")).withColumn("skeleton", skeleton_of(F.col("value")))
    several = counted.groupBy("field", "skeleton").agg(F.count("*").alias("n")).filter("n > 1").select("field", "skeleton")
    return counted.join(several, ["field", "skeleton"], "left_semi").select("field", "skeleton", "value", "n_nodes")


def _slice(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int").alias("slice")


def lookalikes(texts: DataFrame) -> DataFrame:
    """Pairs of nodes that hold values which look the same and are not the same characters: field, id_a < id_b.

    Values are paired first, within their class; then each side's nodes are
    joined on, a value's nodes in SLICES parts, as one value may be held by
    very many.  A node is no pair with itself.  Nodes that hold the same
    characters are no pair by these.  The result is as large as the pairs
    that there are; `classes` gives the same links without pairs.
    """
    texts = written(texts, "texts")
    found = written(variants(texts).select("field", "skeleton", "value"), "variants")
    pairs = found.withColumnRenamed("value", "value_a").join(found.withColumnRenamed("value", "value_b"), ["field", "skeleton"]).filter(F.col("value_a") < F.col("value_b")).select("field", "value_a", "value_b")
    each = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    one = texts.select("field", F.col("value").alias("value_a"), F.col("id").alias("x"), _slice("id"))
    two = texts.select("field", F.col("value").alias("value_b"), F.col("id").alias("y"), _slice("id"))
    left = pairs.withColumn("slice", each).join(one, ["field", "value_a", "slice"]).drop("slice")
    both = left.withColumn("slice", each).join(two, ["field", "value_b", "slice"]).filter(F.col("x") != F.col("y"))
    return both.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def classes(texts: DataFrame) -> DataFrame:
    """Every node's text that has look-alikes, with its class: field, id, value, representative, n_links.

    representative: the least value of the class.  n_links: the nodes that
    hold another value of the class (of tags, a node counts once for each tag).
    """
    texts = written(texts, "texts")
    found = written(variants(texts), "variants")
    whole = found.groupBy("field", "skeleton").agg(F.min("value").alias("representative"), F.sum("n_nodes").alias("all"))
    of = found.join(whole, ["field", "skeleton"]).select("field", "value", "representative", (F.col("all") - F.col("n_nodes")).alias("n_links"))
    each = of.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return texts.withColumn("slice", _slice("id")).join(each, ["field", "value", "slice"]).select("field", "id", "value", "representative", "n_links")


def consistent(nodes: DataFrame) -> DataFrame:
    """Each node's state with its texts in one form: id, label, norm_label, tags, and which of them were rewritten.

    Null and empty texts stay as they are; tags that become equal are kept once.
    """
    state = latest(nodes, ["label", "norm_label", "tags"])
    parts = state.select("id", "label", "norm_label", F.posexplode_outer("tags").alias("at", "tag"))
    tags = parts.select("id", "at", readable_of(F.col("tag")).alias("tag")).groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "tag")))).alias("t"))
    tags = tags.select("id", F.array_distinct(F.transform("t", lambda x: x["tag"])).alias("clean_tags"))
    clean = state.join(tags, "id").select(
        "id", readable_of(F.col("label")).alias("label"), readable_of(F.col("norm_label")).alias("norm_label"), F.when(F.col("tags").isNotNull(), F.col("clean_tags")).alias("tags"),
        F.col("label").alias("was_label"), F.col("norm_label").alias("was_norm"), F.col("tags").alias("was_tags"),
    )
    changed = [F.when(~F.col(a).eqNullSafe(F.col(b)), name) for name, a, b in (("label", "label", "was_label"), ("norm_label", "norm_label", "was_norm"), ("tags", "tags", "was_tags"))]
    return clean.select("id", "label", "norm_label", "tags", F.concat_ws(",", *changed).alias("rewritten"))
