"""Search terms, paths as text, and text without accents."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..model import DESCRIPTIONS

#: Letters that Unicode does not decompose.
PLAIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h"}
#: The usual Latin spelling of Cyrillic and Greek letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
    "ё": "io", "й": "i", "і": "i", "ї": "yi", "є": "ye", "ґ": "g", "ў": "u", "ђ": "dj", "ѓ": "gj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "tsh", "ќ": "kj", "џ": "dzh",
}
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
#: The kana whose usual spelling is not their name.
KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}
#: Scripts whose characters' Unicode names end in their sound.
NAMED = ("HANGUL SYLLABLE ", "HIRAGANA LETTER ", "KATAKANA LETTER ")


def latin(c: str) -> str:
    """The Latin spelling of one lower-case character, itself if none is known."""
    for letters in (PLAIN, CYRILLIC, GREEK):
        if c in letters:
            return letters[c]
    if ord(c) >= 0x3040:
        name = unicodedata.name(c, "")
        for script in NAMED:
            if name.startswith(script):
                sound = name[len(script) :].removeprefix("SMALL ").lower()
                return KANA.get(sound, sound)
    return c


def plain_text(s: str) -> str:
    """Lower case, without accents; Cyrillic, Greek, Hangul and kana in Latin letters."""
    spelled = "".join(latin(c) for c in unicodedata.normalize("NFC", s).lower())
    bare = "".join(c for c in unicodedata.normalize("NFKD", spelled) if not unicodedata.combining(c))
    return "".join(latin(c) for c in bare)  # letters that only now stand without their accent


@pandas_udf(StringType())
def plain_text_udf(s: pd.Series) -> pd.Series:
    return s.map(plain_text, na_action="ignore")


def plain(c: Column) -> Column:
    """Plain text; ASCII values, nearly all of them, stay in the JVM."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(plain_text_udf(c))


def terms(text: str) -> list[str]:
    """Space-separated terms; two spaces leave an empty one, which every text holds."""
    return text.split(" ")


def holds_all(c: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(c, F.lit(w))
    return out


def path_text(path: Column, mark: str = "x") -> Column:
    return F.array_join(path, mark)


def text_path(text: Column, mark: str = "x") -> Column:
    """Inverse of path_text; an empty text is a path of one empty step."""
    return F.split(text, f"\\Q{mark}\\E", -1)


def first_replaced(c: Column, old: str, new: str) -> Column:
    """Only the first occurrence replaced."""
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def filled(c: Column, entity: Column) -> Column:
    """Every {pc_id}, in either case, becomes the id, whatever characters it has."""
    plain_id = F.replace(F.replace(entity, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(c, F.lit(r"(?i)\{pc_id\}"), plain_id)


def line_length(words: Column) -> Column:
    """Characters of words set in a line with a blank between them; -1 without words."""
    return F.aggregate(words, F.lit(-1), lambda n, w: n + F.length(w) + 1)


def longest_line(lines: Column) -> Column:
    """The longest of some lines of words."""
    return F.array_max(F.transform(lines, line_length))


def described(kind: Column) -> Column:
    """The words before a path's last step, by its kind; null for kinds without."""
    out = F.lit(None).cast("string")
    for k, words in DESCRIPTIONS.items():
        out = F.when(kind == k, F.lit(words)).otherwise(out)
    return out


def url_parameter(url: Column, name: str) -> Column:
    """A query-string parameter of a URL, null if it is not there; the first one counts."""
    pattern = rf"^[^?#]*\?(?:[^#]*?&)?{name}=([^&#]*)"
    return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))


def wrapped(words: Column, most: Column) -> Column:
    """Words in lines, as many in each as fit: a line's characters, with a blank behind each word, are most at most, but a line has one word at least."""
    room = lambda a, w: a["used"] + F.length(w) + 1
    start = F.struct(F.array().cast("array<array<string>>").alias("full"), F.array().cast("array<string>").alias("line"), F.lit(0).alias("used"))

    def step(a: Column, w: Column) -> Column:
        breaks = (room(a, w) > most) & (F.size(a["line"]) > 0)
        full = F.when(breaks, F.concat(a["full"], F.array(a["line"]))).otherwise(a["full"])
        line = F.when(breaks, F.array(w)).otherwise(F.concat(a["line"], F.array(w)))
        return F.struct(full.alias("full"), line.alias("line"), F.when(breaks, F.length(w) + 1).otherwise(room(a, w)).alias("used"))

    return F.aggregate(words, start, step, lambda a: F.when(F.size(a["line"]) > 0, F.concat(a["full"], F.array(a["line"]))).otherwise(a["full"]))


#: How often a label is broken anew, and how much longer than the mean a line may be.
BREAKS, SLACK = 7, 1.25


def fitted(words: Column, width: float, height: float, line_height: float, letter_width: float) -> Column:
    """Lines and font size with which words fill a box best: more lines as long as these allow a larger font."""
    tall = lambda lines: F.lit(float(height)) / (F.lit(1.0) + (lines - 1) * F.lit(float(line_height)))
    start = F.struct(F.array(words).alias("lines"), F.lit(1).alias("count"), F.lit(0.0).alias("size"), F.lit(False).alias("done"))

    def step(a: Column, _: Column) -> Column:
        size = F.least(F.lit(float(width)) / (longest_line(a["lines"]) * F.lit(float(letter_width))), tall(a["count"]))
        enough = (F.size(a["lines"]) == F.size(words)) | (size >= tall(a["count"] + 1))
        more = wrapped(words, line_length(words) / (a["count"] + 1) * F.lit(SLACK))
        lines = F.when(enough, a["lines"]).otherwise(more)
        done = enough | (F.size(more) == a["count"])
        now = F.struct(lines.alias("lines"), F.when(enough, a["count"]).otherwise(F.size(more)).alias("count"), size.alias("size"), done.alias("done"))
        return F.when(a["done"], a).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.lit(BREAKS)), start, step, lambda a: F.struct(a["lines"].alias("lines"), a["size"].alias("size")))


def word_places(lines: Column, line_height: float, letter_width: float, base: float, left: bool = False) -> Column:
    """Where each word of some lines stands around the last line's middle (or start), in a font of size base."""
    across = lambda letters: letters * F.lit(letter_width * base)

    def line(words: Column, i: Column) -> Column:
        y = (i - F.size(lines) + 1) * F.lit(line_height * base)
        x = F.lit(0.0) if left else across(-line_length(words) / 2)
        before = lambda k: F.when(k > 0, line_length(F.slice(words, F.lit(1), k)) + 1).otherwise(F.lit(0))
        return F.transform(words, lambda w, k: F.struct(w.alias("word"), (x + across(before(k))).alias("x"), y.alias("y")))

    return F.flatten(F.transform(lines, line))
