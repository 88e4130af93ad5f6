"""Column expressions over texts and words: patterns, tokens, counts, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word begins with a letter, digit or underscore; marks and joiners may follow.
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_\p{M}\x{00AD}\x{200C}\x{200D}]*"
HAS_WORD = r"[\p{L}\p{N}]"
PUNCTUATION = r"^[\p{P}\p{S}\p{M}\p{Cf}\p{Cs}]*$"
NUMBER = r"^[+\-\x{2212}]?(?:\d{1,3}(?:[ \x{00A0}\x{202F}]\d{3})+|\d+)(?:[.,:/-]\d+)*%?$"
BLANK_LINE = r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)"
LINE_BREAK = r"\r\n|\r|\n"
#: What stands before the first word of a paragraph.
NO_WORD = r"^[^\p{L}\p{N}]*+"
#: White space after an end mark and its closing marks, where a word comes before the next such place.
_CLOSING = "[\"'»”’)\\]]"
SENTENCE_BREAK = rf"(?U)(?<=[.!?…]{_CLOSING}{{0,255}})\s++(?=(?:(?![.!?…]{_CLOSING}*+\s)[^\p{{L}}\p{{N}}])*+[\p{{L}}\p{{N}}])"
#: The neutral default of the syllable hook: groups of vowels.
VOWELS = "[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœ]+"
DASH = r"(?<=\s)[-\x{2010}-\x{2015}]+(?=\s|$)|[\x{2012}-\x{2015}]+|--+"
MARKS = {"full_stop": ".", "comma": ",", "exclamation": "!", "question": "?", "colon": ":", "semicolon": ";", "hyphen": "-‐‑", "apostrophe": "'’", "quote": "\"«»“”„", "bracket": "()[]{}", "slash": "/\\"}


def as_words(text: Column, pattern: str = WORD) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), has_word)


def has_word(value: Column) -> Column:
    return value.rlike(HAS_WORD)


def is_punctuation(value: Column) -> Column:
    return value.rlike(PUNCTUATION)


def is_number(value: Column) -> Column:
    return F.lower(value).rlike(NUMBER)


def count_letters(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^\p{L}]", ""))


def count_syllables(word: Column, vowels: str = VOWELS) -> Column:
    return F.regexp_count(F.lower(word), F.lit(vowels))


def as_paragraphs(text: Column) -> Column:
    """Parts of a text between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), BLANK_LINE), lambda p: F.trim(p)), lambda p: p != "")  # F.trim itself would take the index for the characters to trim


def as_sentences(text: Column, wordless: bool = False) -> Column:
    """Sentences: split at blank lines, then after end marks and the closing marks that follow, which stay; a piece
    without a word belongs to the one before it, or after it at the start of a paragraph. wordless: a paragraph without
    a word is a sentence too."""
    def split(p: Column) -> Column:
        first = F.regexp_extract(p, NO_WORD, 0)
        found = F.transform(F.split(F.regexp_replace(p, NO_WORD, ""), SENTENCE_BREAK), lambda s, i: F.when(i == 0, F.concat(first, s)).otherwise(s))
        return F.when(has_word(p), F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))).otherwise(F.array(p) if wordless else F.array().cast("array<string>"))

    return F.flatten(F.transform(as_paragraphs(text), lambda p: split(p)))


def count_sentences(text: Column) -> Column:
    return F.size(as_sentences(text))


def fold(value: Column) -> Column:
    """Case and diacritics away, by collation: compare with == or contains."""
    return F.collate(value, "UNICODE_CI_AI")


def substring_filter(field: Column, value: str) -> Column:
    """field contains value, whatever the case and diacritics."""
    return F.contains(fold(field), fold(F.lit(value)))


def length_filter(text: Column, least: int | None = None, most: int | None = None) -> Column:
    if least is not None and most is not None and least > most:
        raise ValueError("least is above most")
    out = F.lit(True)
    if least is not None:
        out = out & (F.length(text) >= least)
    if most is not None:
        out = out & (F.length(text) <= most)
    return out


def ratio(a: Column, b: Column, undefined: float | None = 0.0) -> Column:
    """a / b; where b is 0, the default (None: nan)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float("nan") if undefined is None else undefined))


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def by_scale(value: Column, scale: list[tuple[float, str]]) -> Column:
    """The band of a value: descending lower bounds; below all of them the last band; nan has none."""
    out = F.when(F.isnan(value) | value.isNull(), F.lit(None))
    for bound, name in scale:
        out = out.when(value >= bound, F.lit(name))
    return out.otherwise(F.lit(scale[-1][1]))


def significant(value: Column) -> Column:
    """12 significant digits, for ranks that don't hang on the order of a sum."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(F.format_string("%.11e", value).cast("double"))


def entropy_of(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; nan of none."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.when(F.size(counts) == 0, float("nan")).otherwise(F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a - x / total * F.log2(x / total)))


def punctuation_counts(text: Column) -> dict[str, Column]:
    """Marks of 13 types: dashes, then ellipses, then single marks, then all other marks and symbols."""
    rest = F.regexp_replace(text, DASH, "")
    out = {"dash": F.regexp_count(text, F.lit(DASH)), "ellipsis": F.regexp_count(rest, F.lit(r"\x{2026}|\.\.\.+"))}
    rest = F.regexp_replace(rest, r"\x{2026}|\.\.\.+", "")
    known = ""
    for name, marks in MARKS.items():
        inside = "".join(f"\\x{{{ord(m):04X}}}" for m in marks)
        known += inside
        out[name] = F.regexp_count(rest, F.lit(f"[{inside}]"))
    out["other"] = F.regexp_count(rest, F.lit(rf"[\p{{P}}\p{{S}}&&[^{known}]]"))
    return out
