"""Text rules as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence ends and the marks that may close after them.
TERMINAL = "。！？；：…!?;:."
CLOSING = "”’」』）】》〉〕］\"')]"
# Controls, private marks and invisible characters that no text should carry.
ANOMALY = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFFFD\\u200B-\\u200F\\u2060\\uFEFF]"
# Punctuation whose width differs and its ASCII form.
WIDE, NARROW = "，。！？；：（）［］", ",.!?;:()[]"
# Marks of punctuation and what they are compared as; full-width ASCII follows by rule.
MARKS_FOLDED, MARKS_TO = "，、。：；？！（）「」『』“”‘’—–－．", ",,.:;?!()\"\"\"\"\"\"''---."
_FULL = [chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in MARKS_FOLDED]
FOLD_FROM, FOLD_TO = MARKS_FOLDED + "".join(_FULL), MARKS_TO + "".join(chr(ord(c) - 0xFEE0) for c in _FULL)


def has_anomaly(c: Column | str) -> Column:
    """Whether a text carries a control, replacement or invisible character; null for null."""
    return F.col(c).rlike(ANOMALY) if isinstance(c, str) else c.rlike(ANOMALY)


def ends_sentence(c: Column) -> Column:
    """Closing marks aside, the last character ends a sentence."""
    return F.rtrim(c).rlike(f"[{TERMINAL}][{CLOSING.replace(']', chr(92) + ']')}]*$")


def squash(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def scoring_text(c: Column) -> Column:
    """Line ends unified, trailing blanks of lines and blank edge lines dropped."""
    t = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(t, "^\n+", ""), "\n+$", "")


def fold_width(c: Column) -> Column:
    return F.lower(F.translate(c, WIDE, NARROW))


def fold_comparison(c: Column) -> Column:
    """Key for comparing readings: widths, marks of punctuation and case folded, blanks kept. Never shown to a reader."""
    return F.lower(F.translate(c, FOLD_FROM, FOLD_TO))


def unrepresentable(c: Column) -> Column:
    """Whether a text has a control, format or private character other than tab and line end, or the replacement character."""
    return F.translate(c, "\t\n\r", "").rlike("[\\p{Cc}\\p{Cf}\\p{Co}\\x{FFFD}]")


def without_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, "[!-/:-@\\[-`{-~，。！？；：、“”‘’「」『』…—–]", "")


def join_lines(left: Column, right: Column) -> Column:
    """One space between ASCII letters or figures, none between others; an empty side gives the other."""
    gap = F.when(left.rlike("[0-9A-Za-z]$") & right.rlike("^[0-9A-Za-z]"), F.lit(" ")).otherwise(F.lit(""))
    return F.when(F.coalesce(left, F.lit("")) == "", right).when(F.coalesce(right, F.lit("")) == "", left).otherwise(F.concat(left, gap, right))


def assemble(texts: Column) -> Column:
    """Fold an array of lines with the Latin space rule: a space between word characters if either is a letter."""
    def step(acc: Column, t: Column) -> Column:
        last, first = F.substring(acc, -1, 1), F.substring(t, 1, 1)
        latin = lambda c: c.rlike("[A-Za-zÀ-ÖØ-öø-ÿ]")
        word = lambda c: c.rlike("[0-9A-Za-zÀ-ÖØ-öø-ÿ]")
        return F.concat(acc, F.when(word(last) & word(first) & (latin(last) | latin(first)), F.lit(" ")).otherwise(F.lit("")), t)

    return F.aggregate(F.filter(texts, lambda t: t.isNotNull()), F.lit(""), step)


def excerpt(text: Column, term: str, width: int = 72) -> Column:
    """A window of ``width`` characters around the first literal match."""
    at = F.instr(text, term)
    return F.substring(text, F.greatest(F.lit(1), at - (width - len(term)) // 2), F.lit(width))


def redact(c: Column) -> Column:
    """Home folders, bearer tokens and key=value secrets masked."""
    t = F.regexp_replace(c, "/(?:home|Users)/[^/ ]+", "~")
    t = F.regexp_replace(t, "(?i)bearer [A-Za-z0-9._-]+", "bearer ***")
    return F.regexp_replace(t, "(?i)(token|secret|password|api_key)=[^ &]+", "$1=***")


def ngram_set(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n))))
