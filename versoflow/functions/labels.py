"""Printed page labels, headings and contents entries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman labels are read up to this value.
ROMAN_MOST = 100


def roman(value: int) -> str:
    out = ""
    for n, s in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while value >= n:
            out, value = out + s, value - n
    return out


def cjk(value: int) -> str:
    """Chinese numeral up to 99 in the form with tens."""
    d = "〇一二三四五六七八九"
    if value < 10:
        return d[value]
    tens, ones = divmod(value, 10)
    return (d[tens] if tens > 1 else "") + "十" + (d[ones] if ones else "")


def _lookup(pairs: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def bare_label(c: Column) -> Column:
    """A margin text without the marks around its numeral."""
    return F.regexp_replace(c, "^[\\[(\\-–— ]*(?:[pP]\\. *)?|[\\])\\-–—. ]*$", "")


def label_scheme(c: Column) -> Column:
    """arabic, roman, cjk or unnumbered; a label has at most 12 characters."""
    b = bare_label(c)
    return (
        F.when(F.length(c) > 12, "unnumbered").when(b.rlike("^[0-9]{1,6}$") & (b != "0"), "arabic")
        .when(b.rlike("^(?:[ivxlc]+|[IVXLC]+)$") & label_value(c).isNotNull(), "roman").when(label_value(c).isNotNull() & b.rlike("^[一二三四五六七八九十]+$"), "cjk").otherwise("unnumbered")
    )


def label_value(c: Column) -> Column:
    """The number of a label, null if it has none; roman ones in one case and canonical."""
    b = bare_label(c)
    romans = _lookup({roman(i): i for i in range(1, ROMAN_MOST + 1)})
    cjks = _lookup({cjk(i): i for i in range(1, 100)})
    return F.when(b.rlike("^[0-9]{1,6}$") & (b != "0"), F.expr("1") * b.try_cast("int")).when(b.rlike("^(?:[ivxlc]+|[IVXLC]+)$"), F.try_element_at(romans, F.upper(b))).otherwise(F.try_element_at(cjks, b))


def entry_kind(title: Column) -> Column:
    """part, chapter, section or entry."""
    return (
        F.when(title.rlike("^(?i:part|partie|teil) [0-9ivxIVX]+|^第[一二三四五六七八九十0-9]+部"), "part")
        .when(title.rlike("^(?i:chapter|chapitre|kapitel) [0-9ivxIVX]+|^第[一二三四五六七八九十0-9]+章"), "chapter")
        .when(title.rlike("^[0-9]+\\.[0-9]+ |^第[一二三四五六七八九十0-9]+[節节]"), "section").otherwise("entry")
    )


CONTENTS_LINE = "^(.{2,60}?)(?:[ .…·]{2,})([0-9]{1,4}|[ivxlc]{1,8})$"


def roman_value(c: Column) -> Column:
    """Value of a canonical roman numeral in one case, to 3999; null for anything else."""
    u = F.when(c.rlike("^(?:[ivxlcdm]+|[IVXLCDM]+)$"), F.upper(c))
    ok = u.rlike("^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$")
    value = lambda x: F.element_at(F.create_map(*[F.lit(v) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in p]), x)
    # From the end: a figure less than the one after it is taken away.
    step = lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.when(x < a["last"], -x).otherwise(x)).alias("sum"))
    figures = F.transform(F.reverse(F.split(u, "")), value)
    return F.when(ok, F.aggregate(figures, F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum")), step, lambda a: a["sum"]).cast("bigint"))


def cjk_value(c: Column) -> Column:
    """Value of a Chinese numeral of up to six characters with tens, hundreds and thousands; null for anything else."""
    figures = F.split(F.when(c.rlike("^[〇零一二三四五六七八九十百千]{1,6}$"), c), "")

    digits = F.create_map(*[v for k, d in enumerate("〇一二三四五六七八九") for v in (F.lit(d), F.lit(k))])

    def step(a: Column, x: Column) -> Column:
        unit = F.when(x == "十", 10).when(x == "百", 100).when(x == "千", 1000)
        n = F.when(x == "零", 0).otherwise(F.element_at(digits, x))
        return F.when(unit.isNull(), F.struct(a["sum"].alias("sum"), n.cast("bigint").alias("now"))).otherwise(F.struct((a["sum"] + F.when(a["now"] == 0, 1).otherwise(a["now"]) * unit).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("now")))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(figures, F.struct(zero.alias("sum"), zero.alias("now")), step, lambda a: a["sum"] + a["now"])
