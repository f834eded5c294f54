"""Column expressions for scraped text cells."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketflow.functions.util import as_col

# Multipliers of the amount units seen in fund sizes ("500 Mil", "3.2 Bil").
_UNIT_SCALE = {"": 1.0, "k": 1e3, "th": 1e3, "m": 1e6, "mil": 1e6, "mn": 1e6,
               "b": 1e9, "bil": 1e9, "bn": 1e9, "t": 1e12, "tril": 1e12, "tn": 1e12}


def percent_to_number(c, compat: bool = False) -> Column:
    """``"0.45%"`` -> 0.45; malformed text (``"—"``, ``""``) -> NULL.

    ``compat=True`` keeps the 32-bit float of the original pipeline.
    """
    stripped = F.regexp_replace(as_col(c), "%", "")
    return stripped.try_cast("float" if compat else "double")


def scale_amount(c, compat: bool = False) -> Column:
    """Amount text with a unit -> number.

    Default: number (commas allowed) times its unit (Mil, Bil, ...), so
    ``"12.5 Mil"`` -> 12.5e6 and ``"1,234 Mil"`` -> 1.234e9.
    ``compat=True`` reproduces the original text replacement of ``" Mil"`` by
    ``"000000"`` followed by a float cast (``"12.5 Mil"`` -> 12.5).
    """
    c = as_col(c)
    if compat:
        return F.regexp_replace(c, " Mil", "000000").try_cast("float")
    pattern = r"^\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"
    number = F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    # one lookup in a literal map (folded to a constant), so the unit regex
    # runs once per row rather than once per unit compared
    scale = F.create_map(*[x for name, mult in _UNIT_SCALE.items() for x in (F.lit(name), F.lit(mult))])
    return number * F.try_element_at(scale, unit)


# HTML's named character references (as "amp;" or, for the old ones, also "amp"), from the standard library.
_NAMES = "\x01".join(f"{n}\x02{c}" for n, c in html5.items())
# The old names that count without a semicolon, longest first.
_OLD = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# Numbers 0x80 to 0x9F mean the characters of Windows-1252, where it has any.
_C1 = "".join(bytes([i]).decode("cp1252", "replace") if bytes([i]).decode("cp1252", "ignore") else chr(i) for i in range(0x80, 0xA0))
_NOTHING = ((1, 8), (0x0B, 0x0B), (0x0E, 0x1F), (0x7F, 0x7F), (0xFDD0, 0xFDEF))   # numbers of no character
LOST = "\ufffd"
_OFTEN = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;")
_ALL = 2147483647


def _character(value: Column) -> Column:
    """Character of a numeric reference (NULL: too long a number)."""
    return F.transform(F.array(value), _one_character)[0]


def _one_character(number: Column) -> Column:
    lost = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    none = (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    for low, high in _NOTHING:
        none = none | number.between(low, high)
    return (F.when(lost, LOST).when(number.between(0x80, 0x9F), F.substr(F.lit(_C1), (number - 0x7F).cast("int"), F.lit(1)))
             .when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))


def decode_entities(c) -> Column:
    """Text as displayed: numeric and named character references resolved, each once.

    The text is cut at ``&`` and each piece looks at its own beginning, so a
    reference made by another one ("&amp;lt;", "&#38;lt;") is left alone.  A
    number of no character gives U+FFFD, an unknown name keeps its ``&``; as in
    HTML, numbers and the old names may stand without a semicolon.  A text
    without ``&`` costs one search.
    """
    names = F.str_to_map(F.lit(_NAMES), F.lit("\x01"), F.lit("\x02"))       # folded to one literal, searched from its start
    often = F.create_map(*[x for n in _OFTEN for x in (F.lit(n), F.lit(html5[n]))])

    def begun(x, i):             # what the piece starts with, found once; a "#" begins numbers only
        hashed = x.startswith("#")
        return F.struct(x.alias("x"), (i == 0).alias("first"),
                        F.when((i > 0) & hashed, F.regexp_extract(x, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)).otherwise("").alias("number"),
                        F.when((i > 0) & ~hashed, F.regexp_extract(x, "^[^\\t\\n\\f <&#;]{1,32};?", 0)).otherwise("").alias("name"))

    def valued(p):
        hexed = F.lower(F.substring(p["number"], 2, 1)) == "x"
        digits = F.ltrim(F.rtrim(F.when(hexed, F.substring(p["number"], 3, _ALL)).otherwise(F.substring(p["number"], 2, _ALL)), F.lit(";")), F.lit("0"))
        return F.struct(*[p[n].alias(n) for n in ("x", "first", "number", "name")], F.when(p["number"] != "", F.struct(hexed.alias("hexed"), digits.alias("digits"))).alias("n"),
                        F.when(p["name"] != "", F.coalesce(F.try_element_at(often, p["name"]), F.try_element_at(names, p["name"]))).alias("known"))

    def resolved(p):
        digits = F.when(F.length(p["n"]["digits"]) <= 8, F.concat(F.lit("0"), p["n"]["digits"]))
        value = F.when(p["n"]["hexed"], F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        old = F.regexp_extract(p["name"], f"^(?:{_OLD})", 0)
        return (F.when(p["first"], p["x"])
                 .when(p["number"] != "", F.concat(_character(value), F.substring(p["x"], F.length(p["number"]) + 1, F.lit(_ALL))))
                 .when(p["known"].isNotNull(), F.concat(p["known"], F.substring(p["x"], F.length(p["name"]) + 1, F.lit(_ALL))))
                 .when(old != "", F.concat(F.try_element_at(names, old), F.substring(p["x"], F.length(old) + 1, F.lit(_ALL))))
                 .otherwise(F.concat(F.lit("&"), p["x"])))

    def piece_texts(text):
        return F.transform(F.transform(F.transform(F.split(text, "&"), begun), valued), resolved)
    # the text is bound once: in a lambda or a generator each mention would compute it again
    return F.transform(F.array(as_col(c)), lambda text: F.when(text.contains("&"), F.array_join(piece_texts(text), "")).otherwise(text))[0]


def strip_tags(c) -> Column:
    """An HTML fragment as displayed: markup dropped, character references
    resolved, line breaks and surrounding white space reduced."""
    plain = F.regexp_replace(F.regexp_replace(as_col(c), r"<[^>]*>", ""), r"[ \t]*[\r\n]+[ \t]*", " ")
    return F.trim(decode_entities(plain))


def contains_phrase(c, phrase: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(as_col(c)).contains(phrase.lower())
