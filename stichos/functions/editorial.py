"""Editorial marks of the Leiden conventions resolved to plain text: one Column expression per rule, applied in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import GAP

#: White space as Python's str.split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Metrical signs that stand for lost verse, in the order in which they are tried.
METRE = "⏑⏑‒|‒⏑⏑‒|‒⏑⏑|⏑|‒"

#: One pass from the left over tokens with single spaces: a lone hyphen; a token ending in one and a next one with one; such a
#: token and a next one without; such a token at the end.
DIVIDED = r"(?<!\S)(?:-(?!\S)|\S*-(?!\S) \S*-\S*|-*(\S*)-(?!\S) ([^\s-]+)(?!\S)|-*(\S*)-$)"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def words(text: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def integrations(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("||"), F.lit(" ")), F.lit("‖"), F.lit(" "))


def line_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit(" "))


def unclear_signs(text: Column) -> Column:
    return F.translate(text, "+*", "")


def brackets(text: Column) -> Column:
    """Lost sentences between two full stops vanish, line ends with their numbers become spaces, square brackets go, ends are trimmed."""
    joined = F.regexp_replace(text, r"(?U)\.[\s\x1c-\x1f]*<gap/>[\s\x1c-\x1f]*\.", ".")
    return trimmed(F.translate(line_ends(joined), "[]", ""))


def line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"\n\p{Nd}*", " ")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def metre(text: Column) -> Column:
    return F.regexp_replace(text, METRE, GAP)


def vacats(text: Column) -> Column:
    return F.regexp_replace(text, r"vac\.|vacat", "")


def notes(text: Column) -> Column:
    return F.regexp_replace(text, r"‡\p{Nd}+", "")


def doubts(text: Column) -> Column:
    return F.replace(text, F.lit("?"), F.lit(""))


def missing_lines(text: Column) -> Column:
    return F.regexp_replace(text, "⟦-+⟧", "")


def parentheses(text: Column) -> Column:
    return F.translate(text, "()", "")


def markers(text: Column) -> Column:
    """Supplied text in escaped angle brackets keeps its letters; left-over entities and line-break attributes go."""
    out = F.regexp_replace(text, "&lt;(.*?)&gt;", "$1")
    out = F.regexp_replace(out, "<gap/>lt;(.*?)&gt;", f"{GAP}$1")
    return F.regexp_replace(out, 'break="no"/&gt;|&gt;|&lt;', "")


def expunctions(text: Column) -> Column:
    return F.regexp_replace(text, r"\{\{.*?\}\}|\{.*?\}", "")


def parallels(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, "†.*?†", ""), "†_", "")


def dashes(text: Column) -> Column:
    """Words divided by hyphens joined again; the text of tokens with single spaces, where it has a hyphen at all.

    A lone hyphen goes; a word ending in one takes the next word, unless that has a hyphen itself, which removes both; a word
    starting with one joins the word before; others lose theirs.
    """

    def joined(t: Column) -> Column:
        plain = F.regexp_replace(F.array_join(words(t), " "), DIVIDED, "$1$2$3")
        return F.translate(F.replace(F.trim(F.regexp_replace(plain, " +", " ")), F.lit(" -"), F.lit("")), "-", "")

    return once(text, lambda t: F.when(t.contains("-"), joined(t)).otherwise(t))


#: The rules in their order.
RULES: tuple[Callable[[Column], Column], ...] = (
    *(integrations, line_breaks, unclear_signs, lambda t: brackets(t), metre, vacats, notes, doubts, missing_lines),
    *(parentheses, markers, expunctions, parallels, dashes),
)


def editorial(text: Column) -> Column:
    """text with all editorial marks resolved. Null stays null."""
    for rule in RULES:
        text = rule(text)
    return text
