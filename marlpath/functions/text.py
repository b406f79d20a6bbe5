"""Text normalisers. They look alike and aren't: each keeps, folds or drops other characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that titles are stripped of before tokens are compared.
STOP_WORDS = ("a", "al", "an", "and", "con", "de", "del", "el", "en", "for", "la", "las", "los", "of", "or", "para", "the", "un", "una", "y")
#: Token spellings that stand for another.
TOKEN_ALIASES = {"exp": "expansion"}


def fold_title_text(text: str) -> str:
    """Title key: accents off, "&" is "and", all but ASCII letters and digits parts words, lower case."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[^\x00-\x7f]", " ", plain.replace("&", " and ")).lower()).strip()


def fold_import_text(text: str) -> str:
    """Importer's key: ASCII only, "&" is "and", quotes and common punctuation part words, other symbols stay."""
    plain = unicodedata.normalize("NFD", text).encode("ascii", "ignore").decode().replace("&", " and ").lower()
    return " ".join(re.sub(r"""["'`:;,.!?()\[\]{}\-_/\\]""", " ", plain).split())


def fold_store_text(text: str) -> str:
    """Store filter's text: case folded, accents off, white space collapsed, punctuation kept."""
    plain = unicodedata.normalize("NFKD", text.casefold())
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())


def fold_item_text(text: str) -> str:
    """Item classifier's text: ASCII only, case folded, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().casefold().split())


def fold_match_text(text: str) -> str:
    """Detail matcher's text: case folded, accents off, all but ASCII letters and digits parts words."""
    plain = unicodedata.normalize("NFKD", text.casefold())
    return re.sub(r"[^a-z0-9]+", " ", "".join(c for c in plain if not unicodedata.combining(c))).strip()


def fold_ascii_text(text: str) -> str:
    """ASCII text, with ligatures spelled out."""
    for a, b in (("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ß", "ss")):
        text = text.replace(a, b)
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def vectorised(fold: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function of a text function, in Arrow batches; null stays null. The UDF is made where it is used: workers import this module without a session."""

    def apply(column: Column) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(fold, na_action="ignore")

        return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(column)

    return apply


fold_title, fold_import, fold_store, fold_item, fold_match, fold_ascii = (
    vectorised(f) for f in (fold_title_text, fold_import_text, fold_store_text, fold_item_text, fold_match_text, fold_ascii_text)
)


@lru_cache(maxsize=1)
def accented() -> tuple[str, str]:
    """The characters that Unicode takes apart into an ASCII letter with accents, and these letters."""
    taken = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2130)}
    found = {c: t[0] for c, t in taken.items() if t[0].isascii() and all("\u0300" <= x <= "\u036f" for x in t[1:])}
    return "".join(found), "".join(found.values())


def without_accents(column: Column) -> Column:
    """Latin letters without their accents, whether one character or two; other characters stay."""
    return F.regexp_replace(F.translate(column, *accented()), "[\u0300-\u036f]", "")


def fold_title_words(column: Column) -> Column:
    """fold_title_text as an expression, which stays in the JVM."""
    plain = F.regexp_replace(F.replace(without_accents(column), F.lit("&"), F.lit(" and ")), "[^a-zA-Z0-9]+", " ")
    return F.trim(F.lower(plain))


def fold_title_ascii(column: Column) -> Column:
    """fold_title for ASCII text, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(F.replace(column, F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))


def collapse(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def significant_tokens(title: Column) -> Column:
    """Distinct tokens of a folded title, aliases resolved, stop words off unless that leaves nothing."""
    words = F.filter(F.split(title, " "), lambda t: t != "")
    spelled = F.create_map(*[F.lit(x) for pair in TOKEN_ALIASES.items() for x in pair])
    words = F.array_distinct(F.transform(words, lambda t: F.coalesce(F.try_element_at(spelled, t), t)))
    kept = F.filter(words, lambda t: ~t.isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def slug_title(url: Column) -> Column:
    """A title from the last part of an address's path."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    return collapse(F.regexp_replace(F.element_at(F.split(path, "/"), -1), "-+", " "))


def fold_ascii_words(column: Column) -> Column:
    """Lower-case ASCII: accents off, ligatures spelled out, other characters dropped."""
    text = F.lower(column)
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(without_accents(text), r"[^\x00-\x7f]", "")


def listing_tokens(title: Column, url: Column, ignored: tuple[str, ...]) -> Column:
    """Distinct words of three letters or more in a title and in its address's slug, accents off."""
    text = fold_ascii_words(F.concat_ws(" ", title, slug_title(url)))
    words = F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*ignored)))


def without_site_suffix(title: Column) -> Column:
    """A page title up to its first " | ", or, without one, up to its first " - "."""
    bar = F.substring_index(title, " | ", 1)
    return F.trim(F.when(title.contains(" | "), bar).otherwise(F.substring_index(title, " - ", 1)))


def without_nul(column: Column) -> Column:
    return F.replace(column, F.lit("\0"), F.lit(""))


def bounded_text(column: Column, most: int) -> Column:
    """White space as single spaces, and at most ``most`` characters: the last three of a longer text are dots, unless only three or fewer are allowed."""
    plain = F.trim(F.regexp_replace(column, r"(?U)\s+", " "))
    cut = F.left(plain, F.lit(most)) if most <= 3 else F.concat(F.left(plain, F.lit(most - 3)), F.lit("..."))
    return F.when(F.length(plain) > most, cut).otherwise(plain)
