"""Descriptor normalisation: bank text to a bare merchant string.

Every step is a native column expression, so a descriptor never leaves the JVM.
The public entry is :func:`scrub`; the steps are separate functions because each
one is useful (and tested) alone.
"""

from __future__ import annotations

import functools
import operator
import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook.functions.binding import let

# ---- fixed values: the word lists and patterns that define the result ------
PROCESSOR_INITIALS = ("SP", "SQ", "TST", "PP", "PAYPAL", "PY", "DD", "EC", "IN",
                      "WL", "IG", "BT", "PSP", "ISO")
PROCESSOR_PHRASES = (
    r"POS\s+(?:DEBIT|PURCHASE|PUR)",
    r"DEBIT\s+CARD\s+(?:PURCHASE|PUR)",
    r"CREDIT\s+CARD\s+PURCHASE",
    r"CHECKCARD",
    r"VISA\s+DDA\s+PUR",
    r"ACH\s+(?:DEBIT|CREDIT|WEB|PMT)",
    r"RECURRING\s+(?:PAYMENT|DEBIT|CARD\s+PURCHASE)",
    r"PREAUTHORIZED\s+(?:DEBIT|PAYMENT)",
    r"PURCHASE\s+AUTHORIZED\s+ON\s+\d{1,2}/\d{1,2}",
    r"PAYPAL\s+(?:INST\s+)?XFER",
    r"WEB\s+ID:?\s*\d+",
    r"EXT\s+TRNSFR",
)
DOMAIN_ENDINGS = ("COM", "NET", "ORG", "CO", "IO", "APP", "US", "GOV", "EDU")
STATE_CODES = tuple(
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO "
    "MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY "
    "DC PR VI GU".split())
WORD = r"[\p{L}\p{N}_]"
TRAILING_JUNK = (
    r"\s+\d{3}[-.\s]?\d{3}[-.\s]?\d{4}$",
    r"\s+\d{8,}$",
    r"\s+#\s*" + WORD + r"+$",
    r"\s+\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?$",
    r"\s+(?:USA?|CAN?)$",
    r"\s+X{2,}\d+$",
    r"\s+(?:REF|AUTH|INV|ID|TRN)[:#]?\s*" + WORD + r"+$",
)
LONGEST_LEADING_NUMBER = 2
SHORTEST_ID_TOKEN = 5
# ---------------------------------------------------------------------------

# Descriptors are nearly always plain ASCII. Those take patterns without Unicode
# classes, and a pattern only runs where a plain string test says it could match.
# (?U) makes \d, \s and \w mean their Unicode classes for the others.
_U = "(?U)"
_ASCII = r"^[\x00-\x7F]*$"
_BLANKS = " \t\n\r\f\x0b"
_PREFIXES = ("^(?:(?:" + "|".join(PROCESSOR_INITIALS) + r")\s*\*+\s*|(?:"
             + "|".join(PROCESSOR_PHRASES) + r")\s+)+")
_DOMAIN = r"\.(?:" + "|".join(DOMAIN_ENDINGS) + ")(?!" + WORD + ")"
_STATE = r"(?<=\S)\s+(?:" + "|".join(STATE_CODES) + ")$"


def _ends_in_digit(c: Column) -> Column:
    return functools.reduce(operator.or_, (c.endswith(d) for d in "0123456789"))


def _any(c: Column, *texts: str) -> Column:
    return functools.reduce(operator.or_, (c.contains(t) for t in texts))


# What plain ASCII text must have for TRAILING_JUNK[i] to match.
_COULD_MATCH = (
    _ends_in_digit,
    _ends_in_digit,
    lambda c: _any(c, "#"),
    lambda c: _ends_in_digit(c) & _any(c, "/", "-"),
    lambda c: functools.reduce(operator.or_, (c.endswith(x) for x in ("US", "USA", "CA", "CAN"))),
    lambda c: _ends_in_digit(c) & _any(c, "XX"),
    lambda c: _any(c, "REF", "AUTH", "INV", "ID", "TRN"),
)


def _drop(c: Column, pattern: str, plain: bool = False) -> Column:
    return F.regexp_replace(c, F.lit(pattern if plain else _U + pattern), F.lit(""))


def strip(c: Column, plain: bool = False) -> Column:
    """Whitespace off both ends: Unicode whitespace, or the ASCII kinds if `plain`."""
    return F.btrim(c, F.lit(_BLANKS)) if plain else _drop(c, r"^\s+|\s+$")


def peel_prefixes(c: Column, plain: bool = False) -> Column:
    """Take all prefixes off with one anchored, repeated group."""
    return _drop(c, _PREFIXES, plain)


def drop_domains(c: Column, plain: bool = False) -> Column:
    if plain:
        return let(c, lambda v: F.when(v.contains("."), _drop(v, _DOMAIN, True)).otherwise(v))
    return _drop(c, _DOMAIN)


def strip_state(c: Column, plain: bool = False) -> Column:
    """Drop a state code that follows something."""
    if plain:
        return let(c, lambda v: F.when(F.substring(v, -3, 1).isin(*_BLANKS),
                                       _drop(v, _STATE, True)).otherwise(v))
    return _drop(c, _STATE)


def _trailing_round(c: Column, plain: bool) -> Column:
    for i, pattern in enumerate(TRAILING_JUNK):
        if plain:
            c = let(c, lambda v, i=i, pattern=pattern: F.when(
                _COULD_MATCH[i](v), _drop(v, pattern, True)).otherwise(v))
        else:
            c = _drop(c, pattern)
        if i == 0:
            c = strip(c, plain)
    return strip_state(c, plain)


def _may_have_trailing(c: Column) -> Column:
    """Plain text that fails this has nothing to peel or strip."""
    by_pattern = [could(c) for could in _COULD_MATCH]
    state = F.substring(c, -3, 1).isin(*_BLANKS)
    edges = F.substring(c, 1, 1).isin(*_BLANKS) | F.substring(c, -1, 1).isin(*_BLANKS)
    return functools.reduce(operator.or_, (*by_pattern, state, edges))


def peel_trailing(c: Column, plain: bool = False) -> Column:
    """Rounds over the trailing patterns until one changes nothing. Each round before
    that takes two characters at least, a blank among them, which bounds their number. Of
    plain text most takes one round: none is run only to see that nothing is left."""
    def again(acc: Column, _: Column) -> Column:
        done = F.struct(acc["text"].alias("text"), F.lit(True).alias("done"))

        def judged(after: Column) -> Column:
            left = _may_have_trailing(after) if plain else F.lit(True)
            return F.when(after == acc["text"], done).otherwise(
                F.struct(after.alias("text"), (~left).alias("done")))

        return F.when(acc["done"], acc).otherwise(let(_trailing_round(acc["text"], plain), judged))

    def peeled(text: Column) -> Column:
        start = F.struct(text.alias("text"), F.lit(False).alias("done"))
        most = (F.length(text) - F.length(F.translate(text, _BLANKS, "")) if plain
                else F.floor(F.length(text) / 2).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), most), start, again)["text"]

    if not plain:
        return peeled(c)
    return let(c, lambda v: F.when(_may_have_trailing(v), let(
        _trailing_round(v, True), lambda after: F.when(
            (after != v) & _may_have_trailing(after), peeled(after)).otherwise(after)))
        .otherwise(v))


def words_only(c: Column, plain: bool = False) -> Column:
    """Letters, numbers, marks and the two joiners survive in every script."""
    keep = "A-Za-z0-9" if plain else r"\p{L}\p{N}\p{M}\x{200C}\x{200D}"
    return F.regexp_replace(c, F.lit(f"[^{keep} ]"), F.lit(" "))


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Regex class of the characters that count as digits: category Nd plus the
    superscripts, circled digits and the like that carry a digit value."""
    extra = [i for i in range(0x80, sys.maxunicode + 1)
             if chr(i).isdigit() and not chr(i).isdecimal()]
    return r"[\p{Nd}" + "".join(f"\\x{{{i:X}}}" for i in extra) + "]"


def drop_store_numbers(tokens: Column, plain: bool = False) -> Column:
    """All-digit tokens go, except a short first one (``7 ELEVEN``)."""
    numeric = "^" + ("[0-9]" if plain else digit_class()) + "+$"
    return F.filter(tokens, lambda t, i: ~t.rlike(numeric)
                    | ((i == 0) & (F.length(t) <= LONGEST_LEADING_NUMBER)))


def drop_id_tokens(tokens: Column, plain: bool = False) -> Column:
    """Tokens of five or more with both digits and letters go, but for the first."""
    digit, letter = ("[0-9]", "[A-Za-z]") if plain else (digit_class(), r"\p{L}")
    return F.filter(tokens, lambda t, i: (i == 0) | (F.length(t) < SHORTEST_ID_TOKEN)
                    | ~t.rlike(digit) | ~t.rlike(letter))


def _scrub(c: Column, plain: bool) -> Column:
    s = peel_trailing(drop_domains(peel_prefixes(strip(F.upper(c), plain), plain), plain), plain)
    tokens = F.filter(F.split(words_only(s, plain), " "), lambda t: t != "")
    return F.array_join(drop_id_tokens(drop_store_numbers(tokens, plain), plain), " ")


def scrub(c: Column) -> Column:
    """Normalise a bank descriptor to a merchant string (idempotent).

    A descriptor made of noise only becomes ``''``; such rows are kept and
    counted by the load report.
    """
    return F.when(c.rlike(_ASCII), _scrub(c, True)).otherwise(_scrub(c, False))
