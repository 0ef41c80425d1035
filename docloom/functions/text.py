"""Tokenizer: lower-cased runs of letters and digits without accents.

``tokens`` is the column form and ``query_tokens`` the same rule for the few
words of a query on the driver.
"""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of letters, numbers or private-use characters.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{Co}]+"


def _accent_table() -> dict[str, str]:
    """Latin letters with exactly one accent -> base letter; accents -> ''.

    Letters carrying two marks keep them, as in the default diacritics mode
    of the tokenizer this follows.
    """
    table = {}
    for cp in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
            table[chr(cp)] = parts[0].lower()
    table.update({chr(cp): "" for cp in range(0x0300, 0x0370)})
    return table


_ACCENTS = _accent_table()
# translate() drops the characters that have no partner, so the bare accents
# go last.
_FROM = "".join(sorted(_ACCENTS, key=lambda c: _ACCENTS[c] == ""))
_TO = "".join(_ACCENTS[c] for c in _FROM)


def fold(text) -> Column:
    """Lower case without accents; pure ASCII text skips the accent lookup."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(low, _FROM, _TO))


def tokens(text) -> Column:
    """Array of tokens of a text column, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def with_tokens(df, text="content", name="tokens"):
    """Add the token array, computed once per row.

    A plain projection would be copied into every predicate that uses the
    tokens when filters are pushed below it, and the text tokenized once per
    predicate. A one-element explode is not crossed by that rule.
    """
    return df.select("*", F.explode(F.array(tokens(F.coalesce(F.col(text), F.lit(""))))).alias(name))


def query_tokens(text: str) -> list[str]:
    """Tokens of a query string."""
    folded = "".join(_ACCENTS.get(c, c) for c in text.lower())

    def keep(c):
        category = unicodedata.category(c)
        return category[0] in "LN" or category == "Co"

    return "".join(c if keep(c) else " " for c in folded).split()
