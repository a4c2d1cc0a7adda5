"""Text expressions: tokenizers, cleaning, previews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]


def strip_blanks(c: Column) -> Column:
    """All white space removed, the ideographic blank included."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def mixed_tokens(c: Column) -> Column:
    """Latin words in lower case, and overlapping pairs of each Han run (a lone Han character is itself a token).

    Three compiled extractions instead of an interpreted lambda a run: a look-ahead yields the pairs.
    The tokens are a bag; words come before pairs.
    """
    t, han = F.lower(F.coalesce(c, F.lit(""))), "\\u4e00-\\u9fff"
    words = F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))
    pairs = F.regexp_extract_all(t, F.lit(f"(?=([{han}]{{2}}))"), F.lit(1))
    alone = F.regexp_extract_all(t, F.lit(f"(?<![{han}])([{han}])(?![{han}])"), F.lit(1))
    return F.concat(words, pairs, alone)


def cjk_tokens(c: Column) -> Column:
    """As ``mixed_tokens`` after all white space is removed, so neighbouring Latin words are glued."""
    return mixed_tokens(strip_blanks(c))


def latin_tokens(c: Column) -> Column:
    """Words between characters that are neither letters nor digits, kept if all Han or ASCII letters."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t.rlike(r"^[一-鿿a-z]+$"))


#: The tokenizers by the name under which an index keeps its own.
TOKENIZERS: dict[str, Tokenizer] = {f.__name__: f for f in (mixed_tokens, cjk_tokens, latin_tokens)}


def strip_fences(c: Column) -> Column:
    """Markdown code fences and surrounding white space removed."""
    return F.regexp_replace(F.regexp_replace(c, r"```(?:json)?\s*", ""), r"(?U)^\s+|\s+$", "")


def preview(c: Column, n: int, always: bool = False) -> Column:
    """The first ``n`` characters with an ellipsis: for longer texts only, or ``always``."""
    cut = F.concat(F.substring(c, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(c) > n, cut).otherwise(c)


def one_line(c: Column) -> Column:
    return F.translate(c, "\n", " ")
