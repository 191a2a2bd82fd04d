"""Text expressions shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide what counts as a link, a post link and a safe folder.
URL = r"https?://[^\s)\]]+"
PERMALINK = r"https?://(?:www\.)?reddit\.com/r/[^/]+/comments/([a-z0-9]+)(?:/[^/\s]*)?"
DIRECT_ID = r"comments/([^/]+)"
UNSAFE_IN_FOLDER = r'[\\/*?:"<>|]'

BLANKS = " \t\r\n"


def strip_prefix(subreddit: Column) -> Column:
    """Community name without a leading ``r/``."""
    return F.regexp_replace(subreddit, "^r/", "")


def urls(text: Column) -> Column:
    """All links of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1))


def permalink_id(url: Column) -> Column:
    """Post id inside a permalink, null for any other link."""
    return F.nullif(F.regexp_extract(url, PERMALINK, 1), F.lit(""))


def direct_id(target: Column) -> Column:
    """Post id of a direct target: the id part of a post URL, or the target itself."""
    found = F.nullif(F.regexp_extract(target, DIRECT_ID, 1), F.lit(""))
    return F.when(F.contains(target, F.lit("reddit.com")), F.coalesce(found, target)).otherwise(target)


def label(flair: Column) -> Column:
    """Flair text before the first colon, the whole text without one, ``N/A`` if empty."""
    head = F.btrim(F.substring_index(flair, ":", 1), F.lit(BLANKS))
    present = F.coalesce(flair, F.lit("")) != ""
    return F.when(~present, "N/A").when(F.contains(flair, F.lit(":")), head).otherwise(flair)


def note_name(subreddit: Column, post_id: Column) -> Column:
    return F.concat(strip_prefix(subreddit), F.lit("_"), post_id)


def wiki_link(subreddit: Column, post_id: Column) -> Column:
    return F.concat(F.lit("[["), note_name(subreddit, post_id), F.lit("]]"))


def safe_folder(text: Column) -> Column:
    return F.regexp_replace(text, UNSAFE_IN_FOLDER, "")


def word_pattern(phrases: Sequence[str]) -> str:
    """Regex for any of the phrases as whole words, in any case."""
    escaped = "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", p) for p in phrases)
    return rf"(?iu)(^|[^\p{{L}}\p{{N}}])({escaped})([^\p{{L}}\p{{N}}]|$)"


def word_edges(phrase: Column) -> Column:
    """The same pattern for one phrase that stands in a column."""
    escaped = F.regexp_replace(phrase, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.concat(F.lit(r"(?iu)(^|[^\p{L}\p{N}])("), escaped, F.lit(r")([^\p{L}\p{N}]|$)"))


def has_word(column: Column, phrases: Sequence[str]) -> Column:
    """True where the text holds one of the phrases; a null text holds none."""
    return F.coalesce(column.rlike(word_pattern(phrases)), F.lit(False))


def contains_any(column: Column, fragments: Sequence[str]) -> Column:
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | F.contains(column, F.lit(fragment))
    return F.coalesce(hit, F.lit(False))


def digits_or_zero(text: Column) -> Column:
    """Whole number written in digits only, else 0."""
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("int")), F.lit(0))


def python_bool(flag: Column) -> Column:
    """``True`` / ``False`` as notes spell them."""
    return F.when(flag, "True").otherwise("False")
