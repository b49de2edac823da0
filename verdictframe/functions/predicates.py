"""Row predicates and label vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label vocabularies.
VOTE_LABELS = ["vote_left", "vote_right", "vote_tie", "vote_both_bad"]
MERGED_LABELS = ["vote_left", "vote_right", "vote_uncertain"]
RAW_TO_VOTE = {
    "vote_model_A": "vote_left",
    "vote_model_B": "vote_right",
    "vote_tie": "vote_tie",
    "vote_both_bad": "vote_both_bad",
}
RAW_TO_WINNER = {
    "left": "model_a",
    "right": "model_b",
    "tie": "tie",
    "both_bad": "tie (bothbad)",
}


def present(column: Column | str) -> Column:
    """Neither NULL nor the empty string."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & (c != "")


def all_present(*columns: Column | str) -> Column:
    return reduce(lambda x, y: x & y, [present(c) for c in columns])


def lookup(column: Column, table: dict[str, str]) -> Column:
    """Value from a small fixed table; unknown values become NULL.

    A map literal names the column once. A ``CASE`` would repeat it per entry,
    and filters pushed below several of those multiply.
    """
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), column)


def vote_of(column: Column | str, accept_normalised: bool = True) -> Column:
    """Raw human or judge vote to the four-label vocabulary, else NULL."""
    c = F.col(column) if isinstance(column, str) else column
    table = dict(RAW_TO_VOTE)
    if accept_normalised:
        table.update({"vote_left": "vote_left", "vote_right": "vote_right"})
    return lookup(c, table)


def winner_of(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return lookup(c, RAW_TO_WINNER)


def merged_label(column: Column | str) -> Column:
    """Ties and both-bad votes form one uncertain class."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isin("vote_tie", "vote_both_bad"), F.lit("vote_uncertain")).otherwise(c)


def a_score(column: Column | str) -> Column:
    """Score of the left model in [0, 1]; anything but a win or loss is half."""
    c = F.col(column) if isinstance(column, str) else column
    return (
        F.when(c.isin("vote_left", "model_a"), F.lit(1.0))
        .when(c.isin("vote_right", "model_b"), F.lit(0.0))
        .otherwise(F.lit(0.5))
    )


# White space as in str.strip, i.e. ASCII controls and Unicode spaces.
SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def squeeze(column: Column) -> Column:
    """Strip all leading and trailing white space, not only blanks.

    Only the ends are looked at, unlike with a regular expression.
    """
    return F.btrim(column, F.lit(SPACE))


def short_model_name(column: Column) -> Column:
    return F.element_at(F.split(column, "/"), -1)
