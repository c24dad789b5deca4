"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space.
_BLANKS = r"\s\x1c-\x1f\x85\xa0  -     　"
BLANK = f"[{_BLANKS}]+"
#: Runs of it that are more than the one space which they become; most words of a text stand apart by just that.
_WIDE = f" [{_BLANKS}]+|[[^ -~]&&[{_BLANKS}]][{_BLANKS}]*"
# Fixed value: what counts as a mail address; group 1.
EMAIL = r"(?i)(?:^|[^A-Za-z0-9_.+-])([A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Z0-9.-]+\.[A-Z]{2,63})"
# Local parts that stand for nobody.
PLACEHOLDERS = ["example", "test", "yourname", "user", "you"]
# Words that tie a person to a company, and words that place one outside.
RELATIONSHIP = r"(?i)\b(founders?|co-founders?|cofounders?|chief|ceo|cto|cfo|coo|president|director|head of|engineer|our team|team member|leadership|works at|works for|employee)\b"
OUTSIDER = r"(?i)\b(testimonial|customer story|customer quote|our customer|our investor|investor|former (?:ceo|cto|chief|employee|president|director)|previously (?:worked|served|was)|ex-ceo|ex-cto|used to work)\b"
#: One of these stands in lower case wherever the latter match.
_HINTS = ("testimonial", "customer", "investor", "former ", "previously ", "ex-c", "used to work")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x worked out once for all its uses, within a function of array elements too."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, _WIDE, " "))


#: Characters that fold otherwise than they lower, to one character and to several.
_FOLDS = [(c, c.casefold()) for c in map(chr, range(0x110000)) if c.casefold() != c.lower()]
_ONE, _MORE = [x for x in _FOLDS if len(x[1]) == 1], [x for x in _FOLDS if len(x[1]) > 1]
#: Line ends, as Unicode has them.
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def folded(x: Column) -> Column:
    """x for comparison without regard to case."""
    one = F.translate(F.lower(x), "".join(a for a, _ in _ONE), "".join(b for _, b in _ONE))
    table = F.str_to_map(F.lit("|".join(f"{a}={b}" for a, b in _MORE)), F.lit("[|]"), F.lit("="))
    more = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    every = F.when(one.rlike("[" + "".join(a for a, _ in _MORE) + "]"), more).otherwise(one)
    # ASCII letters only lower.
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(every)


def says(x: Column, excerpt: Column) -> Column:
    """Whether x, squeezed, holds a squeezed excerpt. x is squeezed only where its words all stand in it, but not as they are in the excerpt."""
    return x.contains(excerpt) | (F.forall(F.split(excerpt, " "), lambda w: x.contains(w)) & squeezed(x).contains(excerpt))


def _hinted(x: Column) -> Column:
    return let(F.lower(x), lambda low: reduce(lambda a, b: a | b, (low.contains(h) for h in _HINTS)))


def outsider(x: Column) -> Column:
    """Whether x places someone outside of a company."""
    return _hinted(x) & x.rlike(OUTSIDER)


def _lines_with(x: Column, keep: Callable[[Column], Column]) -> Column:
    """Lines of those parts of x, between line feeds, that keep() takes."""
    return F.flatten(F.transform(F.filter(F.split(x, "\n"), keep), lambda part: F.split(part, LINES)))


def outsider_lines(x: Column) -> Column:
    return F.filter(_lines_with(x, _hinted), outsider)


def first_line(x: Column, part: Column, most: int) -> Column:
    """The first line of at most so many characters that holds part, or null."""
    return F.get(F.filter(_lines_with(x, lambda y: y.contains(part)), lambda y: y.contains(part) & (F.length(y) <= most)), F.lit(0))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}|{BLANK}$", "")


def all_emails(x: Column) -> Column:
    """Lower-case addresses in the order of the text."""
    return F.transform(F.regexp_extract_all(x, F.lit(EMAIL), F.lit(1)), F.lower)


def emails(x: Column) -> Column:
    """Sorted distinct lower-case addresses."""
    return F.array_sort(F.array_distinct(all_emails(x)))


def owned(addresses: Column, hosts: Column) -> Column:
    """Addresses on one of hosts whose local part isn't a placeholder."""
    return F.filter(addresses, lambda e: F.array_contains(hosts, F.split_part(e, F.lit("@"), F.lit(2))) & ~F.split_part(e, F.lit("@"), F.lit(1)).isin(PLACEHOLDERS))


def single_sentence(x: Column) -> Column:
    return (F.regexp_count(x, F.lit(r"[.!?](?:\s+|$)")) == 1) & F.right(x, F.lit(1)).isin(".", "!", "?")
