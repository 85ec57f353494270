"""Column functions on text: Unicode-safe normalisers, line splitting, lenient parsing, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that ends a line, as Unicode sees it.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
#: Chinese characters and their signs, which are joined without a blank.
CHINESE = r"[㐀-鿿，。；：！？、（）【】《》“”‘’]"


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with ``value`` computed once; inside lambdas nothing else shares common subexpressions."""
    return F.transform(F.array(value), body)[0]


def squeezed(text: Column) -> Column:
    """Runs of any Unicode white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def comparable(text: Column) -> Column:
    """Squeezed lower case; null counts as empty."""
    return F.lower(squeezed(F.coalesce(text, F.lit(""))))


def blank_to_null(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))


def lines(text: Column) -> Column:
    """Non-blank stripped lines in order."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), stripped), lambda x: x != "")


def effective_text(raw: Column, decision: Column, corrected: Column) -> Column:
    """A discarded text is empty, an accepted correction stands for the text, else the text as delivered."""
    return (
        F.when(decision == "DISCARD", F.lit(""))
        .when((decision == "ACCEPT") & (F.length(F.coalesce(corrected, F.lit(""))) > 0), corrected)
        .otherwise(F.coalesce(raw, F.lit("")))
    )


def joined(previous: Column, following: Column) -> Column:
    """Two parts of wrapped text put together: no blank beside Chinese characters or signs."""
    tight = F.right(previous, F.lit(1)).rlike(CHINESE) | F.left(following, F.lit(1)).rlike(CHINESE)
    return F.when(previous == "", following).when(following == "", previous).when(tight, F.concat(previous, following)).otherwise(F.concat(previous, F.lit(" "), following))


def clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def whole_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(-1.0))


def is_digest(text: Column) -> Column:
    """64 lower-case hexadecimal digits; null is none."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(stripped(text)) > 0, F.lit(False))


def excerpt(text: Column, length: int = 240) -> Column:
    return F.substring(text, 1, length)


def label_escaped(text: Column) -> Column:
    """For metric labels: backslash, quote and line feed escaped."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def valid_box(box: Column) -> Column:
    """A normalised box within [0, 1] whose corners are in order; anything else, null too, is not valid."""
    x1, y1, x2, y2 = (box[c].try_cast("double") for c in ("x1", "y1", "x2", "y2"))
    inside = (box["unit"] == "normalized") & (x1 >= 0) & (x1 <= x2) & (x2 <= 1) & (y1 >= 0) & (y1 <= y2) & (y2 <= 1)
    return F.coalesce(inside, F.lit(False))


def path_within(root: str, relative: str) -> str:
    """``root/relative``; an absolute path or one that leaves ``root`` is an error."""
    import posixpath

    whole = posixpath.normpath(posixpath.join(root, relative))
    if posixpath.isabs(relative) or not (whole == root.rstrip("/") or whole.startswith(root.rstrip("/") + "/")):
        raise ValueError(f"{relative!r} leaves {root!r}")
    return whole


def list_digest(values: Column) -> Column:
    """SHA-256 of the sorted values, one a line: the hash of a set of hashes."""
    return F.sha2(F.array_join(F.array_sort(values), "\n"), 256)


def canonical_json(**fields: Column) -> Column:
    """JSON with the names in alphabetical order, nulls kept, no blanks."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
