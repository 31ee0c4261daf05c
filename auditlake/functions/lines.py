"""Line arithmetic on whole file texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = r"\r\n|\r|\n"


def line_count(content: Column) -> Column:
    """Lines of a text file: a last line without newline counts, nothing follows a final newline."""
    unterminated = (content != "") & ~content.rlike(r"[\r\n]\z")
    feeds = F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit("")))
    # Only texts with carriage returns need the regex; the rest is a byte count.
    newlines = F.when(F.contains(content, F.lit("\r")), F.regexp_count(content, F.lit(NEWLINE))).otherwise(feeds)
    return newlines + unterminated.cast("int")


def split_lines(content: Column) -> Column:
    """All lines; the empty piece behind a final newline is not one."""
    pieces = F.split(content, NEWLINE, -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def around_line(pieces: Column, line: Column, before: int = 3, after: int = 3) -> Column:
    """Text from ``before`` lines above to ``after`` below a line, clipped to the file.

    ``pieces`` is the content split at newlines with the empty last piece kept.
    """
    start = F.greatest(line - before, F.lit(1))
    length = F.greatest(line + after - start + 1, F.lit(0))
    ends_inside = start + length <= F.size(pieces)
    text = F.array_join(F.slice(pieces, start, length), "\n")
    return F.concat(text, F.when(ends_inside & (length > 0), "\n").otherwise(""))
