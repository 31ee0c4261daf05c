"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own words say so, so equal passages give equal chunks
wherever they stand. Chunks are de-duplicated to identifiers, verified by their
contents; a text is then the ordered list of its identifiers, its recipe, and
texts are equal where recipes are. Contents move once, each distinct chunk of a
task; everything after that moves recipes, a few bytes a hundred words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.binding import let
from auditlake.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CUT = 128  # one word in so many ends a chunk, by its hash
LONGEST = 1024  # words of a chunk, at most
TOKEN = "[^ \\n]{0,63}+[ \\n]|[^ \\n]{1,64}+"  # a word with the blank after it, or 64 characters of a longer one


def normalised(text: str | Column) -> Column:
    """The text with A-Z alone in lower case; null is empty."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    return F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text, and an empty text has none.

    A word ends a chunk if its hash says so, whatever stands before it; stretches
    without such a word are cut every ``LONGEST`` words.
    """

    def cut(words: Column) -> Column:
        ends = F.transform(words, lambda w, i: F.when(F.pmod(F.xxhash64(w), F.lit(CUT)) == 0, i + 1))
        cuts = F.array_union(F.concat(F.array(F.lit(0)), F.filter(ends, lambda e: e.isNotNull())), F.array(F.size(words)))

        def between(cuts: Column) -> Column:
            spans = F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda a, i: F.struct(a.alias("a"), F.get(cuts, i + 1).alias("b")))
            short = F.transform(
                spans,
                lambda s: F.transform(
                    F.sequence(s["a"], s["b"] - 1, F.lit(LONGEST)),
                    lambda at: F.concat_ws("", F.slice(words, at + 1, F.least(F.lit(LONGEST), s["b"] - at))),
                ),
            )
            return F.flatten(short)

        return let(cuts, between)

    return F.when(text == "", F.array().cast("array<string>")).otherwise(let(F.regexp_extract_all(text, F.lit(TOKEN), 0), cut))


def identified(docs: DataFrame, recipes: DataFrame, text: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """``recipes`` (text_sha256, hashes, ...) with ``recipe``: verified identifiers (hash, twin) in order.

    Different chunks of one hash are told apart by ``twin``, their place in the
    order of contents; a hash of one content has twin 0 only, so texts need no
    join to learn it. Contents are read again only for hashes that clash.
    """
    contents = docs.select(F.explode(chunks(normalised(text))).alias("chunk")).select(hashed(F.col("chunk")).alias("hash"), "chunk").distinct()
    clashes = written(contents.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "chunk-clashes")
    if clashes.isEmpty():
        return recipes.withColumn("recipe", F.transform("hashes", lambda h: F.struct(h.alias("hash"), F.lit(0).alias("twin"))))
    order = Window.partitionBy("hash").orderBy("chunk")
    twins = contents.join(clashes, "hash").select("hash", "chunk", (F.row_number().over(order) - 1).alias("twin"))
    places = docs.select(normalised(text).alias("t")).select(F.sha2("t", 256).alias("text_sha256"), F.posexplode(chunks(F.col("t"))).alias("place", "chunk"))
    found = places.select("text_sha256", "place", hashed(F.col("chunk")).alias("hash"), "chunk").join(twins.filter("twin > 0"), ["hash", "chunk"])
    marked = found.groupBy("text_sha256").agg(F.map_from_entries(F.collect_set(F.struct("place", "twin"))).alias("twins"))
    twin = lambda place: F.coalesce(F.try_element_at("twins", place), F.lit(0))
    ids = F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), twin(i).alias("twin")))
    return recipes.join(marked, "text_sha256", "left").withColumn("recipe", ids).drop("twins")


def duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", hashed: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row: its group of equal texts.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    ``keep_id`` is the largest id of the group, and ``kept`` holds for the rows that
    have it: repeated rows of that id stay together. A null id is never larger than
    another and is kept only where no row of the group has an id. Rows count in
    ``group_size`` as often as they occur. An empty table gives no row; other
    columns are not read, so their names can't clash.

    Documents are never shuffled. Of their chunks each distinct content goes
    through one shuffle, combined in the tasks first, so copies cost nothing
    there; groups are counted by recipe before rows are joined, and the join is a
    plain one that adaptive execution splits where one group holds many rows.
    """
    rows = docs.select(F.col(id).alias("_id"), normalised(text).alias("_text"))
    hashes = F.transform(chunks(F.col("_text")), lambda c: hashed(c))
    rows = written(rows.select("_id", F.sha2("_text", 256).alias("text_sha256"), hashes.alias("hashes")), "chunk-recipes")
    listed = identified(docs.select(F.col(text).alias("_text")), rows, "_text", hashed).select("_id", "text_sha256", "recipe")
    groups = listed.groupBy("recipe").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    found = listed.join(written(groups, "recipe-groups"), "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("_id").alias(id),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
