"""Document fingerprints: a Merkle tree over sections, paragraphs and passages.

Only DataFrame functions are used. A text is cut into paragraphs at line breaks,
a paragraph into passages of at most ``PASSAGE_WORDS`` words that also end at a
sentence's end after ``PASSAGE_LEAST``, so an edit disturbs the cuts of its own sentence only. Leaves
are hashes of passages; a paragraph's node hashes its leaves in order; a section
ends with a paragraph whose node begins with 0 or 1, after about ``8`` paragraphs
and ``SECTION`` at most, so an inserted paragraph disturbs its own section only;
a section's node hashes its paragraphs; the root hashes the sections' nodes and
the SHA-256 of the text itself. The fingerprint writes the tree out:

    root ; section | section | ...
    section   = node=paragraph.paragraph. ...   (16 hex digits)
    paragraph = node:leaf,leaf, ...             (16 hex digits, 8 for each leaf)

so that equal roots prove equal texts. For unequal ones, only sections that the
other tree lacks are opened, and of these the paragraphs that the other's opened
sections lack are the edits (``locate_edits``). The likeness of two fingerprints
is the Dice coefficient of their leaves as multisets, ``2 * common / all``.

Defined results: a null text counts as empty and has a tree without leaves; two
such are alike to 1; the document after the last is the first; documents that
repeat an id, or have none, stand in the order of their texts' MD5; an empty table
gives an empty result; all other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, two_columns

PASSAGE_LEAST, PASSAGE_WORDS = 4, 8
#: Paragraphs of a section, at most.
SECTION = 32
#: White space, as everywhere in this subpackage, is 0x20 and 0x09-0x0D; a paragraph has no line feed.
_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09\x0B-\x0D]"
#: A few words up to a sentence's end, else as many as fit; what white space leads a paragraph stands alone.
_PASSAGE = (
    rf"(?:{_WORD}++{_GAP}++){{{PASSAGE_LEAST - 1},{PASSAGE_WORDS - 1}}}?{_WORD}++(?<=[.!?])(?:{_GAP}++|\z)"
    rf"|(?:{_WORD}++(?:{_GAP}++|\z)){{1,{PASSAGE_WORDS}}}|{_GAP}++"
)
#: A section of joined paragraphs.
_ENTRY = r"[0-9a-f]{15}:[0-9a-f,]*+\."
_SECTION = rf"(?:[2-9a-f]{_ENTRY}){{0,{SECTION - 1}}}[0-9a-f]{_ENTRY}"


def _short(value: Column, digits: int = 8) -> Column:
    """The first hex digits of the MD5."""
    return F.left(F.md5(value.cast("binary")), F.lit(digits))


def leaf_tree(text: Column) -> Column:
    """array<array<string>>: for each paragraph the hashes of its passages."""
    paragraphs = F.split(text, "\n")
    return F.transform(paragraphs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(_PASSAGE), F.lit(0)), lambda x: _short(x)))


def sections_of(tree: Column) -> Column:
    """array<string>: the sections of a tree, as the fingerprint writes them.

    They are cut from the joined paragraphs by a pattern: a lambda that reaches
    for a column of the row would compute it again for each element.
    """
    paragraphs = F.transform(tree, lambda p: F.array_join(p, ","))
    joined = F.array_join(F.transform(paragraphs, lambda p: F.concat(_short(p, 16), F.lit(":"), p, F.lit("."))), "")
    return F.transform(F.regexp_extract_all(joined, F.lit(_SECTION), F.lit(0)), lambda s: F.concat(_short(s, 16), F.lit("="), s))


def written(sections: Column, text_sha: Column) -> Column:
    """The fingerprint; the text's own digest makes equal roots mean equal texts."""
    nodes = F.array_join(F.transform(sections, lambda s: F.left(s, F.lit(16))), "|")
    return F.concat(F.sha2(F.concat_ws("|", nodes, text_sha).cast("binary"), 256), F.lit(";"), F.array_join(sections, "|"))


def _counted(tree: Column) -> Column:
    """Each leaf with its turn among equal ones, so that sets of these behave as multisets.

    Runs of equal leaves are found by a pattern over the sorted, joined leaves.
    """
    joined = F.array_join(F.array_sort(F.flatten(tree)), "")
    runs = F.regexp_extract_all(joined, F.lit(r"([0-9a-f]{8})\1*+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), (F.length(r) / 8).cast("int")), lambda j: F.concat(F.left(r, F.lit(8)), F.lit("#"), j.cast("string")))))


def likeness(left: Column, right: Column) -> Column:
    """2 * common / all over counted leaves; 1 where neither has any."""
    both = F.size(left) + F.size(right)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(left, right)) / both)


def paragraph_nodes(sections: Column) -> Column:
    """The nodes of the paragraphs of some sections."""
    return F.regexp_extract_all(F.array_join(sections, "|"), F.lit("([0-9a-f]{16}):"), F.lit(1))


def edited_nodes(left: Column, right: Column) -> Column:
    """Nodes of the left paragraphs that differ, each once: of sections that the right tree lacks, those that its opened sections lack."""
    return F.array_except(paragraph_nodes(F.array_except(left, right)), paragraph_nodes(F.array_except(right, left)))


def locate_edits(left: Column, right: Column) -> Column:
    """array<int>: places (from 0) of the left fingerprint's paragraphs that differ from the right one."""
    own, other = (F.split(F.element_at(F.split(x, ";"), 2), r"\|") for x in (left, right))
    # one pass over the paragraphs for each that differs
    places = F.transform(edited_nodes(own, other), lambda e: F.filter(F.transform(paragraph_nodes(own), lambda p, i: F.when(p == e, i)), lambda i: i.isNotNull()))
    return F.array_sort(F.flatten(places))


def fingerprint(text: Column) -> Column:
    """root;sections of a text column."""
    return written(sections_of(leaf_tree(text)), F.sha2(text.cast("binary"), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    return two_columns(docs, id_col, text_col).select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


def _longs(values: list[int]) -> Column:
    """One array literal, whatever its length."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def range_of(doc_id: Column, text: Column, cuts: list[int], parts: list[int], null_parts: int) -> Column:
    """Number of the range that a row falls into; ranges ascend as the order of rows does.

    Range k holds the ids from the k-th of the ascending ``cuts`` on. The rows of
    a cut itself are dealt by their texts' MD5 into its ``parts``, those without
    id into ``null_parts``, so an id that many rows repeat is in many ranges.
    """
    wide = 1 << 20
    digest = F.conv(F.left(F.md5(text.cast("binary")), F.lit(8)), 16, 10).cast("long")
    null_range = F.shiftright(digest * F.lit(null_parts), 32) - F.lit(wide)
    if not cuts:
        return F.when(doc_id.isNull(), null_range).otherwise(F.lit(0).cast("long"))
    step = math.isqrt(len(cuts)) + 1
    blocks = F.size(F.filter(_longs(cuts[step - 1 :: step]), lambda c: c <= doc_id))
    place = blocks * step + F.size(F.filter(F.slice(_longs(cuts), blocks * step + 1, F.lit(step)), lambda c: c <= doc_id))
    cut, many = F.get(_longs(cuts), place - 1), F.get(_longs(parts), place - 1)
    # behind the rows of the cut come those of larger ids
    part = F.when(cut.isNull(), F.lit(0)).when(cut < doc_id, many).otherwise(F.shiftright(digest * many, 32))
    return F.when(doc_id.isNull(), null_range).otherwise(place.cast("long") * wide + part)


def with_next(docs: DataFrame) -> DataFrame:
    """Each row of (doc_id, text, tree) with ``next_text`` and ``next_tree`` of the row after it by id.

    The rows are dealt by ranges of ids, cut at approximate quantiles, so a range
    is one task's worth of rows, and a window looks one row ahead. The first row
    of each range also goes to the end of the range before it, as a guest, so
    each text moves once and nothing is joined to them.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    n = 2 * parts
    found = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    often = Counter(int(c) for c in found)
    cuts = sorted(often)
    n_rows, n_null = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    digest = F.md5(F.col("text").cast("binary"))
    placed = docs.withColumn("_range", range_of(F.col("doc_id"), F.col("text"), cuts, [often[c] for c in cuts], 1 + n * n_null // max(1, n_rows)))
    first = F.min(F.struct(F.col("doc_id"), digest.alias("digest"), F.xxhash64("text").alias("check"))).alias("first")
    # a row of few numbers for each range: 4 * spark.sql.shuffle.partitions of them, about
    heads = sorted(placed.groupBy("_range").agg(first).collect(), key=lambda r: r["_range"])
    guests = [(*head["first"], before["_range"]) for before, head in zip(heads, [*heads[1:], *heads[:1]], strict=True)]
    table = F.broadcast(spark.createDataFrame(guests, "_first bigint, _digest string, _check bigint, _range bigint"))
    same = F.col("doc_id").eqNullSafe(F.col("_first")) & (digest == F.col("_digest")) & (F.xxhash64("text") == F.col("_check"))
    guest = docs.join(table, same).groupBy("_range").agg(F.min("text").alias("text"))
    guest = guest.select(F.lit(None).cast("long").alias("doc_id"), "text", "_range", F.lit(1).alias("_guest"))
    dealt = placed.select("doc_id", "text", "_range", F.lit(0).alias("_guest")).unionByName(guest)
    # each tree is made once, and moves with its text
    dealt = dealt.withColumn("tree", leaf_tree(F.col("text"))).repartition(parts, "_range")
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), digest, "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "tree")}).where("_guest = 0").drop("_guest", "_range")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and where they differ.

    The edited text has the last ``floor(n / 2)`` of the text's n code points
    replaced by the first as many (or all) of the next document.
    ``edited_paragraphs`` counts the different paragraphs that the edited text
    lacks, ``first_edited`` is the place of the first of them, or -1.
    """
    rows = with_next(two_columns(docs, id_col, text_col))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))})
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "tree",
        leaf_tree(F.col("edited")).alias("edited_tree"),
        "next_tree",
    )
    rows = rows.withColumns({k: _counted(F.col(t)) for k, t in (("own", "tree"), ("other", "edited_tree"), ("next", "next_tree"))})
    rows = rows.withColumns({"sections": sections_of(F.col("tree")), "edited_sections": sections_of(F.col("edited_tree"))})
    rows = rows.withColumn("edits", edited_nodes(F.col("sections"), F.col("edited_sections")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("sections"), F.col("text_sha")).alias("fingerprint"),
        written(F.col("edited_sections"), F.col("edited_sha256")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        F.size("edits").cast("long").alias("edited_paragraphs"),
        F.coalesce(F.array_position(paragraph_nodes(F.col("sections")), F.try_element_at("edits", F.lit(1))) - 1, F.lit(-1)).cast("long").alias("first_edited"),
    )
