"""Line deduplication that answers with keep bitmaps; DataFrame functions only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, ``A-Z`` lower-cased. Keys of at least ``min_chars``
code points that ``min_docs`` documents hold keep their lines in the document of the largest id only.

1. Lines become 128-bit hashes of their keys; texts stay where they are. A document counts once per hash.
2. Entries are summed per hash and salt first, so a line that a third of all documents hold is a few entries. They are
   range-partitioned on the hash and sorted by hash and document; a running window over that order streams past the
   first entry of each hash, the document that keeps the line, and the documents before it.
3. Lines of a dropped hash are met by an equi-join, which adaptive execution splits, and become per-document bitmaps:
   64 lines to a word, words whose lines all stay are left out.

Defined cases: a null or empty text is one empty line. Rows of equal ``doc_id`` are one document in the counts, a null
id is one document and the smallest. Rows that repeat id and text get equal bitmaps. A text of any length is taken whole,
in time linear in its lines. Extra columns are kept by ``apply_bitmaps``, whatever their names, but that ``n_lines``,
``n_dropped`` and ``kept`` are replaced; they are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

MIN_CHARS, MIN_DOCS, SALTS = 20, 3, 64
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stripped from both ends of a line.
_BLANKS = " \t\n\x0b\x0c\r"
_ROW = ("__id", "__hash", "__size")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _row_names(docs: DataFrame) -> list[Column]:
    """What names a row: its id with a hash and the length of its text."""
    return [F.col("doc_id").alias("__id"), F.xxhash64(_text()).alias("__hash"), F.length(_text()).alias("__size")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``__id, __hash, __size, pos, h1, h2`` of every line whose key is long enough."""
    key = F.translate(F.trim(F.col("line"), F.lit(_BLANKS)), _A_Z, _a_z)
    # Hash and length before the explode: behind it they would be taken of the whole text for every line.
    named = docs.select(*_row_names(docs), _lines(_text()).alias("lines"))
    lines = named.select(*_ROW, F.posexplode("lines").alias("pos", "line"))
    return (
        lines.select(*_ROW, "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(*_ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )


def dropped_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``h1, h2, keeper``: keys held by enough documents, with the document that keeps them."""
    held = lines.groupBy("h1", "h2", "__id").agg(F.min("pos").alias("pos"))
    salted = held.groupBy("h1", "h2", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).alias("salt")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col("__id").alias("id"), F.col("pos").alias("pos"))).alias("last")
    )
    ordered = salted.repartitionByRange("h1", "h2").sortWithinPartitions(
        "h1", "h2", F.col("last.id").desc_nulls_last(), "last.pos"
    )
    run = Window.partitionBy("h1", "h2").orderBy(F.col("last.id").desc_nulls_last(), "last.pos")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ordered.select(
            "h1", "h2", F.col("last.id").alias("keeper"), F.row_number().over(run).alias("turn"), F.sum("n").over(whole).alias("docs")
        )
        .where((F.col("turn") == 1) & (F.col("docs") >= min_docs))
        .select("h1", "h2", "keeper")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``__id, __hash, __size, n_dropped, words``: rows that lose lines.

    ``words`` holds a bit for each line up to the last dropped one, 64 to a word, 1 where a line is dropped.
    """
    lines = line_hashes(docs, min_chars)
    # Equal rows of one document would meet each other's lines: one copy is enough.
    gone = (
        lines.distinct()
        .join(dropped_keys(lines, min_docs), ["h1", "h2"])
        .where("NOT (__id <=> keeper)")
        .select(*_ROW, (F.col("pos") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    )
    words = gone.groupBy(*_ROW, "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))
    held = words.groupBy(*_ROW).agg(
        F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held")
    )
    zero = F.lit(0).cast("long")
    gap = lambda e, k: e["word"] - F.coalesce(F.get("held", k - 1)["word"], F.lit(-1)) - 1
    filled = F.transform("held", lambda e, k: F.concat(F.array_repeat(zero, gap(e, k)), F.array(e["bits"])))
    return held.select(*_ROW, "n_dropped", F.flatten(filled).alias("words"))


def kept_text(lines: Column, words: Column) -> Column:
    """The lines that a bitmap keeps, joined by line ends."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, k % 64)
    word = lambda k: F.coalesce(F.get(words, (k / 64).cast("int")), zero)
    return F.array_join(F.filter(lines, lambda line, k: word(k).bitwiseAND(bit(k)) == 0), "\n")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines, n_dropped, kept``, which replace columns of these names."""
    # All columns in one, so that no name can clash.
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *_row_names(docs))
    marks = bitmaps.select(*[F.col(c).alias(f"m{c}") for c in _ROW], "n_dropped", "words")
    same = (
        F.col("__id").eqNullSafe(F.col("m__id"))
        & (F.col("__hash") == F.col("m__hash"))
        & (F.col("__size") == F.col("m__size"))
    )
    text = F.coalesce(F.col("__row.text").cast("string"), F.lit(""))
    joined = named.join(marks, same, "left").select(
        "__row",
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("words").isNull(), text).otherwise(kept_text(_lines(text), F.col("words"))).alias("kept"),
    )
    new = ["n_lines", "n_dropped", "kept"]
    return joined.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in new], *new)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
