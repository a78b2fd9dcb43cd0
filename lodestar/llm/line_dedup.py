"""Removal of lines that repeat an earlier line, or nearly, with DataFrame functions only.

A line is compared by its words. Lines of fewer than ``min_chars`` characters or without a
word are left alone. A line goes when an earlier line, by ``doc_id`` and then by its place,
has the same words, or when both have ``min_words`` words and inserting, deleting or
replacing one word makes them equal. With ``short_bytes`` lines of fewer words, as all are in
scripts without spaces, are held against each other by characters: one goes when both have
that many bytes of UTF-8, words joined by one space, and one character makes them equal. All
lines are judged on the input, so the earliest always stays.

The defaults are those of the SQL of ``op8_line_neighbourhoods``. ``EVERY_LINE`` are the
parameters under which every line with a word is compared.

Near lines are found by their deletion neighbourhood: a line's variants are what is left
when one word is taken out; in a short line a character stands for a word. Two lines differ by one replaced word when variants taken out
at the same place are equal, and by one inserted word when a variant of the longer equals
the shorter. Variants are emitted as hashes, equal ones meet in an aggregate that keeps the
earliest line, and the match is verified on the words themselves. As any line that
neighbours the key is a match, no pairs within a key are needed. Two lines one edit apart
also share two of three thirds, so only lines that share those with another line emit
variants. Filters of bits, of a fixed size, keep the keys that meet nothing out of the joins. Sums of 44-bit word hashes, with the place in them, stand for the words.

Whole texts are shuffled, once, only where a line goes or may go. A null or empty text stays
as it is. Rows with equal ``doc_id`` and text are one place: neither is
earlier. Words are parted by space and by characters 9 to 13, lines by character 10.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.staging import stage, staging_path

MIN_CHARS = 20
MIN_WORDS = 8
EVERY_LINE = {"min_chars": 1, "short_bytes": 20}

_BLANKS = "\t\x0b\f\r"
_WORD = r"[^ \t\x0b\f\r]"
_PLACE = ("doc_id", "t", "line_no")
_FILTER_BITS = 20


def _words(line: Column) -> Column:
    """The words of a line; none for a blank line."""
    return F.array_remove(F.split(F.translate(line, _BLANKS, "    "), " "), "")


def _units(words: Column, min_words: int, short_bytes: int | None) -> Column:
    """What may differ by one: words, or characters of a short line; null if it has too few."""
    long = F.when(F.size(words) >= min_words, words)
    if short_bytes is None:
        return long
    joined = F.array_join(words, " ")
    # no word has a space, so characters never equal words
    characters = F.transform(F.split(joined, ""), lambda c: F.concat(F.lit(" "), c))
    return long.when(F.octet_length(joined) >= short_bytes, characters)


def _hash(*parts: Column | int) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


def _same(*pairs: tuple[str, str]) -> Column:
    """Equality of columns where null equals null."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _first_words(n: Column) -> Column:
    return F.call_function("substring_index", F.col("j"), F.lit(" "), n)


def _last_words(n: Column) -> Column:
    return F.call_function("substring_index", F.col("j"), F.lit(" "), -n)


def _first_characters(n: Column) -> Column:
    return F.substr("j", F.lit(1), n)


def _last_characters(n: Column) -> Column:
    return F.substr("j", F.char_length("j") - n + 1, n)


def _thirds(n: Column, first: Callable[[Column], Column], last: Callable[[Column], Column]) -> Column:
    """Hashes of two of three parts of a line, for its own length and the length below.

    The parts are pieces of the joined line ``j``, cut by ``first`` and ``last``.
    """

    def parts(third: Column) -> Column:
        return F.array(
            _hash(third, 1, first(2 * third)), _hash(third, 2, last(2 * third)), _hash(third, 3, first(third), last(third))
        )

    third = F.floor(n / 3).cast("int")
    return F.when(n % 3 == 0, F.concat(parts(third), parts(third - 1))).otherwise(parts(third))


def _lines(source: DataFrame, min_chars: int, min_words: int, short_bytes: int | None) -> DataFrame:
    """One row per line that counts: its place, two hashes of its words and of its thirds.

    What an outer explode yields is computed once; a plain column would be computed again in
    every expression and filter that uses it.
    """
    line = F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")
    rows = source.select("doc_id", "t", line).filter((F.char_length("line") >= min_chars) & F.col("line").rlike(_WORD))
    rows = rows.select(*_PLACE, F.explode_outer(F.array(_words(F.col("line")))).alias("w"))
    rows = rows.select(*_PLACE, F.size("w").alias("n"), F.explode_outer(F.array(F.array_join("w", " "))).alias("j"))
    thirds = F.when(F.col("n") >= min_words, _thirds(F.col("n"), _first_words, _last_words))
    if short_bytes is not None:
        characters = _thirds(F.char_length("j"), _first_characters, _last_characters)
        thirds = thirds.when(F.octet_length("j") >= short_bytes, characters)
    return rows.select(*_PLACE, _hash(F.col("j")).alias("h1"), _hash(7, F.col("j")).alias("h2"), thirds.alias("thirds"))


def _possible(df: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """Add ``_possible``: false only for rows whose key, a long, is not in ``members``.

    The members are bits of 2^20 longs at most, which is all that is broadcast. The fuller
    the longs, the more rows pass that are not members.
    """
    words = 1 << _FILTER_BITS
    bit = F.shiftrightunsigned("_key", _FILTER_BITS).bitwiseAND(F.lit(63)).cast("int")
    held = (
        members.toDF("_key").groupBy(F.pmod("_key", F.lit(words)).alias("_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    )
    keyed = df.withColumn("_key", key).withColumn("_at", F.pmod("_key", F.lit(words)))
    met = keyed.join(F.broadcast(held), F.col("_at") == F.col("_word"), "left")
    found = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    return met.withColumn("_possible", F.coalesce(found, F.lit(False))).drop("_key", "_at", "_word", "_bits")


def _may_be_near(lines: DataFrame, different: DataFrame) -> DataFrame:
    """The first places of lines that share two thirds with another line."""
    keyed = lines.select("h1", "h2", F.explode("thirds").alias("third"))
    shared = stage(
        keyed.groupBy("third").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("third")
    )
    likely = _possible(keyed, F.col("third"), shared).filter("_possible").select("h1", "h2", "third").distinct()
    found = likely.join(shared, "third").select("h1", "h2").distinct()
    return found.join(different, ["h1", "h2"]).select("place.*")


def _near(texts: DataFrame) -> DataFrame:
    """The lines that are one word away from an earlier one, or one character if short.

    ``texts`` has ``line``, a number in the order of places, and as ``w`` the words or characters.
    """
    each = texts.select("line", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    bits = 20
    each = each.select(
        "line", "n", "i",
        F.shiftrightunsigned(_hash(F.col("word"), F.col("i")), bits).alias("here"),
        F.shiftrightunsigned(_hash(F.col("word"), F.col("i") - 1), bits).alias("moved"),
    )
    line = Window.partitionBy("line")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.select(
        "*", F.sum("here").over(line).alias("all_here"), F.sum("moved").over(line).alias("all_moved"),
        F.sum("here").over(upto).alias("here_to"), F.sum("moved").over(upto).alias("moved_to"),
    )
    replaced = _hash(F.lit("r"), F.col("n"), F.col("i"), F.col("all_here") - F.col("here"))
    shorter = F.col("here_to") - F.col("here") + F.col("all_moved") - F.col("moved_to")
    deleted = _hash(F.lit("d"), F.col("n") - 1, shorter)
    whole = _hash(F.lit("d"), F.col("n"), F.col("all_here"))
    forms = F.array(
        F.struct(F.lit(0).alias("role"), replaced.alias("key")),
        F.struct(F.lit(1).alias("role"), deleted.alias("key")),
        F.struct(F.when(F.col("i") == 0, F.lit(2)).alias("role"), whole.alias("key")),
    )
    variants = stage(
        summed.select("line", F.inline(forms)).filter("role is not null")
        .select("line", F.col("role").cast("byte").alias("role"), "key")
    )

    def earliest(role: int) -> Column:
        return F.min(F.when(F.col("role") == role, F.col("line")))

    keys = stage(
        variants.groupBy("key").agg(
            F.count(F.lit(1)).alias("many"), earliest(0).alias("r"), earliest(1).alias("d"), earliest(2).alias("w")
        ).filter("many > 1")
    )
    other = F.when(F.col("role") == 0, F.col("r")).when(F.col("role") == 1, F.col("w")).otherwise(F.col("d"))
    matches = variants.join(keys, "key").select("line", other.alias("other")).filter("other < line").distinct()
    earlier = texts.select(F.col("line").alias("other"), F.col("w").alias("v"))
    checked = matches.join(texts.select("line", "w"), "line").join(earlier, "other")
    return checked.filter(_one_word_apart(F.col("w"), F.col("v"))).select("line").distinct()


def _one_word_apart(a: Column, b: Column) -> Column:
    """Whether replacing, inserting or deleting one word makes the arrays equal."""
    size_a, size_b = F.size(a), F.size(b)
    together = F.least(size_a, size_b)
    # the first place where they differ, counted from 1
    split = F.coalesce(
        F.get(
            F.filter(F.sequence(F.lit(1), together), lambda i: F.get(a, i - 1) != F.get(b, i - 1)), F.lit(0)
        ),
        together + 1,
    )
    rest_a = F.slice(a, split + (size_a >= size_b).cast("int"), size_a)
    rest_b = F.slice(b, split + (size_b >= size_a).cast("int"), size_b)
    return (F.abs(size_a - size_b) <= 1) & (rest_a == rest_b)


def _stage_texts(df: DataFrame) -> DataFrame:
    """As ``stage``, for whole texts, with a codec that takes less disk."""
    path = staging_path(df.sparkSession)
    df.write.option("compression", "gzip").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stay(gone: Column) -> Column:
    """The lines of ``_text`` but those at the places listed."""
    return F.array_join(F.filter(F.split("_text", "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")


def _deduped(
    docs: DataFrame, text: str, own: list[str], output: Callable[[Column], Column], min_chars: int, min_words: int,
    short_bytes: int | None,
) -> DataFrame:
    """The columns ``own``, ``n_lines``, ``n_removed`` and what ``output`` makes of the kept text."""
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
        F.hash(F.col(f"`{text}`")).alias("t"),
    )
    lines = stage(_lines(source, min_chars, min_words, short_bytes))
    different = stage(
        lines.groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("place"), F.count(F.lit(1)).alias("many"))
    )
    repeated = stage(different.filter("many > 1").select("h1", "h2", F.col("place").alias("first")))
    likely = _possible(
        lines.select("h1", "h2", F.struct(*_PLACE).alias("place")), F.col("h1"), repeated.select("h1")
    ).filter("_possible").drop("_possible")
    again = likely.join(repeated, ["h1", "h2"]).filter("place <> first").select("place.*", F.lit(True).alias("goes"))
    may = _may_be_near(lines, different.drop("many")).withColumn("goes", F.lit(False))
    known = stage(
        again.unionByName(may).distinct().groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_u")).agg(
            F.collect_list(F.when(F.col("goes"), F.col("line_no"))).alias("_gone"),
            F.collect_list(F.when(~F.col("goes"), F.col("line_no"))).alias("_open"),
        )
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{text}`").alias("_text"),
        F.col("doc_id").cast("long").alias("_id"), F.hash(F.col(f"`{text}`")).alias("_t"),
    )
    none = F.array().cast("array<int>")
    # most texts have no line that goes or may go, and pass without a shuffle
    dealt = _possible(rows, _hash(F.col("_id"), F.col("_t")), known.select(_hash(F.col("_d"), F.col("_u"))))
    joined = dealt.filter("_possible").join(known, _same(("_id", "_d"), ("_t", "_u")), "left").withColumns(
        {"_gone": F.coalesce("_gone", none), "_open": F.coalesce("_open", none)}
    )
    waits = F.size("_open") > 0
    n_lines = F.coalesce(F.array_size(F.split("_text", "\n")), F.lit(0)).cast("long").alias("n_lines")
    whole = dealt.filter("not _possible").select("_row", n_lines, none.alias("_gone"), output(F.col("_text")).alias("_out"))
    passed = _stage_texts(
        joined.select(
            "_row", "_id", "_t", n_lines, "_gone", "_open", F.when(waits, F.col("_text")).alias("_text"),
            F.when(~waits, output(_stay(F.col("_gone")))).alias("_out"),
        )
    )
    waiting = passed.filter("size(_open) > 0")
    opened = waiting.select(
        F.col("_id").alias("doc_id"), F.col("_t").alias("t"), F.explode("_open").alias("line_no"), "_text"
    )
    words = opened.select(*_PLACE, _words(F.get(F.split("_text", "\n"), F.col("line_no"))).alias("w"))
    units = words.select(*_PLACE, _units(F.col("w"), min_words, short_bytes).alias("w"))
    ordered = units.dropDuplicates(list(_PLACE)).repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    texts = stage(ordered.withColumn("line", F.monotonically_increasing_id()))
    near = (
        _near(texts.select("line", "w")).join(texts.drop("w"), "line")
        .groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_u")).agg(F.collect_list("line_no").alias("_near"))
    )
    gone = F.array_union("_gone", F.coalesce("_near", none))
    settled = waiting.join(near, _same(("_id", "_d"), ("_t", "_u")), "left").withColumn("_gone", gone)
    done = whole.unionByName(passed.filter("size(_open) = 0").select("_row", "n_lines", "_gone", "_out")).unionByName(
        settled.select("_row", "n_lines", "_gone", output(_stay(F.col("_gone"))).alias("_out"))
    )
    return done.select(
        *[F.col("_row").getField(c).alias(c) for c in own], "n_lines",
        F.array_size("_gone").cast("long").alias("n_removed"), "_out",
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, text: str = "text",
    short_bytes: int | None = None,
) -> DataFrame:
    """Add ``n_lines``, ``n_removed`` and ``kept_text`` to every row; all columns are kept.

    ``kept_text`` has the lines that stay, unchanged; it is null for a null text.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept_text")]
    out = _deduped(docs, text, own, lambda kept: kept, min_chars, min_words, short_bytes)
    return out.withColumnRenamed("_out", "kept_text")


def without_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, text: str = "text",
    short_bytes: int | None = None,
) -> DataFrame:
    """The same columns, with only the lines that stay in the text."""
    own = [c for c in docs.columns if c != text]
    out = _deduped(docs, text, own, lambda kept: kept, min_chars, min_words, short_bytes)
    return out.select(*[F.col("_out" if c == text else f"`{c}`").alias(c) for c in docs.columns])


def line_digests(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, text: str = "text",
    short_bytes: int | None = None,
) -> DataFrame:
    """Per document ``n_lines``, ``n_removed`` and the SHA-256 of the lines that stay."""
    out = _deduped(
        docs, text, ["doc_id"], lambda kept: F.sha2(F.coalesce(kept, F.lit("")), 256), min_chars, min_words,
        short_bytes,
    )
    return out.withColumnRenamed("_out", "kept_sha256")
