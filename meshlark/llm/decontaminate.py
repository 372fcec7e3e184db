"""Benchmark decontamination by a prefix-filtered join, in DataFrame functions alone.

A benchmark item is cut into windows of consecutive words.  A document holds a
window only if it holds all of the window's shingles (two neighbouring words),
so a single necessary prefix shingle -- the one rarest in the corpus -- has to
be joined.  Positions and lengths bound the candidates, which are then compared
word by word with the document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import ascii_lower, materialize, other_id

WINDOW = 10
#: What separates words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to this many rows (24 bytes each) a shingle list is sent to all executors; a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: And up to this many bytes a table of windows is.
BROADCAST_BYTES = 24 * BROADCAST_ROWS
#: Remainders that a sieve before the join tells apart at most.
SIEVE = 1 << 20
#: Bytes of a row besides its texts: a digest, numbers and the row's own fields.
ROW_BYTES = 160


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; ``lower`` does that for ASCII, the slower ``translate`` for the rest."""
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), ascii_lower(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def shingles_of(words: Column) -> Column:
    """Per word, a hash of the word and the next one; the last word stands alone."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def bounded(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """Broadcasts a table whose number of rows and bytes, counted before, are small enough; else it is joined by
    shuffle, whatever its compressed files seem to allow."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df.hint("merge")


def measured(windows: DataFrame) -> tuple[int, int]:
    """Rows of the table of windows, and about the bytes of their words and items in memory."""
    # An element of an array has 8 bytes for its place and is padded to 8.
    texts = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x) + 16)
    own = texts("words") + texts("items") + ROW_BYTES
    found = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(own), F.lit(0)).alias("bytes")).first()
    return found["n"], found["bytes"]


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(window, n, words, items)``: every different window once, with the ids of the items that have it."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    windows = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(size)))).alias("words"))
    return windows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.sha2(F.concat_ws(" ", "words"), 256).alias("window"), F.size("words").alias("n"), "words", "items"
    )


def sieve_of(shingles: DataFrame, rows: int) -> Callable[[Column], Column]:
    """A test that every one of ``shingles`` passes, and few others: a byte for each of up to SIEVE remainders, held by the plan.

    It only saves rows before the join that decides; a longer list passes all.
    """
    size = 1 << min(SIEVE.bit_length() - 1, (16 * rows).bit_length())
    if 4 * rows > size:
        return lambda x: F.lit(True)
    taken = bytearray(size)
    for r in shingles.select(F.pmod("shingle", F.lit(size)).cast("int").alias("at")).distinct().collect():
        taken[r["at"]] = 1
    return lambda x: F.substring(F.lit(bytes(taken)), (F.pmod(x, F.lit(size)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")


def _seen(words: DataFrame, single: bool, passes: Callable[[Column], Column]) -> DataFrame:
    """``(doc, alt, size, pos, shingle)`` for the words of ``words(doc, alt, words)`` whose shingle passes the sieve, and again for the word alone if ``single``.

    Sizes and shingles come before the explode, so that its rows carry no array.
    """

    def each(shingles: Column) -> DataFrame:
        own = words.select("doc", "alt", F.size("words").alias("size"), shingles.alias("shingle"))
        own = own.withColumn("pos", F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0))))
        found = F.filter(F.arrays_zip("pos", "shingle"), lambda z: z["shingle"].isNotNull() & passes(z["shingle"]))
        return own.select("doc", "alt", "size", F.explode(found).alias("z")).select("doc", "alt", "size", "z.pos", "z.shingle")

    found = each(shingles_of(F.col("words")))
    return found.union(each(F.transform("words", lambda w: F.xxhash64(w, F.lit(None).cast("string"))))) if single else found


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", size: int = WINDOW, carry: Sequence[str] = (),
) -> DataFrame:
    """Find benchmark windows of ``size`` words in every whole document.

    Returns one row per input row: ``id_col``, ``n_words``, ``n_hit`` (words
    inside an occurrence), ``n_items``, ``items_sha256``, ``contaminated``,
    ``hits`` (array of ``start``, ``stop`` in words, end exclusive) and the
    columns ``carry``.

    Null text has no words; texts may be of any length.  An item of fewer words
    than ``size`` is one window, one without words none.  Items with a null id
    mark words but are not counted or listed; items with one id count once.
    Every row is judged by its own text, whether its id is null or repeated.
    An empty table of documents gives an empty result, an empty benchmark one
    without hits; other columns are ignored.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None)
    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row.alias("row")).withColumn("alt", other_id())
    windows = materialize(benchmark_windows(items, item_id_col, item_text_col, size), "benchmark-windows")
    own = windows.select("window", "n", F.posexplode(F.slice(shingles_of(F.col("words")), F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)))).alias("offset", "shingle"))
    vocabulary = own.select("shingle").distinct()
    # A window of one word is looked up by that word, for which the documents give every word alone as well.
    words = words_of(F.col("text"))
    texts, single = base.select("doc", "alt", words.alias("words")), bool(windows.where("n = 1").limit(1).count())
    # Every table that may be broadcast is counted itself: windows can far outnumber their shingles.
    n_shingles = vocabulary.count()
    n_windows, window_bytes = measured(windows)

    # Rarity is counted over the whole corpus, without keeping a place; a window that has a shingle nowhere occurs nowhere.
    seen = _seen(texts, single, sieve_of(vocabulary, n_shingles)).select("shingle")
    rarity = seen.join(bounded(vocabulary, n_shingles), "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    rarity = materialize(rarity, "benchmark-rarity")
    first = Window.partitionBy("window").orderBy("df", "shingle", "offset")
    prefix = own.join(rarity, "shingle", "left").withColumn("rank", F.row_number().over(first)).where("rank = 1 AND df IS NOT NULL")
    prefix = materialize(prefix.select("window", "n", "offset", "shingle"), "benchmark-prefixes")
    n_prefixes = prefix.count()
    candidates = (
        _seen(texts, single, sieve_of(prefix, n_prefixes)).join(bounded(prefix, n_prefixes, n_prefixes * ROW_BYTES), "shingle")
        .select("doc", "alt", "window", "n", (F.col("pos") - F.col("offset")).alias("start"), "size")
        .where("start >= 0 AND start + n <= size")
        .join(bounded(windows.select("window", "words", "items"), n_windows, window_bytes), "window")
        .groupBy(F.col("doc").alias("c_doc"), F.col("alt").alias("c_alt"))
        .agg(F.collect_set(F.struct("start", "n", "words", "items")).alias("candidates"))
    )
    candidates = materialize(candidates, "benchmark-candidates")

    # Only texts with candidates meet them; the others, nearly all, stay where they are.
    suspects = candidates.select("c_doc", "c_alt")
    n_suspects = suspects.count()
    suspects = bounded(suspects, n_suspects, n_suspects * ROW_BYTES)
    mine = F.col("doc").eqNullSafe(F.col("c_doc")) & F.col("alt").eqNullSafe(F.col("c_alt"))
    judged = base.join(suspects, mine, "left_semi").join(candidates, mine).select("doc", "row", words.alias("words"), "candidates")
    real = F.filter("candidates", lambda c: F.slice("words", c["start"] + 1, c["n"]) == c["words"])
    kept = F.transform(real, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["items"].alias("items")))
    judged = judged.select("doc", "row", F.size("words").cast("bigint").alias("n_words"), kept.alias("real"))
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("items", T.ArrayType(T.StringType()))])))
    clean = base.join(suspects, mine, "left_anti").select("doc", "row", F.size(words).cast("bigint").alias("n_words"), none.alias("real"))

    def digested(found: DataFrame) -> DataFrame:
        covered = F.array_distinct(F.flatten(F.transform("real", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
        found = found.withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.col("real.items"))))).withColumn("n_hit", F.size(covered).cast("bigint"))
        return found.select(
            F.col("doc").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
            F.array_sort(F.transform("real", lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["n"]).alias("stop")))).alias("hits"),
            *(F.col(f"row.`{c}`").alias(c) for c in carry),
        )

    return digested(judged).union(digested(clean))
