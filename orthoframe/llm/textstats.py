"""Counts over whole texts as Spark expressions, without Python.

Expressions inside lambdas are evaluated anew for each element, so arrays that a lambda looks
into are bound with :func:`.common.let` first; every count takes time in proportion to the text
(or to ``n log n`` of its words).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = "#*$%&|<>"
#: Bits of a sorted number that hold a window's position; its hash has the others.
PLACE_BITS = 24


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def only(text: Column, kept: str) -> Column:
    """The characters of a regex class, in order."""
    return F.regexp_replace(_text(text), f"[^{kept}]+", "")


def _long(x: Column) -> Column:
    return F.size(x).cast("long")


def line_counts(text: Column) -> Column:
    r"""Struct of ``lines`` (cut at \n) and ``n_dup_lines``: those with a word that equal an earlier one."""

    def count(lines: Column) -> Column:
        # without two equal lines there is nothing to look at
        dup = let(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        dup = F.when(F.size(F.array_distinct(lines)) == F.size(lines), F.lit(0)).otherwise(dup)
        return F.struct(_long(lines).alias("lines"), dup.cast("long").alias("n_dup_lines"))

    return let(F.split(_text(text), "\n", -1), count)


def _covered(starts: Column) -> Column:
    """Words that windows of three at sorted starts cover: ``min(3, next - this)`` each."""

    def count(p: Column) -> Column:
        own = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))).cast("long"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(starts, count)


def _repeated_exactly(w: Column) -> Column:
    """Sorted starts of windows that stand twice or more, by sorting the windows' words themselves."""

    def at(i: Column) -> Column:
        shingle = F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.struct(shingle.alias("s"), i.alias("i"))

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["s"] == x["s"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"].cast("long")))

    return let(F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), at)), twice)


def n_repeat_words(found: Column) -> Column:
    """Words that lie in a window of three words found twice or more, the first one included.

    Windows are hashed to 64 bits, and most texts have no two alike. Otherwise numbers of hash (40
    bits) and position are sorted, so that equal windows stand together; neighbours of equal hashes
    are compared by their words. If these differ (a collision), windows are sorted by their words.
    """
    mask = (1 << PLACE_BITS) - 1

    def starts(w: Column, h: Column) -> Column:
        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))

        def look(v: Column) -> Column:
            def near(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(v, k).bitwiseXOR(x).between(0, mask), F.lit(False))

            def place(x: Column) -> Column:
                return x.bitwiseAND(F.lit(mask)).cast("int")

            def unlike(x: Column, k: Column) -> Column:
                a, b = place(x), place(F.get(v, k + 1))
                return near(x, k + 1) & ~((F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2)))

            twice = F.sort_array(F.transform(F.filter(v, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x.bitwiseAND(F.lit(mask))))
            return F.when(F.exists(F.transform(v, unlike), lambda x: x), _repeated_exactly(w)).otherwise(twice)

        return F.when(F.size(h) > mask, _repeated_exactly(w)).otherwise(let(F.sort_array(packed), look))

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        none = F.lit(0).cast("long")
        repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(starts(w, h))))
        return F.when(F.size(w) < 4, none).otherwise(repeats)

    return let(found, count)


def base_counts(text: Column, also: str = "") -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines of a text, and of
    ``marks``: its characters of the class ``SYMBOLS`` or ``also``. Null has no words and one line."""
    by_word = let(words(text), lambda w: F.struct(_long(w).alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_repeat_words(w).alias("n_repeat_words")))
    parts = F.struct(by_word.alias("w"), line_counts(text).alias("l"), only(text, SYMBOLS + also).alias("marks"))
    return let(
        parts,
        lambda p: F.struct(
            p["w"]["n_words"].alias("n_words"),
            p["w"]["word_chars"].alias("word_chars"),
            count_of(p["marks"], SYMBOLS).alias("n_symbols"),
            p["l"]["n_dup_lines"].alias("n_dup_lines"),
            p["w"]["n_repeat_words"].alias("n_repeat_words"),
            p["l"]["lines"].alias("lines"),
            p["marks"].alias("marks"),
        ),
    )


def count_of(text: Column, kept: str) -> Column:
    """Number of characters of a regex class."""
    return F.length(only(text, kept)).cast("long")
