"""Expressions over the token arrays of a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\r\x0b\x0c"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_value(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once per row, also where ``use`` reads it in an inner lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def local_word_ids(numbers: Column | str) -> Column:
    """Chunk-local word ids 0,0,1,… from running word numbers; null and negative numbers give -1.

    Running numbers rise by one from word to word. A separator inside the text has the number n as ``-n - 1`` and
    leaves a gap, which is closed here; a separator between packed texts is null and leaves none.
    """
    numbers = _col(numbers)

    def with_gaps():
        first = F.array_min(F.filter(numbers, lambda n: n >= 0))
        gaps = F.transform(F.filter(numbers, lambda n: n < 0), lambda n: -n - 1)

        def renumbered(known):
            def local(n):
                closed = F.size(F.filter(known["gaps"], lambda g: (g > known["first"]) & (g < n)))
                return F.when(n >= 0, n - known["first"] - closed).otherwise(-1)

            return F.transform(numbers, local)

        return with_value(F.struct(first.alias("first"), gaps.alias("gaps")), renumbered)

    # Nearly no chunk has a separator inside a text; the others need one subtraction per token.
    def by_least(least):
        return F.when(least < 0, with_gaps()).otherwise(F.transform(numbers, lambda n: F.coalesce(n - least, F.lit(-1))))

    return with_value(F.array_min(numbers), by_least).cast("array<smallint>")


def chunk_words(input_ids: Column | str, word_ids: Column | str, spelled: Column, blanks: Column) -> Column:
    """Lower-cased words of a chunk, at the index of their chunk-local word id.

    ``spelled`` has every token twice, at twice its id as it is and at the next index with a NUL, which no token holds, before
    it. The words are written to one string, each from its marked first token on, and split again: one pass over the
    tokens, no explode and no shuffle. ``blanks`` tells whether any token has white space; it is dropped at both ends of a word.
    """
    input_ids, word_ids = _col(input_ids), _col(word_ids)
    small = lambda n: F.lit(n).cast("smallint")
    earlier = F.concat(F.array(small(-1)), word_ids)  # one longer: the last has no token
    starts = F.zip_with(word_ids.cast("array<smallint>"), earlier, lambda w, p: F.when(w >= small(0), F.when(w == p, F.lit(0)).otherwise(F.lit(1))))
    written = F.zip_with(input_ids, starts, lambda token, first: F.get(spelled, token * F.lit(2) + first))

    def split_line(line):
        found = F.split(F.lower(F.substr(line, F.lit(2))), "\x00")  # a single sign, so no pattern is matched
        trimmed = F.transform(found, lambda w: F.btrim(w, F.lit(WHITE_SPACE)))
        return F.when(F.length(line) == 0, F.array().cast("array<string>")).when(blanks, trimmed).otherwise(found)

    return with_value(F.array_join(written, ""), split_line)


def content_mask(input_ids: Column | str, ranks: Column | str, threshold: Column, mask_id: Column) -> Column:
    """Token ids with ``mask_id`` wherever the rank is at or past the threshold and not protected (-1)."""
    return F.zip_with(
        _col(input_ids),
        _col(ranks),
        lambda token, rank: F.when((rank >= threshold) & (rank != -1), mask_id).otherwise(token),
    )


def attention_mask(input_ids: Column | str, pad_id: int) -> Column:
    """1 for a token, 0 for padding."""
    return F.transform(_col(input_ids), lambda t: (t != pad_id).cast("tinyint"))


def token_ranks(input_ids: Column | str, lookup: Column) -> Column:
    """The rank of every token from a dense array indexed by token id."""
    return F.transform(_col(input_ids), lambda t: F.get(lookup, t))
