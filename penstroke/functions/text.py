"""Text cleaning, predicates, seeded digests and the built-in tokenizer, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and placeholders that results depend on.
URL_PATTERN = r"https?://[^\t\n\f\r ]+|www\.[^\t\n\f\r ]+"
MENTION_PATTERN = r"@[0-9A-Za-z_]+"
URL_PLACEHOLDER = "<h>"
USER_PLACEHOLDER = "<u>"
ARTICLE_NAME_PATTERN = r"^(?:a|an)\s+(?!\.)"
NO_PERSON_PATTERN = r"anonymous|unknown|anon\b|various|staff|collaborative|\band\b|&"
SENTINEL_AUTHORS = ("[deleted]", "None", "nan")
LETTER_PATTERN = r"\p{L}"

# Fixed values of the built-in tokenizer.
WORD_PATTERN = r"\p{L}+|[^\s\p{L}\p{N}<]+|\p{N}+|</?s>|<[uh]>|<"
PIECE_PATTERN = r"\p{L}{1,4}|[^\s\p{L}\p{N}<]{1,4}|\p{N}{1,4}|</?s>|<[uh]>|<"
PIECE_CHARS = 4
SEPARATOR_WORDS = ("<s>", "</s>")


def seeded_digest(*columns: Column | str, seed: str = "42") -> Column:
    """MD5 in hex of the joined columns followed by the seed: a reproducible random order."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.md5(F.concat(*texts, F.lit(str(seed))))


def digest_number(digest: Column | str) -> Column:
    """The leading 60 bits of a hex digest as a bigint, in the same order as the digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def clean_social_text(text: Column | str) -> Column:
    """Addresses become ``<h>``, then mentions become ``<u>``."""
    without_urls = F.regexp_replace(text, URL_PATTERN, URL_PLACEHOLDER)
    return F.regexp_replace(without_urls, MENTION_PATTERN, USER_PLACEHOLDER)


def names_no_person(author: Column | str) -> Column:
    """True for a missing name and for one that stands for no single person."""
    author = F.col(author) if isinstance(author, str) else author
    matched = author.rlike(f"(?iuU){ARTICLE_NAME_PATTERN}") | author.rlike(f"(?iuU){NO_PERSON_PATTERN}")
    return F.coalesce(matched, F.lit(True))


def is_sentinel_author(author: Column | str, values=SENTINEL_AUTHORS) -> Column:
    author = F.col(author) if isinstance(author, str) else author
    return author.isNull() | author.cast("string").isin(*values)


def is_countable_word(word: Column | str) -> Column:
    """True when the word has a letter."""
    word = F.col(word) if isinstance(word, str) else word
    return F.coalesce(word.rlike(LETTER_PATTERN), F.lit(False))


def words(text: Column | str) -> Column:
    """Words of a text: separators and placeholders, runs of letters, of digits, and of other signs."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def text_pieces(text: Column | str) -> Column:
    """``pieces(words(text))`` in one pass: a run of letters, digits or signs is matched piece by piece."""
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def word_pieces(word: Column) -> Column:
    """The word cut into pieces of ``PIECE_CHARS`` characters."""
    last = F.floor((F.length(word) - 1) / PIECE_CHARS).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(word, i * PIECE_CHARS + 1, F.lit(PIECE_CHARS)),
    )
    return F.when(F.length(word) <= PIECE_CHARS, F.array(word)).otherwise(cut)


def pieces(word_list: Column | str) -> Column:
    """All pieces of a list of words, in order."""
    return F.flatten(F.transform(word_list, word_pieces))


def piece_words(word_list: Column | str) -> Column:
    """For every piece the index of its word; a separator at index i gives ``-i - 1``."""

    def numbered(word, i):
        n_pieces = F.floor((F.length(word) + (PIECE_CHARS - 1)) / PIECE_CHARS).cast("int")
        return F.array_repeat(F.when(word.isin(*SEPARATOR_WORDS), -i - 1).otherwise(i), n_pieces)

    return F.flatten(F.transform(word_list, numbered))
