"""Token counts of the sections of a document, from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstroke.llm import tokenization as K

RULES = ("first", "largest", "each")
OUTSIDE = -1
_NAMES = ("doc_id", "section", "first_char", "n_chars", "n_tokens", "n_crossing", "doc_tokens")


def lines(text: str) -> np.ndarray:
    """Bounds of the lines of a text, without their line ends; a last empty line counts, an empty text has none."""
    if not text:
        return np.empty((0, 2), np.int64)
    lengths = np.fromiter(map(len, text.split("\n")), np.int64)
    start = np.cumsum(lengths + 1) - lengths - 1
    return np.stack([start, start + lengths], 1)


def section_bounds(listed: list[dict | None] | None) -> np.ndarray:
    """Bounds of given sections; one with a missing bound is empty and lies where the one before ends."""
    out, at = [], 0
    for section in listed or []:
        start, end = (section or {}).get("start"), (section or {}).get("end")
        if start is None or end is None:
            start = end = at
        if start < at or end < start:
            raise ValueError(f"sections must be sorted and must not overlap: {start} to {end} after {at}")
        out.append((start, end))
        at = end
    return np.array(out, np.int64).reshape(-1, 2)


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """``(tokens, crossing tokens)`` per section, and the tokens in none.

    ``tokens`` and ``sections`` are sorted, non-overlapping character spans. A token crosses if it reaches into
    several sections: ``first`` gives it to the one it starts in or reaches first, ``largest`` to the one with most of
    its characters (the earlier of equals), ``each`` to every one, so that the counts of sections may exceed those of
    the document.
    """
    n = len(sections)
    counts, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 0 or len(tokens) == 0:
        return counts, crossing, len(tokens)
    start, end = tokens[:, 0], np.maximum(tokens[:, 1], tokens[:, 0] + 1)
    first = np.searchsorted(sections[:, 1], start, "right")
    # An empty section holds no character; among sections that start together only the last can hold one.
    last = np.searchsorted(sections[:, 0], end, "left")
    own = np.where(last > first, first, n)
    several = np.flatnonzero(last - first > 1)
    for i in several.tolist():
        span = sections[first[i] : last[i]]
        overlap = np.minimum(span[:, 1], end[i]) - np.maximum(span[:, 0], start[i])
        touched = first[i] + np.flatnonzero(overlap > 0)
        own[i] = n if len(touched) == 0 else touched[0] if rule != "largest" else first[i] + int(np.argmax(overlap))
        if len(touched) > 1:
            crossing[touched] += 1
            if rule == "each":
                counts[touched[1:]] += 1
    single = np.flatnonzero(last - first == 1)
    at = own[single]
    held = np.minimum(sections[at, 1], end[single]) > np.maximum(sections[at, 0], start[single])
    own[single[~held]] = n
    counts += np.bincount(own, minlength=n + 1)[:n]
    return counts, crossing, int((own == n).sum())


def section_token_counts(docs: DataFrame, tokenizer: str, sections: str | None = None, rule: str = "first", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every section: ``doc_id, section, first_char, n_chars, n_tokens, n_crossing, doc_tokens``.

    Each text is encoded once and whole; the character spans of its tokens are joined with those of its sections
    inside the task, without a shuffle. ``sections`` names a column of ``array<struct<start, end>>``, sorted and not
    overlapping, in characters; without it sections are the lines. Every document also has a row ``section = -1`` for
    tokens in no section, such as line ends, so the rows of a document add up to ``doc_tokens`` (with the rule
    ``each``, to that plus the crossings). A missing or empty text has that row only; repeated rows are documents of
    their own; null sections are none, a section with a missing bound is empty, and unsorted or overlapping ones are an error.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = K.encoder(tokenizer, True)
        for rows in batches:
            texts = rows.column(1)
            for a, b in K.slices(texts):
                part = texts.slice(a, b - a)
                tokens, counts = encoder.encode(part)
                given = rows.column(2).slice(a, b - a).to_pylist() if sections else None
                out, at = [], 0
                for i, (doc, value, n) in enumerate(zip(rows.column(0).slice(a, b - a).to_pylist(), part.to_pylist(), counts.tolist())):
                    spans = lines(value or "") if given is None else section_bounds(given[i])
                    own, crossing, outside = attribute(tokens[at : at + n, 1:], spans, rule)
                    at += n
                    k = len(spans)
                    columns = np.zeros((k + 1, len(_NAMES) - 1), np.int64)
                    columns[:, 0] = np.arange(-1, k)
                    columns[1:, 1], columns[1:, 2] = spans[:, 0], spans[:, 1] - spans[:, 0]
                    columns[1:, 3], columns[1:, 4], columns[0, 3], columns[:, 5] = own, crossing, outside, n
                    out.append((doc, columns))
                if out:
                    ids = [d for d, c in out for _ in range(len(c))]
                    table = np.concatenate([c for _, c in out])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(table[:, j]) for j in range(table.shape[1]))], names=list(_NAMES))

    columns = [F.col(id_column).cast("long"), F.col(text), *([F.col(sections)] if sections else [])]
    return docs.select(*columns).mapInArrow(run, ", ".join(f"{n} long" for n in _NAMES))
