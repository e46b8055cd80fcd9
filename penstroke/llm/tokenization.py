"""Whole texts to token ids with a tokenizer file, each distinct word of a batch encoded once."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 1_000_000
"""Words whose ids a task remembers; past this many it starts anew. Results don't depend on it."""

SLICE_BYTES = 8 << 20
"""Text encoded at a time, which bounds the arrays of a task."""

_BLANK = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_INNER_BLANK = f"\\x00|[{_BLANK}] ([{_BLANK}]|$)"
_LINE_END = r"([^\PL\x{130}]|[\pN.,;:!?])\n(\pL)"
_WORD_END = r"([^\PL\x{130}])([.,])"  # the small form of U+0130 ends in a mark, which is no letter
_RUN_START = re.compile(r"(?<=\S)(?= )")


def _byte_symbols() -> dict[int, int]:
    """The character that stands for each byte: itself if it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in prints)}


_BYTES = _byte_symbols()


def _form(settings: dict) -> str | None:
    """``byte`` or ``word`` for the two kinds of tokenizer whose texts may be cut, else ``None``."""
    normalizer, before = settings["normalizer"] or {}, settings["pre_tokenizer"] or {}
    if not normalizer and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
        return "byte"
    kinds = [[x["type"] for x in settings_.get(name, [])] for settings_, name in ((normalizer, "normalizers"), (before, "pretokenizers"))]
    return "word" if kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] else None


class TextEncoder:
    """Ids and character spans of whole texts, equal to encoding each text in one piece.

    A text is cut where no token of the vocabularies used here can reach over the cut: before a space, between a
    letter and a full stop or comma, and around a single line end. Every distinct piece goes through the tokenizer
    once. Texts with runs of several blanks are cut at the start of a run only. A text that holds an added token of the
    vocabulary, such as ``<|endoftext|>``, goes to the tokenizer whole, as do all texts with a tokenizer of another kind.
    """

    def __init__(self, path: str, spans: bool = False, cached_words: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.spans, self.form = spans, _form(settings)
        # Added tokens are found in the text before it is cut, some of them in its normalized form.
        added = [t["content"] for t in settings.get("added_tokens") or [] if t["content"]]
        self.added = "(?i)" + "|".join(re.escape(t).replace("\\ ", " ") for t in added) if added else None
        self.sign = re.match(r"[^\w\s]*", os.path.commonprefix(added))[0]  # what every added token begins with
        self.cached_words = cached_words
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 0
        self.flat = np.empty((1 << 16, 3 if self.spans else 1), np.uint32)
        self.start, self.length, self.chars = (np.empty(0, np.int64) for _ in range(3))

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 8192):
            part = pieces[at : at + 8192]
            if self.spans:
                coded = self.tokenizer.encode_batch(part, add_special_tokens=False)
                ids = [c.ids for c in coded]
            else:
                ids = self._ids(part)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(lengths.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            rows = self.flat[self.used : self.used + total]
            rows[:, 0] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            if self.spans and total:
                rows[:, 1:] = np.array([x for c in coded for x in c.offsets], np.uint32)
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
            self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.chars = np.concatenate([self.chars, np.fromiter(map(len, part), np.int64, len(part))])
            self.used += total

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces; a word of Latin letters is one unit for the tokenizer and goes to its model directly."""
        out, others, model = [], [], self.tokenizer.model.tokenize
        byte = self.form == "byte"
        for piece in pieces:
            word = piece[1:] if piece[:1] == " " else piece
            if not byte:
                word = word.lower()
            if self.form and word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                unit = piece if byte else word
                unit = unit.replace(" ", "\u0120") if unit.isascii() else unit.encode().decode("latin-1").translate(_BYTES)
                out.append([t.id for t in model(unit)])
            else:
                out.append(None)
                others.append(piece)
        rest = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        return [next(rest).ids if ids is None else ids for ids in out]

    def _index(self, pieces: list[str]) -> np.ndarray:
        found = list(map(self.known.get, pieces))
        new = [p for p, at in zip(pieces, found) if at is None]
        if new:
            if len(self.known) + len(new) > self.cached_words:
                self._reset()
                new = pieces
            self._learn(new)
            found = list(map(self.known.get, pieces))
        return np.array(found, np.int64)

    def _with_added(self, texts: pa.Array) -> pa.Array:
        """Which texts hold an added token; the sign that all of them begin with is looked for first."""
        none = pa.array(np.zeros(len(texts), bool))
        if not self.added:
            return none
        near = pc.match_substring(texts, self.sign)
        return pc.match_substring_regex(pc.if_else(near, texts, ""), self.added) if pc.any(near).as_py() else none

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and how many each text has."""
        if self.form is None:
            return self._index(texts.to_pylist()), np.ones(len(texts), np.int64)
        odd = pc.match_substring_regex(texts, _INNER_BLANK)
        whole = self._with_added(texts)
        odd = pc.or_(odd, whole)
        marked = pc.replace_substring_regex(pc.if_else(odd, "", texts), _LINE_END, "\\1\0\n\0\\2")
        marked = pc.replace_substring_regex(marked, _WORD_END, "\\1\0\\2")
        marked = pc.replace_substring(marked, " ", "\0 ")
        lists = pc.split_pattern(marked, "\0")
        if pc.any(odd).as_py():
            whole = whole.to_pylist()
            cut = [([t] if w else _RUN_START.split(t)) if o else p for t, o, w, p in zip(texts.to_pylist(), odd.to_pylist(), whole, lists.to_pylist())]
            lists = pa.array(cut, lists.type)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        return self._index(coded.dictionary.to_pylist())[coded.indices.to_numpy()], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(tokens, counts)``: ids of all texts one after another (with spans: rows of id, first and last character
        bound in the text), and the number of each text. A null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(texts) == 0:
            return self.flat[:0] if self.spans else self.flat[:0, 0], np.empty(0, np.int64)
        at, counts = self._pieces(texts)
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.start[at] - (ends - lengths), lengths)
        bounds = np.cumsum(counts)
        before = np.concatenate([[0], ends])
        per_text = before[bounds] - before[bounds - counts]
        if not self.spans:
            return self.flat[:, 0][take], per_text
        chars = self.chars[at]
        moved = np.cumsum(chars) - chars
        moved -= np.repeat(moved[bounds - counts], counts)
        tokens = self.flat[take].astype(np.int64)
        tokens[:, 1:] += np.repeat(moved, lengths)[:, None]
        return tokens, per_text


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    """Ranges of rows with about ``size`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // size
    edges = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *edges.tolist(), len(texts)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]


_ENCODERS: dict[tuple[str, bool, int], TextEncoder] = {}


def encoder(path: str, spans: bool = False, cached_words: int = CACHED_WORDS) -> TextEncoder:
    """One encoder per worker process, so that later tasks find its words."""
    key = (path, spans, cached_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(*key)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
