"""Token ids in 64-bit words: Simple-8b files with block offsets, written and read by tasks.

A word holds a 4-bit selector and up to 60 bits of ids; the selector says how many ids of which width follow. An id
wider than 60 bits is escaped: a word with selector 0, then the id in a word of its own. Ids are grouped into blocks
of ``BLOCK`` ids that start a new word, so blocks decode independently and side by side.

A file is ``MAGIC``, the words of all blocks, then as little-endian arrays the words per block (u4), the doc ids (i8),
whether a doc id is present (u1) and the tokens per document (u8), and last ``(blocks, documents, ids)`` (u8) and
``MAGIC``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penstroke.llm import tokenization as K
from penstroke.llm.storage import filesystem
from penstroke.staging import fresh_path, stage

MAGIC = b"S8BTOKEN"
# Ids per word and bits per id of the selectors 1 to 15; selector 0 escapes.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120])
WIDTHS = np.array([64, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])

BLOCK = 1024
FILE_IDS = 16 << 20
"""Ids after which a task starts its next file."""

READ_BLOCKS = 1024
"""Blocks decoded at a time."""


_SMALL = np.frexp(np.arange(1 << 16).astype(np.float64))[1].astype(np.int8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    if ids.size and int(ids.max()) < 1 << 16:
        return _SMALL[ids.astype(np.uint16)]
    if ids.size and int(ids.max()) < 1 << 32:
        return np.frexp(ids.astype(np.float64))[1].astype(np.int8)  # exact below 2**53
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low).astype(np.int8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, words per block)`` of a flat array of unsigned ids.

    Every word takes as many ids as fit. All blocks advance together: one step finds the next word of each.
    """
    if len(ids) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    blocks = -(-len(ids) // BLOCK)
    row = BLOCK + int(COUNTS.max())  # zeros behind every block, so that a last word may be part empty

    def laid_out(values: np.ndarray, kind) -> np.ndarray:
        padded, whole = np.zeros((blocks, row), kind), len(ids) // BLOCK
        padded[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
        padded[whole:, : len(ids) - whole * BLOCK] = values[whole * BLOCK :]
        return padded.ravel()

    flat, width = laid_out(ids, np.uint64), laid_out(_bit_lengths(ids), np.int8)
    best = np.zeros(len(flat), np.int8)  # selector 0 until something fits
    reach, spans = width, 1
    for selector in range(1, 16):
        n = int(COUNTS[selector])
        while spans < n:
            step = min(spans, n - spans)
            wider = reach.copy()
            np.maximum(wider[:-step], reach[step:], out=wider[:-step])
            reach, spans = wider, spans + step
        np.maximum(best, (reach <= WIDTHS[selector]).view(np.int8) * np.int8(selector), out=best)
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = len(ids) - BLOCK * (blocks - 1)
    base = np.arange(blocks) * row
    at, active = base.copy(), np.arange(blocks)
    starts = []
    while len(active):
        here = at[active]
        starts.append(here)
        at[active] = here + COUNTS[best[here]]
        active = active[at[active] < base[active] + lengths[active]]
    start = np.sort(np.concatenate(starts))
    selector = best[start].astype(np.int64)
    slots = 1 + (selector == 0)
    out = np.cumsum(slots) - slots
    words = np.empty(int(slots.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        mine = selector == s
        if s == 0:
            words[out[mine]], words[out[mine] + 1] = 0, flat[start[mine]]
            continue
        at = start[mine]
        word = np.full(len(at), s << 60, np.uint64)
        if WIDTHS[s]:
            for k in range(int(COUNTS[s])):
                word |= flat[at + k] << np.uint64(k * WIDTHS[s])
        words[out[mine]] = word
    return words, np.bincount(start // row, slots, blocks).astype(np.uint32)


def unpack(words: np.ndarray, per_block: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole blocks; the inverse of ``pack``."""
    if n == 0:
        return np.empty(0, np.uint64)
    blocks, row = len(per_block), BLOCK + int(COUNTS.max())
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():  # the word after an escape is an id, whatever its top bits are
        for i in np.flatnonzero(selector == 0).tolist():
            if not raw[i]:
                raw[i + 1] = True
    counts = np.where(raw, 0, COUNTS[selector])
    ends = np.cumsum(counts)
    last = np.cumsum(per_block.astype(np.int64))
    before = np.concatenate([[0], ends])
    block_base = np.repeat(before[last - per_block], per_block.astype(np.int64))
    start = ends - counts - block_base + np.repeat(np.arange(blocks) * row, per_block.astype(np.int64))
    out = np.zeros(blocks * row, np.uint64)
    kinds = np.where(raw, -1, selector)
    for s in np.unique(kinds).tolist():
        if s < 0 or (s and not WIDTHS[s]):
            continue
        mine = np.flatnonzero(kinds == s)
        if s == 0:
            out[start[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[start[mine] + k] = (words[mine] >> np.uint64(k * WIDTHS[s])) & mask
    return out.reshape(blocks, row)[:, :BLOCK].ravel()[:n]


class _File:
    """One file being written; ids come in any portions."""

    def __init__(self, stream) -> None:
        self.stream, self.ids, self.waiting, self.held = stream, 0, [], 0
        self.per_block, self.docs, self.counts = [], [], []
        stream.write(MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs += doc_ids
        self.counts.append(counts)
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK * READ_BLOCKS:
            self._flush(self.held - self.held % BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        words, per_block = pack(ids[:n])
        self.stream.write(words.astype("<u8", copy=False).tobytes())
        self.per_block.append(per_block)
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        self._flush(self.held)
        per_block = np.concatenate(self.per_block).astype("<u4")
        self.stream.write(per_block.tobytes())
        self.stream.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.stream.write(np.array([d is not None for d in self.docs], "u1").tobytes())
        self.stream.write(np.concatenate([np.empty(0, np.int64), *self.counts]).astype("<u8").tobytes())
        self.stream.write(np.array([len(per_block), len(self.docs), self.ids], "<u8").tobytes() + MAGIC)
        self.stream.close()
        return len(self.docs), self.ids


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``text``, append ``end_id`` to every document and write the ids in ascending ``id_column`` order.

    Returns the manifest, one row per file ``(part, file, path, n_docs, n_ids)``, stored; a file not in it, left by a
    lost attempt, is not part of the result. Texts are range-partitioned by id, once; a task holds one slice of text
    and the ids of a few blocks. A missing text is empty, so it has the end id only. Rows without an id come first;
    rows of one id are ordered by text, and each is a document of its own. An empty table gives an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = filesystem(folder)
        encoder, done, now = K.encoder(tokenizer), [], None

        def finish(now):
            path, file = now
            n_docs, n_ids = file.close()
            done.append((part, len(done), path, n_docs, n_ids))

        for batch in batches:
            texts = batch.column(1)
            for a, b in K.slices(texts):
                ids, counts = encoder.encode(texts.slice(a, b - a))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                if now is None:
                    path = f"part-{part:05d}-{len(done):04d}-{attempt}.s8b"
                    fs.create_dir(root, recursive=True)
                    now = path, _File(fs.open_output_stream(f"{root}/{path}"))
                now[1].add(batch.column(0).slice(a, b - a).to_pylist(), ids, counts + 1)
                if now[1].ids >= FILE_IDS:
                    now = finish(now)
        if now is not None:
            finish(now)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "path", "n_docs", "n_ids"])

    ordered = docs.select(F.col(id_column).cast("long"), F.col(text)).repartitionByRange(F.col(id_column).asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col(id_column).asc_nulls_first(), text)
    return stage(ordered.mapInArrow(write, "part long, file long, path string, n_docs long, n_ids long"), "token-manifest")


def _read_array(stream, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(stream.read(n * np.dtype(kind).itemsize), kind)


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (unsigned
    32-bit little-endian bytes).

    ``start`` counts the ids of all documents before. The window runs over one row per file. A task decodes
    ``READ_BLOCKS`` blocks at a time; only with ``with_ids`` it holds the ids of a whole document.
    """
    base = F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(base, F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for path, first in ((p, b) for batch in batches for p, b in zip(*(c.to_pylist() for c in batch.columns))):
            with fs.open_input_file(f"{root}/{path}") as f:
                yield from _documents(f, first, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, schema)  # a file is the work of a task, however small its row


def _documents(f, first: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    size = f.size()
    f.seek(size - 32)
    n_blocks, n_docs, n_ids = _read_array(f, "<u8", 3).astype(np.int64).tolist()
    f.seek(size - 32 - n_docs * 17 - n_blocks * 4)
    per_block = _read_array(f, "<u4", n_blocks)
    doc_ids, present, counts = (_read_array(f, kind, n_docs) for kind in ("<i8", "u1", "<u8"))
    ends = np.cumsum(counts.astype(np.int64))
    offsets = len(MAGIC) + 8 * np.concatenate([[0], np.cumsum(per_block.astype(np.int64))])
    crc, kept, doc, rows = 0, [], 0, []
    for b in range(0, n_blocks, READ_BLOCKS):
        e = min(b + READ_BLOCKS, n_blocks)
        f.seek(int(offsets[b]))
        words = _read_array(f, "<u8", int(offsets[e] - offsets[b]) // 8)
        low, high = b * BLOCK, min(e * BLOCK, n_ids)
        data = unpack(words, per_block[b:e], high - low).astype("<u4").tobytes()
        at = low
        while doc < n_docs and at < high:
            to = min(int(ends[doc]), high)
            part = data[4 * (at - low) : 4 * (to - low)]
            crc, at = zlib.crc32(part, crc), to
            if with_ids:
                kept.append(part)
            if to == ends[doc]:
                rows.append((crc, b"".join(kept)) if with_ids else (crc,))
                crc, kept, doc = 0, [], doc + 1
        if rows:
            a = doc - len(rows)
            n = counts[a:doc].astype(np.int64)
            columns = [pa.array(doc_ids[a:doc], mask=present[a:doc] == 0), pa.array(first + ends[a:doc] - n), pa.array(n)]
            columns += [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
            rows = []


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, **columns: str) -> DataFrame:
    """Write the files under the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id, **columns), folder)
