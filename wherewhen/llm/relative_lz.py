"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed into factors: runs of words that stand earlier in the
corpus (in a smaller doc_id, or further up in the same document). The reference
is the corpus itself, cut into blocks by content: of any 20 words in a row the
six-word gram with the least hash, leftmost, is the anchor, and a block is an
anchor with all windows of 20 words that chose it. Equal windows choose equal
anchors, so a window can only match in blocks of its own anchor. The index holds
each block once, with its first place.

1. A block that stands earlier as a whole is a factor, extended over the blocks
   that follow as long as the source goes on likewise. Within a batch of texts
   this is settled before anything is shuffled.
2. Where a passage begins or ends, blocks share their anchor but not all their
   words. These are the borders of factors: their windows are looked up one by
   one, against the windows of all other blocks of the anchor.
3. A document is covered by the factors found; words under one are duplicate.

Blocks are told apart by 128 bits of hash, windows by 128 bits. No key is
crowded: a block or window is sent once a batch, and an anchor with many blocks
in a batch is not grouped but has its windows looked up. Texts move once, to
meet what was found of them.

Defined results: a null text has no words. A null doc_id counts as the smallest
number. Rows that repeat an id and a text are one document and share its result;
different texts of one id stand in order of a 64-bit hash. Texts of less than a
window are kept whole. A document is parsed in one piece, so memory is that of
the longest one and a batch of some million words. Columns other than doc_id and
text are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .circulant import WordNames
from .common import partitions, stored

_U64 = np.uint64
FIRST_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
NO_ID = -(1 << 63)
BLOCK, CROWDED, MARK, FACTOR = range(4)


@dataclass(frozen=True)
class Parsing:
    """``window`` words in a row make a duplicate; ``anchor`` words of them index it.

    Texts of ``batch_words`` words are searched together before the shuffle. An
    anchor with ``crowd`` blocks among them is not grouped by itself.
    """

    window: int = 20
    anchor: int = 6
    batch_words: int = 2_000_000
    crowd: int = 16


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(29))


def rolled(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of every ``n`` codes in a row."""
    out = np.zeros(max(len(codes) - n + 1, 0), _U64)
    for j in range(n):
        out = out * _U64(base) + codes[j : j + len(out)]
    return mixed(out)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of codes, from running sums; equal spans have equal ones wherever they stand."""
    inverse = pow(SECOND_BASE, -1, 1 << 64)
    powers, back = np.full(len(codes) + 1, SECOND_BASE, _U64), np.full(len(codes) + 1, inverse, _U64)
    powers[0] = back[0] = 1
    sums = np.zeros(len(codes) + 1, _U64)
    np.cumsum(codes * np.cumprod(powers)[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * np.cumprod(back)[starts])


def document_blocks(codes: np.ndarray, lengths: np.ndarray, method: Parsing) -> tuple[np.ndarray, ...]:
    """anchor, block, start, count of the blocks of documents laid end to end; starts count from the first document's first word."""
    size, wide = method.window, method.window - method.anchor + 1
    number = np.repeat(np.arange(len(lengths)), lengths)
    if len(codes) < size:
        return tuple(np.zeros(0, t) for t in (_U64, _U64, np.int64, np.int64))
    grams = rolled(codes, method.anchor, FIRST_BASE)
    chosen = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(len(codes) - size + 1)
    whole = np.flatnonzero(number[: len(codes) - size + 1] == number[size - 1 :])  # windows within a document
    chosen = chosen[whole]
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else np.zeros(0, np.int64)
    start, count = whole[new], np.diff(np.append(new, len(chosen)))
    at = chosen[new]
    shape = (count * size + (at - start)).astype(_U64) * _U64(FIRST_BASE)
    block = mixed(span_hashes(codes, start, start + count - 1 + size) + shape) | _U64(1)
    return grams[at], block, start, count


def text_batches(batches: Iterator[pa.RecordBatch], method: Parsing) -> Iterator[tuple]:
    """A batch, the index of some rows in order of id and tag, and their words' codes; ``batch_words`` at a time."""
    names = WordNames()
    for batch in batches:
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
        texts, rows, codes, size = batch.column("text").cast(pa.binary()), [], [], 0
        for i in np.lexsort((tags, ids)):
            words = (texts[int(i)].as_py() or b"").split()
            rows.append(i)
            codes.append(np.fromiter(map(names.__getitem__, words), _U64, len(words)))
            size += len(words)
            if size >= method.batch_words:
                yield batch, np.array(rows), codes
                rows, codes, size = [], [], 0
        if rows:
            yield batch, np.array(rows), codes


def chained(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, count: np.ndarray, source: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Factors, in order of place, extended over those that follow on with a source that follows on."""
    if not len(ids):
        return [ids, tags, start, count, source, at]
    follows = (ids[1:] == ids[:-1]) & (tags[1:] == tags[:-1]) & (start[1:] == start[:-1] + count[:-1])
    follows &= (source[1:] == source[:-1]) & (at[1:] == at[:-1] + count[:-1])
    heads = np.flatnonzero(np.concatenate([[True], ~follows]))
    return [ids[heads], tags[heads], start[heads], np.add.reduceat(count, heads), source[heads], at[heads]]


ROWS = "kind int, high long, low long, id long, tag long, start long, count long, source long, source_start long"
ROW = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("high", "low", "id", "tag", "start", "count", "source", "source_start")]])


def laid_out(kind: int, high, low, ids, tags, start, count, source=None, at=None) -> pa.RecordBatch:
    n = len(ids)
    longs = [pa.array(np.asarray(x).view(np.int64) if x is not None else pa.nulls(n, pa.int64()), pa.int64()) for x in (high, low, ids, tags, start, count, source, at)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *longs], schema=ROW)


def first_of_each(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of place: whether a row is the first of its key, and the index of that first row."""
    order = np.lexsort((low, high))  # stable
    new = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]) if len(order) else np.zeros(0, bool)
    heads = np.empty(len(order), np.int64)
    heads[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else 0
    return heads == np.arange(len(order)), heads


def settled(high, low, ids, tags, start, count) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows of a batch, in order of place, are sent on, and the factors of those that have their source in the batch."""
    first, heads = first_of_each(high, low)
    again = ~first & ((ids != ids[heads]) | (tags != tags[heads]) | (start != start[heads]))  # not a repeated row
    source = heads[again]
    return first, chained(ids[again], tags[again], start[again], count[again], ids[source], start[source])


def factor_rows(factors: list[np.ndarray]) -> pa.RecordBatch:
    ids, tags, start, *_ = factors
    spread = mixed(ids.view(_U64) * _U64(FIRST_BASE) + tags.view(_U64) + start.view(_U64))  # passed on, so any task will do
    return laid_out(FACTOR, spread, np.zeros(len(ids), np.int64), *factors)


def index_rows(texts: DataFrame, method: Parsing) -> DataFrame:
    """Blocks to look up, and the factors that a batch finds in itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, codes in text_batches(batches, method):
            lengths = np.array([len(c) for c in codes], np.int64)
            anchor, block, start, count = document_blocks(np.concatenate(codes), lengths, method)
            ends = np.cumsum(lengths)
            doc = np.searchsorted(ends, start, side="right")
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[rows][doc] for c in ("id", "tag"))
            start = start - (ends - lengths)[doc]
            first, factors = settled(anchor, block, ids, tags, start, count)
            yield factor_rows(factors)
            anchor, block, ids, tags, start, count = (x[first] for x in (anchor, block, ids, tags, start, count))
            kinds, back, many = np.unique(anchor, return_inverse=True, return_counts=True)
            crowded = many[back] >= method.crowd
            yield laid_out(BLOCK, *(x[~crowded] for x in (anchor, block, ids, tags, start, count)))
            yield laid_out(CROWDED, *(x[crowded] for x in (anchor, block, ids, tags, start, count)))
            marks = kinds[many >= method.crowd]
            none = np.zeros(len(marks), np.int64)
            yield laid_out(MARK, marks, none, none, none, none, none)

    return texts.select(ident().alias("id"), "tag", "text").mapInArrow(run, ROWS)


def looked_up(rows: DataFrame, key: Column, borders: bool) -> DataFrame:
    """Factors of all rows whose (high, low) stands at an earlier place, those passed on, and with ``borders`` the blocks to open.

    A block is opened if its anchor has another block, or is crowded. Rows come
    sorted, so a task keeps two of them from batch to batch.
    """
    order = ["high", "low", "id", "tag", "start"]
    ordered = rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, open_before = None, np.zeros(0, bool)  # rows of the last anchor, and whether they were opened
        for batch in batches:
            passed = batch.column("kind").to_numpy() == FACTOR
            if passed.any():
                yield batch.filter(pa.array(passed))
                batch = batch.filter(pa.array(~passed))
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*([kept] if kept is not None else []), batch]).combine_chunks()
            n, old = table.num_rows, len(open_before)
            kind, high, low, ids, tags, start, count = (table.column(c).to_numpy() for c in ROW.names[:7])
            place = np.arange(n)
            new_high = np.concatenate([[True], high[1:] != high[:-1]])
            new = new_high | np.concatenate([[True], low[1:] != low[:-1]])
            head = np.maximum.accumulate(np.where(new, place, 0))
            again = ~new & (place >= old) & ((ids != ids[head]) | (tags != tags[head]) | (start != start[head]))
            source = head[again]
            found = [ids[again], tags[again], start[again], count[again], ids[source], start[source]]
            yield laid_out(FACTOR, found[0], found[1], *found)
            opened = np.concatenate([open_before, np.zeros(n - old, bool)])
            last = np.flatnonzero(new_high)[-1]
            if borders:
                group = np.cumsum(new_high) - 1
                several = np.bincount(group, weights=new)[group] > 1
                now = new & ~opened & (kind != MARK) & (several | (kind == CROWDED))
                yield table.filter(pa.array(now)).combine_chunks().to_batches(max_chunksize=n)[0] if now.any() else laid_out(BLOCK, *[found[0][:0]] * 6)
                opened |= now
            keep = np.unique([last, head[-1]])
            kept, open_before = table.take(pa.array(keep)).combine_chunks().to_batches()[0], opened[keep]

    return ordered.mapInArrow(run, ROWS)


def window_rows(opened: DataFrame, method: Parsing) -> DataFrame:
    """The windows of the blocks listed beside a text, and the factors that a batch finds in itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, codes in text_batches(batches, method):
            lengths = np.array([len(c) for c in codes], np.int64)
            lists = batch.column("blocks").take(pa.array(rows))
            doc = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
            first, count = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "count"))
            doc, first = np.repeat(doc, count), np.repeat(first - np.cumsum(count) + count, count)
            start = first + np.arange(len(first))
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            text = np.concatenate(codes)
            at = start + (np.cumsum(lengths) - lengths)[doc]
            high, low = (rolled(text, method.window, b)[at] for b in (FIRST_BASE, SECOND_BASE))
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[rows][doc] for c in ("id", "tag"))
            one = np.ones(len(doc), np.int64)
            new, factors = settled(high, low, ids, tags, start, one)
            yield factor_rows(factors)
            yield laid_out(BLOCK, *(x[new] for x in (high, low, ids, tags, start, one)))

    return opened.select("id", "tag", "text", "blocks").mapInArrow(run, ROWS)


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text: ``tag`` tells different texts of one id apart, and is 0 where no id repeats."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    repeats = not docs.groupBy(ident().alias("id")).count().where("count > 1").isEmpty()
    tag = F.xxhash64(text) if repeats else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), text.alias("text"))


def ident() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def met(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts beside what was found of them. Both such joins of a parse have the same left side, so Spark moves the texts once."""
    right = found.withColumnRenamed("tag", "its_tag")
    return texts.join(right, (ident() == right["id"]) & (texts["tag"] == right["its_tag"]), how)


def found_factors(texts: DataFrame, method: Parsing) -> DataFrame:
    """id, tag, start, count (windows), source, source_start of every factor."""
    key = F.when(F.col("kind") == CROWDED, F.col("low")).otherwise(F.col("high"))
    blocks = stored(looked_up(index_rows(texts, method), key, borders=True), "lz-blocks")
    listed = blocks.where(F.col("kind") != FACTOR).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "count")).alias("blocks"))
    windows = looked_up(window_rows(met(texts, listed, "inner"), method), F.col("high"), borders=False)
    columns = ["id", "tag", "start", "count", "source", "source_start"]
    return blocks.where(F.col("kind") == FACTOR).select(*columns).unionByName(windows.select(*columns))


PARSED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, factors array<struct<start: long, n_words: long, source_id: long, source_start: long>>"


def parsed_documents(docs: DataFrame, method: Parsing | None = None, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: its words, those under a factor, digest of the rest; with ``texts`` the rest itself and the factors."""
    method = method or Parsing()
    keyed = with_keys(docs)
    factor = F.struct("start", "count", "source", "source_start")
    found = found_factors(keyed, method).groupBy("id", "tag").agg(F.collect_list(factor).alias("found"))
    part = pa.struct([(c, pa.int64()) for c in ("start", "n_words", "source_id", "source_start")])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()),
        ("factors", pa.list_(part)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            values = batch.column("text").cast(pa.binary())
            for i, found in enumerate(batch.column("found")):
                words, factors, removed = values[i].as_py().split(), [], 0
                kept, n = words, len(words)
                if found.is_valid:
                    start, count, source, at = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "count", "source", "source_start"))
                    order = np.argsort(start, kind="stable")
                    zero = np.zeros(len(start), np.int64)
                    _, _, start, count, source, at = chained(zero, zero, *(x[order] for x in (start, count, source, at)))
                    covered = np.zeros(n + 1, np.int64)
                    np.add.at(covered, start, 1)
                    np.add.at(covered, start + count - 1 + method.window, -1)
                    stays = np.cumsum(covered)[:-1] == 0
                    kept, removed = [words[j] for j in np.flatnonzero(stays)], int(n - stays.sum())
                    if texts:
                        factors = [
                            {"start": a, "n_words": c - 1 + method.window, "source_id": None if s == NO_ID else s, "source_start": b}
                            for a, c, s, b in zip(*(x.tolist() for x in (start, count, source, at)), strict=True)
                        ]
                rest = b" ".join(kept)
                rows.append((n, removed, hashlib.sha256(rest).hexdigest(), rest.decode() if texts else None, factors if texts else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema=schema)

    return met(keyed, found, "left").select("doc_id", "text", "found").mapInArrow(run, PARSED)
