"""Cross-tokenizer alignment with inverted pair bitmaps.

A text is encoded by two tokenizers; the byte offsets where tokens of both end
cut it into groups, and the two tokens that end there are linked. The index is
inverted: for each pair of ids, the documents in which it is linked, as bitmaps
over segments of up to 65,536 documents. The multiplicities of a pair are bit
planes: plane k holds the documents whose multiplicity has bit k. Bitmaps are
compressed as sorted 16-bit numbers or as bits, whichever is shorter.

Tasks write bitmaps of the documents they have seen, some million links at a
time. Those of one pair and segment are OR-merged; the OR of the planes has the
pair's documents, popcounts of the planes times 2^k its links. Counts are added
up per pair, and the postings then return them: every document on a pair's list
is given the pair's count, times its multiplicity, in the task of its segment.

A pair that every document has is a few bitmaps a segment, and pairs are merged
and joined by pair and segment or in joins that Spark can split, so none is
crowded. No link is ever a row.

Defined results: a text that is null or empty, or whose tokens' bytes do not
give back the space and text they encode, has no tokens: zeros and an empty
digest. Strings of special tokens inside texts are plain text. Rows that repeat
an id are documents of their own. A document is encoded whole, so memory is that
of the longest one and a buffer of some million links. Columns other than doc_id
and text are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_folder, stored

BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
# How the byte tokenizer cuts a text before merging (its file names this rule "ByteLevel").
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEGMENT = 1 << 16
# Documents from which on a bitmap is bits. So many sorted numbers would have the length of the bits, which is what tells the two forms apart.
DENSE = SEGMENT // 16


@dataclass(frozen=True)
class Index:
    """``links`` of a task are turned into bitmaps together; a segment has ``documents`` at most."""

    links: int = 4_000_000
    documents: int = SEGMENT


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Side:
    """What is known of one tokenizer's ids: bytes, lengths, and decimal digits with a mark behind."""

    def __init__(self, tokens: list[bytes], between: bytes, last: bytes):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.inner, self.final = (np.array([b"%d%b" % (i, m) for i in range(len(tokens))], "S8") for m in (between, last))

    def spans(self, ids: np.ndarray, data: bytes) -> np.ndarray | None:
        """Where tokens end, or None if their bytes are not ``data``."""
        ends = np.cumsum(self.lengths[ids])
        whole = len(ends) and ends[-1] == len(data) and b"".join(map(self.tokens.__getitem__, ids.tolist())) == data
        return ends if whole else None


class ByteSide(Side):
    """A byte-level BPE from its JSON text.

    Texts of letters below U+0300 are merged by rank, which is the faster way to
    the same ids; other texts go to the tokenizer of the file itself, whose
    classes of letters may be those of another Unicode version, and so do texts
    with long runs of blanks.
    """

    def __init__(self, data: str):
        import tiktoken
        from tokenizers import Tokenizer

        file = json.loads(data)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        names = {v: k for k, v in (file["model"]["vocab"] | special).items()}
        tokens = [names[i].encode() if names[i] in special else bytes(map(letters.__getitem__, names[i])) for i in range(len(names))]
        super().__init__(tokens, b",", b"|")
        ranks = {t: i for i, t in enumerate(tokens) if names[i] not in special}
        self.ranked = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.own = Tokenizer.from_str(data)
        self.own.encode_special_tokens = True

    def encode(self, text: str) -> np.ndarray:
        # The ranked encoder's pattern runs out of stack in a million blanks.
        if not re.search(r"[^\0-˿]|\s{1000}", text):
            return np.array(self.ranked.encode_ordinary(text), np.int64)
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.int64)


class PieceSide(Side):
    """A sentence-piece model with byte fallback, which writes a space in front."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        raw = [bytes.fromhex(p[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        super().__init__(raw, b",", b";")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


@lru_cache(1)
def byte_side(data: str) -> ByteSide:
    """Kept by a Python worker for its next task."""
    return ByteSide(data)


@lru_cache(1)
def piece_side(data: bytes) -> PieceSide:
    return PieceSide(data)


def group_digest(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``; ``last_*`` index the last token of each group."""
    text_a, text_b = a.inner[ids_a], b.inner[ids_b]
    text_a[last_a], text_b[last_b] = a.final[ids_a[last_a]], b.final[ids_b[last_b]]
    place_a, place_b = np.arange(len(ids_a)), np.arange(len(ids_b))
    before = np.concatenate([[0], last_b[:-1] + 1])  # tokens of b in front of each group
    out = np.empty(len(ids_a) + len(ids_b), text_a.dtype)
    out[place_a + before[np.searchsorted(last_a, place_a)]] = text_a
    out[place_b + last_a[np.searchsorted(last_b, place_b)] + 1] = text_b
    return hashlib.sha256(out.tobytes().translate(None, b"\0")[:-1]).hexdigest()


def containers(number: np.ndarray, docs: np.ndarray) -> pa.Array:
    """Bitmaps, for rows in order of ``number`` (0, 1, ... of the bitmap) and document."""
    counts = np.bincount(number)
    starts = np.cumsum(counts) - counts
    dense = np.flatnonzero(counts >= DENSE)
    if not len(dense):
        offsets = (2 * np.append(starts, len(docs))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(docs.astype("<u2"))])
    short = docs.astype("<u2")
    return pa.array([bits(short[s : s + n]) if n >= DENSE else short[s : s + n].tobytes() for s, n in zip(starts, counts, strict=True)], pa.binary())


def bits(docs: np.ndarray) -> bytes:
    flags = np.zeros(SEGMENT, np.uint8)
    flags[docs] = 1
    return np.packbits(flags).tobytes()


def listed(container: bytes) -> np.ndarray:
    """The documents of a bitmap, in order."""
    if len(container) == SEGMENT // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8)))
    return np.frombuffer(container, "<u2").astype(np.int64)


def merged(bitmaps: list[bytes]) -> bytes:
    """The OR of bitmaps."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    flags = np.zeros(SEGMENT, np.uint8)
    for each in bitmaps:
        flags[listed(each)] = 1
    docs = np.flatnonzero(flags)
    return np.packbits(flags).tobytes() if len(docs) >= DENSE else docs.astype("<u2").tobytes()


def popcount(container: bytes) -> int:
    if len(container) == SEGMENT // 8:
        return int(np.bitwise_count(np.frombuffer(container, np.uint64)).sum())
    return len(container) // 2


FIELDS = [
    ("kind", pa.int32()), ("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()),
    ("plane", pa.int32()), ("docs", pa.binary()),
]
SCHEMA = pa.schema(FIELDS)
DDL = (
    "kind int, segment long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "a int, b int, plane int, docs binary"
)
DOCUMENT, POSTING = 0, 1


def laid_out(kind: int, n: int, columns: dict) -> pa.RecordBatch:
    arrays = [pa.array(np.full(n, kind, np.int32))]
    for name, of in FIELDS[1:]:
        value = columns.get(name)
        arrays.append(pa.nulls(n, of) if value is None else value if isinstance(value, pa.Array) else pa.array(value, of))
    return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


def encoded(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, index: Index) -> tuple[DataFrame, DataFrame]:
    """Documents (segment, place, counts, digest) and postings (segment, a, b, plane, docs), written to the shared folder."""
    spark = docs.sparkSession
    with open(byte_tokenizer, encoding="utf-8") as a, open(piece_tokenizer, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))  # of the size of vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(files.value[0]), piece_side(files.value[1])
        ids_of_b = len(b.tokens)  # pairs are numbered a * ids_of_b + b, which leaves room for the place in a long
        segment, place, pairs, places, links = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def postings() -> pa.RecordBatch:
            pair, where = np.concatenate(pairs), np.concatenate(places)
            code, many = np.unique(pair * SEGMENT + where, return_counts=True)  # in order of pair and document
            parts = []
            for plane in range(int(many.max(initial=0)).bit_length()):
                there = code[(many >> plane & 1) == 1]
                of, number = np.unique(there // SEGMENT, return_inverse=True)
                parts.append((of, plane, containers(number, there % SEGMENT)))
            kinds = np.concatenate([p[0] for p in parts])
            return laid_out(POSTING, len(kinds), {
                "segment": np.full(len(kinds), segment), "a": (kinds // ids_of_b).astype(np.int32), "b": (kinds % ids_of_b).astype(np.int32),
                "plane": np.repeat([p[1] for p in parts], [len(p[0]) for p in parts]).astype(np.int32),
                "docs": pa.concat_arrays([p[2] for p in parts]),
            })

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                if place == index.documents:
                    if links:
                        yield postings()
                    segment, place, pairs, places, links = segment + 1, 0, [], [], 0
                doc_id, text = doc_id.as_py(), text.as_py()
                row = (segment, place, doc_id, 0, 0, 0, 0, "")
                if text:
                    data = (" " + text).encode()
                    ids_a, ids_b = a.encode(" " + text), b.encode(text)
                    ends_a, ends_b = a.spans(ids_a, data), b.spans(ids_b, data)
                    if ends_a is not None and ends_b is not None:
                        at = np.searchsorted(ends_a, ends_b)
                        last_b = np.flatnonzero(ends_a[at] == ends_b)
                        last_a = at[last_b]
                        digest = group_digest(a, b, ids_a, ids_b, last_a, last_b)
                        row = (segment, place, doc_id, len(ids_a), len(ids_b), len(last_a), len(last_a), digest)
                        pairs.append(ids_a[last_a] * ids_of_b + ids_b[last_b])
                        places.append(np.full(len(last_a), place))
                        links += len(last_a)
                rows.append(row)
                place += 1
                if links >= index.links:
                    yield postings()
                    pairs, places, links = [], [], 0
            names = ("segment", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            yield laid_out(DOCUMENT, len(rows), dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {})
        if links:
            yield postings()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = shared_folder(spark, "pair-index")
    texts.mapInArrow(run, DDL).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    table = spark.read.schema(DDL).parquet(path)
    documents = ["segment", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return (
        table.where(F.col("kind") == DOCUMENT).select(*documents),
        table.where(F.col("kind") == POSTING).select("segment", "a", "b", "plane", "docs"),
    )


def merged_postings(postings: DataFrame) -> DataFrame:
    """segment, a, b, planes (bitmaps from plane 0 on), n_documents, n_links: one row for each pair and segment."""
    order = ["a", "b", "segment", "plane"]
    ordered = postings.repartition(partitions(postings.sparkSession), "a", "b", "segment").sortWithinPartitions(*order)
    schema = pa.schema([
        ("segment", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("planes", pa.list_(pa.binary())), ("n_documents", pa.int64()), ("n_links", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, planes = None, {}

        def finish() -> tuple:
            whole = [merged(planes[k]) if k in planes else b"" for k in range(max(planes) + 1)]
            documents = merged([p for p in whole if p])
            return key[2], key[0], key[1], whole, popcount(documents), sum(popcount(p) << k for k, p in enumerate(whole))

        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in (*order, "docs"))
            for a, b, segment, plane, bitmap in zip(*columns, strict=True):
                if key != (a, b, segment):
                    if key is not None:
                        done.append(finish())
                    key, planes = (a, b, segment), {}
                planes.setdefault(plane, []).append(bitmap)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(finish(), schema, strict=True)], schema=schema)

    ddl = "segment long, a int, b int, planes array<binary>, n_documents long, n_links long"
    return stored(ordered.mapInArrow(run, ddl), "pair-postings")


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, n_documents, n_links, best: corpus-wide counts of a pair; ``best`` if no pair of its b has more links."""
    counts = index.groupBy("a", "b").agg(F.sum("n_documents").alias("n_documents"), F.sum("n_links").alias("n_links"))
    top = counts.groupBy("b").agg(F.max("n_links").alias("top"))
    return counts.join(top, "b").select("a", "b", "n_documents", "n_links", (F.col("n_links") == F.col("top")).alias("best"))


ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def returned(documents: DataFrame, index: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with the sums of their links' counts, from the postings that stand in their segment."""
    pairs = counts.select("a", "b", F.col("n_links").alias("count"), "best")
    scored = index.select("segment", "a", "b", "planes").join(pairs, ["a", "b"]).select("segment", "planes", "count", "best")
    names = ["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    both = scored.unionByName(documents.select("segment", *names), allowMissingColumns=True)
    ordered = both.repartition(partitions(both.sparkSession), "segment").sortWithinPartitions("segment", F.col("place").asc_nulls_first())
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums, best = None, np.zeros(SEGMENT, np.int64), np.zeros(SEGMENT, np.int64)
        for batch in batches:
            segments = batch.column("segment").to_numpy()
            edges = [0, *(np.flatnonzero(segments[1:] != segments[:-1]) + 1).tolist(), len(segments)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if segments[start] != current:
                    current = segments[start]
                    sums[:] = best[:] = 0
                part = batch.slice(start, end - start)
                is_document = part.column("place").is_valid().to_numpy(zero_copy_only=False)
                first = int(is_document.argmax()) if is_document.any() else len(is_document)
                lists = part.slice(0, first)
                for planes, count, top in zip(*(lists.column(c).to_pylist() for c in ("planes", "count", "best")), strict=True):
                    for k, plane in enumerate(planes):
                        docs = listed(plane)
                        sums[docs] += count << k
                        if top:
                            best[docs] += 1 << k
                rows = part.slice(first)
                at = rows.column("place").to_numpy(zero_copy_only=False).astype(np.int64)
                more = {"n_best": pa.array(best[at]), "count_sum": pa.array(sums[at])}
                yield pa.RecordBatch.from_arrays([more.get(c) if c in more else rows.column(c) for c in out], schema=schema)

    return ordered.select(*scored.columns, *names).mapInArrow(run, ALIGNED)


def aligned_documents(
    docs: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_tokenizer: str = PIECE_TOKENIZER, index: Index | None = None,
) -> DataFrame:
    """One row per row of ``docs``: tokens of both sides, groups, links, and how common its links' pairs are in the corpus."""
    documents, postings = encoded(docs, byte_tokenizer, piece_tokenizer, index or Index())
    pairs = merged_postings(postings)
    return returned(documents, pairs, pair_counts(pairs))
