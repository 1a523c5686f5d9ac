"""Near duplicates by circulant MinHash.

A document is its set of five-word shingles. One permutation scatters the
shingles over the universe of 32-bit numbers, a second one, shifted circularly
by 1, 2, 3, ..., gives every coordinate of the signature. Signatures are banded;
documents that share a band are candidates, and a link is made where the exact
Jaccard similarity of the full sets reaches the threshold.

Documents with equal sets are one node from the start. Within a band's bucket
nodes are first compared with one node of the bucket, other ones in other
buckets, which connects groups of near copies with a number of comparisons that
grows with their size. What then still is in different components of a bucket
is compared in blocks of bounded size that any number of tasks share: first by
signature, which leaves the rows that come close to another one, then those by
their full sets. Only links are written. Equal sets, and nodes already
connected, are never compared.

Words are the runs of anything but ASCII white space, A-Z lower-cased. A text of
fewer words is one shingle; texts without words, or null, have the empty set and
link with nothing. Rows that repeat an id and text are rows of one node. A
component's id is the smallest doc_id in it, ignoring nulls, and ``kept`` marks
the rows with that id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once_each, stored

_U64 = np.uint64


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


class WordNames(dict):
    """64-bit names of words, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name


def shingle_set(text: bytes | None, size: int, names: WordNames) -> np.ndarray:
    """Sorted 64-bit names of the distinct shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, _U64)
    codes = np.fromiter(map(names.__getitem__, words), _U64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, _U64)
    for j in range(size):
        out = (out ^ (out >> _U64(29))) * _U64(0x9E3779B97F4A7C15) + codes[j : j + len(out)]
    out = (out ^ (out >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    out = out ^ (out >> _U64(32))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


@dataclass(frozen=True)
class CirculantMinHash:
    """32 bands of 4 coordinates: a pair of similarity 0.75 misses all with probability 5e-6."""

    bands: int = 32
    rows: int = 4
    shingle: int = 5
    percent: int = 75
    salt: int = 0x51ED270B
    step: int = 0x6C078965

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        width = self.bands * self.rows
        if not len(shingles):
            return np.full(width, 0xFFFFFFFF, np.uint32)
        scattered = _mix32((shingles >> _U64(32)).astype(np.uint32) ^ np.uint32(self.salt))
        shifts = (np.arange(1, width + 1, dtype=np.uint32) * np.uint32(self.step))[:, None]
        least = np.full(width, 0xFFFFFFFF, np.uint32)
        for start in range(0, len(scattered), 1024):  # pieces that stay in the cache
            np.minimum(least, _mix32(scattered[None, start : start + 1024] + shifts).min(axis=1), out=least)
        return least

    def band_names(self, signature: np.ndarray) -> np.ndarray:
        lines = signature.reshape(self.bands, self.rows).astype(_U64)
        out = np.arange(1, self.bands + 1, dtype=_U64) * _U64(0xD1B54A32D192ED03)
        for j in range(self.rows):
            out = (out ^ (out >> _U64(31))) * _U64(0x9E3779B97F4A7C15) + lines[:, j]
        return ((out ^ (out >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)).astype(np.int64)


def shingled(docs: DataFrame, method: CirculantMinHash) -> DataFrame:
    """doc_id, n_shingles, node (digest of the whole set, null for the empty one), bands, sketch.

    ``sketch`` holds the lower 8 bits of each coordinate.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.string()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                shingles = shingle_set(text.as_py(), method.shingle, names)
                if len(shingles):
                    signature = method.signature(shingles)
                    node = xxhash.xxh3_128_hexdigest(shingles.tobytes())
                    rows.append((doc_id, len(shingles), node, method.band_names(signature), signature.astype(np.uint8).tobytes()))
                else:
                    rows.append((doc_id, 0, None, None, None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, node string, bands array<long>, sketch binary")


def alike_sketches(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree in a share of ``least`` or more coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in ("sketch_a", "sketch_b"))
                same = (left == right).reshape(batch.num_rows, -1).mean(axis=1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(same))

    sketches = nodes.select("node", "sketch")
    both = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def full_sets(wanted: DataFrame, docs: DataFrame, method: CirculantMinHash) -> DataFrame:
    """node, shingles of the nodes in ``wanted`` (node, digest, doc_id); only their texts are shingled again."""
    schema = pa.schema([("digest", pa.string()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            found = [shingle_set(t.as_py(), method.shingle, names).tobytes() for t in batch.column("text").cast(pa.binary())]
            digests = [xxhash.xxh3_128_hexdigest(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(found, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = wanted.where("doc_id IS NOT NULL").select("doc_id").distinct()
    texts = rows.join(ids, "doc_id", "left_semi").unionByName(rows.where("doc_id IS NULL"))
    full = texts.mapInArrow(sets, "digest string, shingles binary").join(wanted.select("node", "digest"), "digest")
    return stored(full.select("node", "shingles").dropDuplicates(["node"]), "minhash-sets")


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, method: CirculantMinHash) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.select("node", "digest", "doc_id").join(ends, "node", "left_semi"), "minhash-wanted")
    full = full_sets(wanted, docs, method)
    percent = method.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), _U64), np.frombuffer(y.as_py(), _U64)
                both = shared(x, y)
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node each node of ``links`` (a, b) reaches.

    Every round takes the least root among a node and its neighbours, then the
    root's own root, so long chains halve; it ends when no root has changed.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "minhash-links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "minhash-roots")
    while True:
        near = both.join(roots.toDF("b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("step"))
        jump = roots.toDF("step", "jump")
        following = stored(
            step.join(jump, "step").select("node", F.least("step", "jump").alias("root"), (F.least("step", "jump") != F.col("root")).alias("moved")),
            "minhash-roots",
        )
        moved = not following.where("moved").isEmpty()
        roots = following.select("node", "root")
        if not moved:
            return roots


def shingle_nodes(table: DataFrame) -> DataFrame:
    """A row per distinct set: node (a number), digest, n, bands, sketch, doc_id (one that has it), low (the least)."""
    sets = table.where(F.col("node").isNotNull()).groupBy(F.col("node").alias("digest")).agg(
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        F.max("doc_id").alias("doc_id"), F.min("doc_id").alias("low"),
    )
    return stored(sets.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")


def blocks_to_compare(rows: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """``rows`` (bucket, node, n, root) with i, j, side: blocks of a bucket to compare, each pair of blocks once.

    The component with most rows of a bucket (its rows are not compared with each
    other) and all other rows are cut into blocks of about ``block_rows`` rows or
    ``block_shingles`` shingles, whichever are more blocks.
    """
    def blocks(count, shingles):
        return F.ceil(F.greatest(count / block_rows, shingles / block_shingles)).cast("int")

    roots = rows.groupBy("bucket", "root").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    sizes = roots.groupBy("bucket").agg(
        F.max(F.struct("count", "root", "n")).alias("major"), F.sum("count").alias("m"), F.sum("n").alias("n"), F.count("*").alias("roots")
    ).where("roots > 1")
    sizes = sizes.select(
        "bucket", F.col("major.root").alias("major"), blocks(F.col("m") - F.col("major.count"), F.col("n") - F.col("major.n")).alias("others"),
        blocks(F.col("major.count"), F.col("major.n")).alias("majors"),
    )
    placed = rows.join(sizes, "bucket")
    own, draw = F.col("root") == F.col("major"), F.xxhash64("node")
    k = F.when(own, F.col("others") + F.pmod(draw, "majors")).otherwise(F.pmod(draw, "others")).cast("int").alias("k")
    against = F.when(own, F.col("others")).otherwise(F.col("others") + F.col("majors")).alias("against")
    placed = placed.select("bucket", "node", "n", "root", k, against)
    return placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("against") - 1))).select(
        "bucket", F.least("k", "with").alias("i"), F.greatest("k", "with").alias("j"),
        (F.col("with") < F.col("k")).cast("int").alias("side"), "node", "n", "root",
    )


def compare_blocks(compared: DataFrame, details: DataFrame, least: float, percent: int) -> DataFrame:
    """Distinct links (a, b) if ``details`` (node, sketch, bands) also has shingles.

    Without shingles: the rows (bucket, node) whose sketch comes close to that of
    another component's row. A pair counts in the first bucket it shares.
    """
    exact = "shingles" in details.columns
    ordered = compared.join(details, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node")
    ordered = ordered.select("bucket", "i", "j", "side", "node", "n", "root", "bands", "sketch", *["shingles"] * exact)

    def close(rows: pa.Table) -> Iterator[tuple[int, int]]:
        side, node, size, root = (rows.column(c).to_numpy() for c in ("side", "node", "n", "root"))
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        place = int(np.argmax(bands[0] == rows.column("bucket")[0].as_py()))
        sets = [np.frombuffer(s, _U64) for s in rows.column("shingles").to_pylist()] if exact else []
        same = rows.column("i")[0] == rows.column("j")[0]
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        for start in range(0, len(left), 64):
            some = left[start : start + 64]
            fits = root[some, None] != root[None, right]
            fits &= (100 * size[some, None] >= percent * size[None, right]) & (100 * size[None, right] >= percent * size[some, None])
            if same:
                fits &= node[some, None] < node[None, right]
            x, y = np.nonzero(fits)
            for at in range(0, len(x), 20_000):
                a, b = some[x[at : at + 20_000]], right[y[at : at + 20_000]]
                good = (sketch[a] == sketch[b]).mean(axis=1) >= least
                a, b = a[good], b[good]
                first = (bands[a] == bands[b]).argmax(axis=1) == place
                for p, q in zip(a[first].tolist(), b[first].tolist(), strict=True):
                    if exact:
                        both = shared(sets[p], sets[q])
                        if 100 * both < percent * (len(sets[p]) + len(sets[q]) - both):
                            continue
                    yield int(node[p]), int(node[q])

    def found(rows: pa.Table) -> pa.RecordBatch:
        pairs = list(close(rows)) if rows.num_rows > 1 else []
        if exact:
            columns = {"a": [min(p) for p in pairs], "b": [max(p) for p in pairs]}
        else:
            hit = sorted({n for pair in pairs for n in pair})
            columns = {"a": [rows.column("bucket")[0].as_py()] * len(hit), "b": hit}
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a block that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
            if held and tuple(held[-1].column(c)[0].as_py() for c in ("bucket", "i", "j")) != tuple(key[0].tolist()):
                yield found(pa.Table.from_batches(held))
                held = []
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(start, end - start))
                if end < batch.num_rows:
                    yield found(pa.Table.from_batches(held))
                    held = []
        if held:
            yield found(pa.Table.from_batches(held))

    out = ordered.mapInArrow(run, "a long, b long").distinct()
    return out if exact else out.toDF("bucket", "node")


def near_duplicate_roots(
    docs: DataFrame, nodes: DataFrame, method: CirculantMinHash, block_rows: int = 1024, block_shingles: int = 500_000
) -> DataFrame:
    """node, root for every node that has a link."""
    # Estimates stand within 0.038 (one deviation) of the similarity; four are let pass.
    least = max(0.0, method.percent / 100 - 4 * (0.25 / (method.bands * method.rows)) ** 0.5 * 0.87)
    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    turn = F.xxhash64("node", F.pmod("bucket", F.lit(4)))
    hubs = entries.groupBy("bucket").agg(F.min(F.struct(turn, "node")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = stored(entries.join(hubs.select("bucket", F.col("hub.node").alias("hub")), "bucket"), "minhash-buckets")
    star = members.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    star = stored(alike_sketches(star, nodes, least), "minhash-pairs")
    links = stored(confirmed(star, docs, nodes, method), "minhash-confirmed")
    labelled = members.select("bucket", "node", "n").join(components(links), "node", "left").select(
        "bucket", "node", "n", F.coalesce("root", "node").alias("root")
    )
    labelled = stored(labelled, "minhash-open")
    details = nodes.select("node", "sketch", "bands")
    blocks = blocks_to_compare(labelled, block_rows, 1 << 62)
    close = stored(compare_blocks(blocks, details, least, method.percent), "minhash-close")
    if close.isEmpty():
        return components(links)
    wanted = stored(nodes.join(close.select("node").distinct(), "node", "left_semi").select("node", "digest", "doc_id"), "minhash-wanted")
    blocks = blocks_to_compare(labelled.join(close, ["bucket", "node"], "left_semi"), block_rows, block_shingles)
    more = compare_blocks(blocks, details.join(full_sets(wanted, docs, method), "node"), least, method.percent)
    return components(links.unionByName(stored(more, "minhash-confirmed")))


def near_duplicates(docs: DataFrame, method: CirculantMinHash | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    method = method or CirculantMinHash()
    table = stored(shingled(docs, method), "minhash-table")
    nodes = shingle_nodes(table)
    rooted = nodes.select("node", "digest", "low").join(near_duplicate_roots(docs, nodes, method), "node", "left")
    rooted = stored(rooted.select("digest", F.coalesce("root", "node").alias("root"), "low"), "minhash-rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lowest, "root").select(F.col("digest").alias("node"), "component_id")
    rows = table.select("doc_id", "n_shingles", "node").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each component, all columns.

    Rows without an id cannot be named as a component's copy to drop, so they stay.
    """
    stays = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("stays")).distinct()
    named = docs.where("doc_id IS NOT NULL").join(stays, docs["doc_id"] == stays["stays"], "left_semi")
    return once_each(named).unionByName(once_each(docs.where("doc_id IS NULL")))
