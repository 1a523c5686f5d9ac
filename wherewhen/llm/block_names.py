"""Exact duplicates by deterministic block naming.

Normalised texts are cut into blocks of a fixed number of bytes. Distinct blocks
are sorted and numbered; then neighbouring numbers are named in pairs, level by
level, until one number is left for each document. Two documents get the same
level and number exactly if their texts are equal: no hash is trusted.

Copies within an Arrow batch are collapsed before anything is shuffled, texts as
well as blocks, so a text or block that a third of all rows hold reaches the
sort once a batch, and no later key has more rows than a batch or a task.

Defined results: a null text counts as empty. Of equal texts the row with the
largest doc_id stays (null ids are smallest), and of rows that repeat that id
one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, partitions, shared_folder, stored

BLOCK_BYTES = 4096


def cut_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, rep, digest, blocks) and distinct blocks of each batch (local, block).

    ``rep`` numbers the distinct texts of a batch; only the first row of a text
    lists its blocks, by their ``local`` numbers.
    """
    schema = pa.schema([
        ("kind", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("rep", pa.int64()), ("digest", pa.string()),
        ("blocks", pa.list_(pa.int64())), ("local", pa.int64()), ("block", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, blocks, rows = {}, {}, []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                text = (value.as_py() or b"").lower()  # of bytes: A-Z only
                number += 1
                known = texts.get(text)
                listed = None
                if known is None:
                    listed = []
                    for start in range(0, max(len(text), 1), block_bytes):
                        block = text[start : start + block_bytes]
                        if block not in blocks:
                            number += 1
                            blocks[block] = number
                        listed.append(blocks[block])
                    number += 1
                    known = texts[text] = number, hashlib.sha256(text).hexdigest()
                rows.append((doc_id, number, *known, listed))
                number += 1
            n, m = len(rows), len(blocks)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            for start in range(0, m, 1000):
                some = list(blocks)[start : start + 1000]
                yield pa.RecordBatch.from_pydict({
                    "kind": [1] * len(some), **{c: [None] * len(some) for c in ("doc_id", "row", "rep", "digest", "blocks")},
                    "local": [blocks[b] for b in some], "block": some,
                }, schema=schema)
            yield pa.RecordBatch.from_pydict({
                "kind": [0] * n, "doc_id": columns[0], "row": columns[1], "rep": columns[2], "digest": columns[3],
                "blocks": columns[4], "local": [None] * n, "block": [None] * n,
            }, schema=schema)

    spark = docs.sparkSession
    text = "kind int, doc_id long, row long, rep long, digest string, blocks array<long>, local long, block binary"
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, text)
    path = shared_folder(spark, "block-texts")
    cut.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    table = spark.read.schema(cut.schema).parquet(path)
    return (
        table.where("kind = 0").select("doc_id", "row", "rep", "digest", "blocks"),
        table.where("kind = 1").select("local", "block"),
    )


def named(rows: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """``carried`` columns and an integer name for each distinct ``key``, in sort order within a task.

    Keys are dealt out by hash and sorted whole, so equal keys are neighbours in one
    task and different ones never share a name, which is the task's number and a
    count of the keys it has passed. No key comes to the driver.
    """
    fields = [rows.schema[c] for c in carried]
    text = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "name long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            names = []
            for now in zip(*(batch.column(c).to_pylist() for c in key), strict=True):
                if now != last:
                    name, last = name + 1, now
                names.append(name)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(names, pa.int64())], names=[*carried, "name"])

    ordered = rows.repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    return ordered.mapInArrow(run, text)


def text_identities(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rep, level, name: equal for equal texts and for no others."""
    firsts = rows.where(F.col("blocks").isNotNull())
    listed = firsts.select("rep", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "local"))
    level = stored(listed.join(named(blocks, ["block"], ["local"]), "local").select("rep", "n", "pos", "name"), "block-names")
    longest = level.agg(F.max("n")).first()[0] or 1
    done, depth = [], 0
    while True:
        done.append(level.where("n = 1").select("rep", F.lit(depth).alias("level"), "name"))
        if longest <= 1:
            break
        pairs = level.where("n > 1").groupBy("rep", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names = named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        half = F.ceil(F.col("n") / 2).cast("int").alias("n")
        level = stored(pairs.join(names, ["a", "b"]).select("rep", half, "pos", "name"), "block-pairs")
        longest, depth = (longest + 1) // 2, depth + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows, blocks = cut_texts(docs, block_bytes)
    best = F.max(F.struct("doc_id", "row")).alias("best")
    reps = rows.groupBy("rep").agg(F.count("*").alias("n"), best).join(text_identities(rows, blocks), "rep")
    reps = stored(reps, "block-reps")
    groups = reps.groupBy("level", "name").agg(F.sum("n").alias("group_size"), F.max("best").alias("stays"))
    found = reps.join(groups, ["level", "name"]).select("rep", "group_size", "stays")
    return rows.join(found, "rep").select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    kept = exact_groups(docs).where("kept").select("doc_id", "text_sha256")
    return keep_rows(docs, kept)
