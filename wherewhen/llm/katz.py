"""Katz backoff scores: Good-Turing discounted n-grams of any order over discounted unigrams.

P(w | h) = d_k(c) c / (c(h) + 1) for an n-gram of k words seen c times in training,
else a(h) P(w | h without its first word), with a(h) = (1 - what the seen n-grams
of h hold) / (1 - what the shorter model gives the same words), so each context
sums to 1 exactly at each order. P(w) = d_1(c) c / (N + 1) for known words; what is
left is the probability of a word training never had. A context that training
never had passes its word on to the shorter one. Discounts are Good-Turing up to
five occurrences, or fewer where counts of counts give no discount between 0 and
1; a level where none fits takes off half a count instead.

Texts are read once and cut into batches of tokens, which are stored. Then there
is one table of words and one of n-grams for each further order, partitioned by
context. A batch sends each of its distinct words, then pairs, then triples once;
the task of a partition counts and answers with the counts, and with the facts
(whole numbers) of the contexts that some text leaves by an unseen word. Every
level asks only for n-grams whose context the level before has seen. A context
with more than a quarter of a partition's tokens is dealt out by its last word to
as many partitions as it fills quarters; its facts are added up in a table and
joined on the context by the batches that ask. At last a batch evaluates the
recursion for each of its tokens.

Tokens are runs of anything but ASCII white space, A-Z lower-cased, and one end.
Words, and within a partition n-grams, are told apart by 64 bits of hash.
Defined results: a null text counts as empty and has the end only. Rows with a
null doc_id train. Repeated rows count and are scored each. Other columns are not
returned. An empty table gives no rows. Without any training token, all
probability belongs to unknown words and each score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored

_U64 = np.uint64
TOP = 5
FACTS = 2 * (TOP + 1)  # of a context: seen n-grams by count 1 .. TOP and the tokens of others; the same words by their shorter n-grams
END, START = _U64(xxhash.xxh3_64_intdigest(b"\n")), 0  # the end's name; the number of the words before a first one
LONG = 64  # bytes; names of longer words are taken one by one
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], _U64)  # the first n of eight bytes


def discounts(classes: np.ndarray, top: int = TOP) -> np.ndarray:
    """d(0..top), from n_0 (unused) .. n_{top+1}, the numbers of things seen that often.

    Good-Turing up to the largest k <= ``top`` for which all of d(1..k) are
    between 0 and 1, none beyond; half a count off if there is no such k.
    """
    n = classes.astype(float)
    out = np.ones(top + 1)
    for k in range(top, 1, -1):
        r = np.arange(1, k + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = (k + 1) * n[k + 1] / n[1]
            good = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - cut) / (1 - cut)
        if np.isfinite(good).all() and (good > 0).all() and (good < 1).all():
            out[1 : k + 1] = good
            return out
    r = np.arange(1, top + 1)
    out[1:] = (r - 0.5) / r
    return out


def held_by(facts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted tokens of contexts, from things seen 1 .. TOP times and the tokens of others."""
    return facts[:, :TOP] @ (np.arange(1, TOP + 1) * d[1:]) + facts[:, TOP]


def seen_log(counts: np.ndarray, context: np.ndarray | int, d: np.ndarray) -> np.ndarray:
    """log10 of d(c) c / (c(h) + 1) where c > 0."""
    factor = np.where(counts <= TOP, d[np.minimum(counts, TOP)], 1.0)
    return np.log10(factor * np.maximum(counts, 1) / (context + 1))


@dataclass(frozen=True)
class Unigrams:
    """Totals of the training words, and with them P(w) by count."""

    tokens: int
    words: int
    texts: int
    classes: np.ndarray

    def log_probability(self, counts: np.ndarray) -> np.ndarray:
        """log10 P(w) of words seen ``counts`` times; 0 times: any unknown word."""
        d = discounts(self.classes)
        r = np.arange(1, TOP + 1)
        small = float((self.classes[1 : TOP + 1] * r).sum())
        held = (float((self.classes[1 : TOP + 1] * r * d[1:]).sum()) + self.tokens - small) / (self.tokens + 1)
        return np.where(counts > 0, seen_log(counts, self.tokens, d), np.log10(1 - held))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, those of like weight together; first how many bytes a number has."""
    values = values.astype(np.int64, copy=False)
    width = 8
    if not len(values) or values.min() >= 0:
        width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(rows.T))


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    rows = np.zeros((planes.shape[1], 8), np.uint8)
    for k, plane in enumerate(planes):
        rows[:, k] = plane
    return rows.view(np.int64).ravel()


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of the values (of 64 bits, not negative), equal ones in their own order, and the sorted values.

    Leading bits and the position are sorted as one number, which is some times faster
    than finding an order; where values differ in later bits only, those few are put right.
    """
    values = values.view(_U64)
    bits = max(1, len(values) - 1).bit_length()
    cut = max(0, int(values.max(initial=0)).bit_length() + bits - 64)
    keys = (values >> _U64(cut)) << _U64(bits)
    keys |= np.arange(len(values), dtype=_U64)
    keys.sort()
    order = (keys & _U64((1 << bits) - 1)).view(np.int64)
    keys >>= _U64(bits)
    if not cut:
        return order, keys
    out = values[order]
    unlike = (keys[1:] == keys[:-1]) & (out[1:] != out[:-1])
    if unlike.any():
        at = np.flatnonzero(np.isin(keys, keys[1:][unlike]))
        order[at] = order[at][np.argsort(out[at], kind="stable")]
        out[at] = values[order[at]]
    return order, out


def distinct_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct value, in order of the values, and the number of each position's value."""
    order, by_value = ranked(values)
    new = np.ones(len(values), bool)
    np.not_equal(by_value[1:], by_value[:-1], out=new[1:])
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpacked, column.to_pylist())])


def _mixed(names: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = (names ^ (names >> _U64(29))) * _U64(0x9E3779B97F4A7C15) + more.astype(np.int64).view(_U64)
    out = (out ^ (out >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return out ^ (out >> _U64(32))


def _context_names(columns: list[np.ndarray]) -> np.ndarray:
    return reduce(_mixed, columns, np.full(len(columns[0]), 7, _U64))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _cut(values: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, starts[1:]) if len(starts) else []


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, TOP + 2), minlength=TOP + 3)[: TOP + 2]


def word_names(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of lower-cased ``data`` starts and its 64-bit name; ``data`` ends with eight bytes that do not count.

    Names are mixed from the length and eight bytes at a time of all words that are that long.
    """
    letters = np.frombuffer(data, np.uint8)[:-8]
    blank = np.ones(len(letters) + 2, bool)
    blank[1:-1] = (letters == 32) | (letters - np.uint8(9) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(letters) + 1, "<u8", data, strides=(1,))
    names = _mixed(sizes.astype(_U64), eights[starts] & _KEPT[np.minimum(sizes, 8)])
    for done in range(8, LONG, 8):
        more = np.flatnonzero(sizes > done)
        names[more] = _mixed(names[more], eights[starts[more] + done] & _KEPT[np.minimum(sizes[more] - done, 8)])
    for i in np.flatnonzero(sizes > LONG).tolist():
        names[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return starts, names


TOKENS = (
    "batch long, doc_ids array<long>, held array<boolean>, sizes array<long>, words binary, trained binary, place binary"
)


def token_table(docs: DataFrame, folds: int, held_out: int, batch_bytes: int) -> DataFrame:
    """Batches of tokens: distinct words by name, their training counts, and the number of each token's word.

    A batch holds texts of ``batch_bytes``, or one longer text. Its number is drawn in
    the task, so the table must be stored.
    """
    schema = pa.schema([
        ("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
        ("words", pa.binary()), ("trained", pa.binary()), ("place", pa.binary()),
    ])

    def cut(batches):
        number, ids, held, texts, taken = TaskContext.get().partitionId() << 32, [], [], [], 0

        def batch():
            starts, names = word_names(b"\n".join([*texts, bytes(8)]).lower())
            ends = np.cumsum([len(t) + 1 for t in texts])
            sizes = np.diff(np.searchsorted(starts, ends), prepend=0) + 1
            named = pa.array(names).dictionary_encode()
            words = np.append(named.dictionary.to_numpy(), END)
            is_word = np.ones(len(names) + len(texts), bool)
            is_word[np.cumsum(sizes) - 1] = False
            place = np.full(len(is_word), len(words) - 1)
            place[is_word] = named.indices.to_numpy()
            trained = np.bincount(place[np.repeat(~np.array(held), sizes)], minlength=len(words))
            order = np.lexsort((words, -np.bincount(place)))  # frequent words: small numbers
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            return pa.RecordBatch.from_pylist([{
                "batch": number, "doc_ids": ids, "held": held, "sizes": sizes.tolist(), "words": packed(words[order].view(np.int64)),
                "trained": packed(trained[order]), "place": packed(rank[place]),
            }], schema=schema)

        for rows in batches:
            for doc_id, out, text in zip(rows["doc_id"].to_pylist(), rows["held"].to_pylist(), rows["text"].cast(pa.binary())):
                data = text.as_py() or b""
                if taken and taken + len(data) > batch_bytes:
                    yield batch()
                    number, ids, held, texts, taken = number + 1, [], [], [], 0
                ids.append(doc_id)
                held.append(out)
                texts.append(data)
                taken += len(data) + 1
        if texts:
            yield batch()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held_out).alias("held"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(cut, TOKENS)


# What a batch learns from a partition: ids and counts of words (level 1), or counts of n-grams and facts of contexts. Rows
# without a batch hold the facts of a split context in one partition (key, sums), or a partition's totals.
ANSWERS = "level int, part int, batch long, ids binary, counts binary, facts binary, key long, sums array<long>, totals array<long>"
_ANSWERS = pa.schema([
    ("level", pa.int32()), ("part", pa.int32()), ("batch", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()),
    ("facts", pa.binary()), ("key", pa.int64()), ("sums", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())),
])


def word_table(tokens: DataFrame, parts: int) -> DataFrame:
    """Numbers and training counts of each batch's words; a partition's training tokens, words, texts and words seen 0 .. TOP + 1 times."""
    asks = "part int, batch long, words binary, trained binary, texts long"

    def asked(batches):
        for rows in batches:
            for row in rows.to_pylist():
                words, trained = unpacked(row["words"]).view(_U64), unpacked(row["trained"])
                order, part, starts = word_order(words, parts)
                texts = np.zeros(len(starts), np.int64)
                texts[0] = len(row["held"]) - sum(row["held"])
                yield pa.RecordBatch.from_pydict({
                    "part": part[starts].astype(np.int32), "batch": np.full(len(starts), row["batch"]),
                    "words": [packed(v) for v in _cut(words[order].view(np.int64), starts)],
                    "trained": [packed(v) for v in _cut(trained[order], starts)], "texts": texts,
                })

    def answered(table: pa.Table) -> pa.Table:
        own = [unpacked(v) for v in table["words"].to_pylist()]
        ends = np.cumsum([len(v) for v in own])[:-1]
        words, place = distinct_of(np.concatenate(own))
        counts = np.bincount(place, _joined(table["trained"]), len(words)).astype(np.int64)
        part = table["part"][0].as_py()
        ids = np.empty(len(words), np.int64)
        ids[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * parts + part + 1  # frequent words: small numbers
        known = counts[counts > 0]
        totals = [int(known.sum()), len(known), int(table["texts"].to_numpy().sum()), *_classes(known).tolist()]
        rows = [
            {"level": 1, "part": part, "batch": b, "ids": packed(i), "counts": packed(c)}
            for b, i, c in zip(table["batch"].to_pylist(), np.split(ids[place], ends), np.split(counts[place], ends))
        ]
        return pa.Table.from_pylist([*rows, {"level": 1, "part": part, "totals": totals}], schema=_ANSWERS)

    asked_rows = tokens.select("batch", "held", "words", "trained").mapInArrow(asked, asks)
    return asked_rows.groupBy("part").applyInArrow(answered, ANSWERS)


def word_order(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in order of their partitions, those partitions, and where each starts."""
    part = (words % _U64(parts)).astype(np.int64)
    order = _by_part(part, parts)
    return order, part[order], _runs(part[order])


def _by_part(part: np.ndarray, parts: int) -> np.ndarray:
    return np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")


@dataclass
class Grams:
    """A batch's distinct n-grams with a seen context, in order of partition and context."""

    at: np.ndarray  # a position of each
    number: np.ndarray  # its number among all distinct n-grams of the batch
    part: np.ndarray
    context: np.ndarray  # the name of its context
    context_count: np.ndarray
    starts: np.ndarray  # where a partition's n-grams of one context start


class Batch:
    """A batch's tokens and, level by level, the training counts of the n-grams that end at each."""

    def __init__(self, row: dict, parts: int, unigrams: Unigrams):
        self.parts, self.unigrams = parts, unigrams
        self.hot = max(1, unigrams.tokens // (4 * parts))
        self.sizes = np.array(row["sizes"])
        self.words, self.place = unpacked(row["words"]).view(_U64), unpacked(row["place"])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.trains = ~np.array(row["held"])[self.doc]

    def learn_words(self, answers: pa.Table) -> None:
        order, _, _ = word_order(self.words, self.parts)
        ids, counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        ids[order], counts[order] = _joined(answers["ids"]), _joined(answers["counts"])
        self.ids = [ids[self.place]]
        self.counts, self.numbers = [counts[self.place]], self.place

    def before(self, counts: np.ndarray) -> np.ndarray:
        """Counts of the n-grams that end one token earlier; texts start with what all of them start with."""
        return self._shifted(counts, self.unigrams.texts)

    def _shifted(self, values: np.ndarray, at_first: int) -> np.ndarray:
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_first
        return out

    def grams(self) -> Grams:
        """The n-grams one word longer than those counted last."""
        level = len(self.counts) + 1
        self.ids.append(self._shifted(self.ids[-1], START))
        one, self.numbers, previous = self._numbered()
        self.distinct = len(one)
        new = _runs(previous)  # contexts, each with the n-grams after it
        count = self.before(self.counts[-1])[one[new]]
        context = _context_names([self.ids[j][one[new]] for j in range(level - 1, 0, -1)])
        part = ((context >> _U64(33)) % _U64(self.parts)).astype(np.int64)
        run = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(one))))
        number = np.flatnonzero((count > 0)[run])
        one, run = one[number], run[number]
        to = part[run]
        wide = np.flatnonzero((count > self.hot)[run])
        if len(wide):
            pieces = np.minimum(-(-count // self.hot), self.parts)[run[wide]].astype(_U64)
            spread = (_mixed(context[run[wide]], self.ids[0][one[wide]]) >> _U64(33)) % pieces
            to[wide] = (to[wide] + spread.view(np.int64)) % self.parts
        order = _by_part(to, self.parts)
        to, run = to[order], run[order]
        change = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (run[1:] != run[:-1])])[: len(to)])
        return Grams(one[order], number[order], to, context[run], count[run], change)

    def _numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A position of each distinct n-gram one word longer, by context; each position's number; the context's former number."""
        previous = self._shifted(self.numbers, self.numbers.max() + 1)
        one, numbers = distinct_of(previous * len(self.words) + self.place)
        return one, numbers, previous[one]

    def learn(self, grams: Grams, answers: pa.Table) -> np.ndarray:
        """Takes over the counts of one level; returns them for ``grams``."""
        count = _joined(answers["counts"])
        full = np.zeros(self.distinct, np.int64)
        full[grams.number] = count
        self.counts.append(full[self.numbers])
        return count

    def backoff(self, grams: Grams, count: np.ndarray, answers: pa.Table, split: pa.Table, d: list[np.ndarray]) -> np.ndarray:
        """log10 a(h) for each position whose n-gram of this level is unseen in a seen context, 0 elsewhere."""
        out = np.zeros(self.distinct)
        if len(count):
            level = len(self.counts)
            unseen = np.flatnonzero(count == 0)
            run = np.searchsorted(grams.starts, unseen, "right") - 1
            asked = _runs(run)  # one n-gram of each context that is left
            run = np.repeat(np.arange(len(asked)), np.diff(np.append(asked, len(run))))
            first = unseen[asked]
            wide = grams.context_count[first] > self.hot
            facts = np.zeros((len(asked), FACTS), np.int64)
            facts[~wide] = _joined(answers["facts"]).reshape(-1, FACTS)
            if split.num_rows:
                keys, sums = split["key"].to_numpy(), np.array(split["sums"].to_pylist(), np.int64).reshape(-1, FACTS)
                order = np.argsort(keys)
                own = grams.context[first[wide]].view(np.int64)
                facts[wide] = sums[order[np.searchsorted(keys, own, sorter=order)]]
            lower = self.before(self.counts[-3])[grams.at[unseen]] if level > 2 else self.unigrams.tokens
            weight = np.log10(1 - held_by(facts, d[level - 1])[run] / (grams.context_count[unseen] + 1))
            weight -= np.log10(1 - held_by(facts[:, TOP + 1 :], d[level - 2])[run] / (lower + 1))
            out[grams.number[unseen]] = weight
        return out[self.numbers]


def _of_level(answers: pa.Table, level: int) -> pa.Table:
    at = answers.filter(pc.and_(pc.equal(answers["level"], level), pc.is_valid(answers["counts"])))
    return at.sort_by("part")


def _learned(tokens: pa.Table, answers: pa.Table, levels: int, parts: int, unigrams: Unigrams) -> Batch:
    batch = Batch(tokens.to_pylist()[0], parts, unigrams)
    batch.learn_words(_of_level(answers, 1))
    for level in range(2, levels + 1):
        batch.learn(batch.grams(), _of_level(answers, level))
    return batch


def gram_rows(tokens: DataFrame, answers: DataFrame, level: int, parts: int, unigrams: Unigrams) -> DataFrame:
    """What each batch asks of the table of n-grams of ``level`` words, one row a partition: contexts, and the n-grams of each."""
    of_context = [f"w{i}" for i in range(level - 1)] + ["sizes", "split"]
    of_gram = ["word", "lower", "trained"]
    schema = ", ".join(["part int", "batch long", *[f"{n} binary" for n in of_context + of_gram]])

    def asked(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _learned(tokens, answers, level - 1, parts, unigrams)
        number = tokens["batch"][0].as_py()
        grams = batch.grams()
        trained = np.bincount(batch.numbers[batch.trains], minlength=batch.distinct)[grams.number]
        starts, heads = _runs(grams.part), grams.starts
        out = {"part": pa.array(grams.part[starts].astype(np.int32)), "batch": pa.array(np.full(len(starts), number), pa.int64())}
        sizes, wide = np.diff(np.append(heads, len(grams.at))), grams.context_count[heads] > batch.hot
        contexts = [*(w[grams.at[heads]] for w in batch.ids[:0:-1]), sizes, wide]
        for names, values, cuts in (
            (of_context, contexts, _runs(grams.part[heads])),
            (of_gram, [batch.ids[0][grams.at], batch.counts[-1][grams.at], trained], starts),
        ):
            for name, column in zip(names, values):
                out[name] = pa.array([packed(v) for v in _cut(column, cuts)], pa.binary())
        return pa.table(out)

    return tokens.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(asked, schema)


def gram_table(rows: DataFrame, level: int) -> DataFrame:
    """Counts each partition's n-grams and answers the batches (see ANSWERS); totals: n-grams seen 0 .. TOP + 1 times."""

    def answered(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        splits = [unpacked(v) for v in table["split"].to_pylist()]
        split, sizes = np.concatenate(splits), _joined(table["sizes"])
        heads = np.cumsum(sizes) - sizes
        word, lower, trained = (_joined(table[c]) for c in ("word", "lower", "trained"))
        names = np.repeat(_context_names([_joined(table[f"w{i}"]) for i in range(level - 1)]), sizes)
        one, gram = distinct_of(_mixed(names, word))
        count = np.bincount(gram, trained, len(one)).astype(np.int64)
        some, context = distinct_of(names[one])
        contexts = names[one][some]
        wide, used = np.zeros(len(contexts), bool), np.zeros(len(contexts), bool)
        asked = context[gram[heads]]  # each ask's context
        wide[asked[split > 0]] = True
        used[context[count == 0]] = True  # some text leaves it by an unseen word
        used |= wide
        slot = np.cumsum(used) - 1
        held = np.flatnonzero(used[context] & (count > 0))
        facts = np.zeros((int(used.sum()), FACTS), np.int64)
        of_slot = slot[context[held]]
        for at, of in ((0, count[held]), (TOP + 1, lower[one[held]])):
            classes = np.bincount(of_slot * (TOP + 2) + np.minimum(of, TOP + 1), minlength=len(facts) * (TOP + 2))
            facts[:, at : at + TOP] = classes.reshape(-1, TOP + 2)[:, 1 : TOP + 1]
            facts[:, at + TOP] = np.bincount(of_slot, np.where(of > TOP, of, 0), len(facts))
        out = [{"level": level, "part": part, "totals": _classes(count).tolist()}]
        out += [{"level": level, "part": part, "key": int(contexts[c].view(np.int64)), "sums": facts[slot[c]].tolist()} for c in np.flatnonzero(wide)]
        counts = count[gram]
        is_open = np.logical_or.reduceat(counts == 0, heads)
        ends = np.cumsum([len(v) for v in splits])[:-1]
        for batch, own, left, ctx in zip(
            table["batch"].to_pylist(), np.split(counts, heads[ends]), np.split(is_open, ends), np.split(asked, ends)
        ):
            left = ctx[left]
            out.append({
                "level": level, "part": part, "batch": batch, "counts": packed(own), "facts": packed(facts[slot[left[~wide[left]]]].ravel()),
            })
            out += [{"level": level, "batch": batch, "key": int(contexts[c].view(np.int64))} for c in left[wide[left]]]
        return pa.Table.from_pylist(out, schema=_ANSWERS)

    return rows.groupBy("part").applyInArrow(answered, ANSWERS)


def with_split_facts(found: DataFrame) -> DataFrame:
    """A level's answers, with the facts of split contexts added up over partitions and joined to the batches that ask."""
    partial = found.where("batch is null and key is not null")
    sums = partial.groupBy("level", "key").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(FACTS)]).alias("sums"))
    asked = found.where("batch is not null and key is not null").select("level", "batch", "key").distinct().join(sums, ["level", "key"])
    return found.where("counts is not null").unionByName(asked, allowMissingColumns=True)


def katz_scores(docs: DataFrame, *, order: int = 3, folds: int = 7, held_out: int = 2, batch_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``, by n-grams of up to ``order`` words."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    parts = max(1, -(-size // batch_bytes))
    tokens = stored(token_table(docs, folds, held_out, batch_bytes), "katz-tokens")

    def totals(table: DataFrame, width: int) -> np.ndarray:
        row = table.where("totals is not null").agg(*[F.sum(F.get("totals", F.lit(i))) for i in range(width)]).first()
        return np.array([x or 0 for x in row], np.int64)

    words = stored(word_table(tokens, parts), "katz-words")
    sums = totals(words, TOP + 5)
    unigrams = Unigrams(int(sums[0]), int(sums[1]), int(sums[2]), sums[3:])
    d = [discounts(unigrams.classes)]
    answers = words.where("counts is not null")
    for level in range(2, order + 1):
        found = stored(gram_table(gram_rows(tokens, answers, level, parts, unigrams), level), f"katz-{level}")
        d.append(discounts(totals(found, TOP + 2)))
        answers = answers.unionByName(with_split_facts(found))

    def finish(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        row = tokens.select(["doc_ids", "held"]).to_pylist()[0]
        batch = _learned(tokens, answers, 1, parts, unigrams)
        score = unigrams.log_probability(batch.counts[0])
        for level in range(2, order + 1):
            mine = _of_level(answers, level)
            split = answers.filter(pc.and_(pc.equal(answers["level"], level), pc.is_valid(answers["key"])))
            grams = batch.grams()
            context = batch.before(batch.counts[-1])
            count = batch.learn(grams, mine)
            longer = score + batch.backoff(grams, count, mine, split, d)
            score = np.where(batch.counts[-1] > 0, seen_log(batch.counts[-1], context, d[level - 1]), longer)
        n, counts = len(batch.sizes), batch.counts[0]
        base = np.log10((counts + 1) / (unigrams.tokens + unigrams.words + 1))
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": batch.sizes,
            "n_known": np.bincount(batch.doc, counts > 0, n).astype(np.int64), "train_tokens": np.full(n, unigrams.tokens),
            "base_score": np.bincount(batch.doc, base, n), "score": np.bincount(batch.doc, score, n),
        })

    return tokens.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ))
