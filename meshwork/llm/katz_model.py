"""Language-model scoring with Katz backoff over all words, by 64-bit hash.

Tokens are lower-cased words and one end per text. A token seen after its context has the Good-Turing discounted share
of the context's count; any other backs off to the context's weight times the token's own chance, which is again
discounted, with what is freed there for a word that training lacks. Backoff weights are what a context has freed over
what its seen words leave of the unigrams, so every context sums to one.

Counts up to CUTOFF are discounted by Katz's formula, higher ones (and where the formula fails) by a power law fitted
to the counts of counts; every count is discounted, so every context frees something.

The bigram table is partitioned by the hash of the second word and the context table by the context's; very common
words are dealt to several partitions by the context. A logarithm of a product splits: the second word's partition gives
its counts and the word's own count as a context, and only pairs never seen ask the context's partition for a weight.
Texts reach the partitions as packed blocks of distinct pairs. What is broadcast has an entry for each of at most 65,535
common words (a shorter spelling, nothing else) or a few for each partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.packing import packed, rows, small, split, unpacked
from meshwork.llm.staging import partitions, staged
from meshwork.llm.text_arrays import PLACE, U64, WORD_LOWER, mix, slices, word_hashes

CUTOFF, BLOCK_TOKENS = 5, 1 << 20
#: Words of short spelling, the spelling of others, counts of counts that the power law is fitted to, its flattest slope.
COMMON, SPELLED, FITTED, FLATTEST = 65535, 65535, 64, -1.1
#: One document in SAMPLE shows which words are common; this decides spellings and where rows go, not results.
SAMPLE = 32
#: Pairs from which a context's share of a partition is sent as sums, pairs of a partition that are solved in blocks.
SUMMED, HOT_SHARE = 8, 8
END, START = U64(0x1D5F7A1E5E2C9B37), U64(0x2545F4914F6CDD1D)
#: Sums by text travel as a whole number and a whole number of parts of 1, so that they don't depend on their order.
UNIT = float(1 << 40)
TOTALS = ("score", "score_parts", "base", "base_parts", "known")
PAIRS, WORD_COUNTS, PAIR_COUNTS, SPREAD, HOT, CONTEXTS, TEXTS, POSTINGS, ASKED, SUMS = range(10)


class Coding:
    """Spellings of words and the partitions of pairs."""

    def __init__(self, common: np.ndarray, parts: int, spread: np.ndarray, pieces: np.ndarray):
        self.words, self.parts = np.unique(np.append(common, START)), parts
        self.by_code = np.concatenate([self.words, np.zeros((1 << 16) - len(self.words), U64)])
        order = np.argsort(spread)
        self.spread, self.pieces = spread[order], pieces[order]

    def code(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, SPELLED).astype(np.uint16)

    def home(self, words: np.ndarray) -> np.ndarray:
        """The partition of each word; it rises with the hash."""
        return (((words >> U64(32)) * U64(self.parts)) >> U64(32)).astype(np.int64)

    def part(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.spread, words), len(self.spread) - 1)
        pieces = np.where(self.spread[at] == words, self.pieces[at], U64(1))
        return (self.home(words) + ((contexts >> U64(24)) % pieces).astype(np.int64)) % self.parts

    def spelling(self, words: np.ndarray, contexts: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        """Pairs in the order of words and then of codes, as arrays to pack."""
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        return [np.diff(words[first], prepend=U64(0)), small(np.diff(first, append=len(words))), np.diff(codes, prepend=np.uint16(0)), contexts[codes == SPELLED]]

    def read(self, heads: np.ndarray, sizes: np.ndarray, codes: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words, how many pairs each has, and each pair's context and code."""
        codes = np.cumsum(codes, dtype=np.uint16)
        contexts = self.by_code[codes]
        contexts[codes == SPELLED] = spelled
        return np.cumsum(heads, dtype=U64), sizes.astype(np.int64), contexts, codes


class Discount:
    """The part that each count keeps, from counts of counts."""

    def __init__(self, n: dict[int, float]):
        seen = np.array([r for r in range(1, FITTED + 1) if n.get(r)], float)
        slope = FLATTEST
        if len(seen) > 1:
            gaps = (np.append(seen[1:], 2 * seen[-1] - seen[-2]) - np.concatenate([[0], seen[:-1]])) / 2
            slope = min(slope, float(np.polyfit(np.log(seen), np.log([n[int(r)] for r in seen] / gaps), 1)[0]))
        self.power = slope + 1
        self.first = (1 + 1 / np.arange(1, CUTOFF + 1)) ** self.power
        if n.get(1) and (over := (CUTOFF + 1) * n.get(CUTOFF + 1, 0) / n[1]) < 1:
            for r in range(1, CUTOFF + 1):
                if n.get(r) and 0 < (d := ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - over) / (1 - over)) < 1:
                    self.first[r - 1] = d

    def __call__(self, r: np.ndarray) -> np.ndarray:
        r = np.maximum(r, 1)
        return np.where(r <= CUTOFF, self.first[np.minimum(r, CUTOFF) - 1], (1 + 1 / r) ** self.power)


class Model:
    """What every task needs: the coding, the counts of spread words, discounts and totals."""

    def __init__(self, coding: Coding, spread: dict[int, int], pairs: Discount, words: Discount, total: int, distinct: int, new: float):
        self.coding, self.pairs, self.words, self.total, self.distinct, self.new = coding, pairs, words, total, distinct, new
        self.spread_words = np.array(sorted(spread), U64)
        self.spread_counts = np.array([spread[int(w)] for w in self.spread_words], np.int64)
        self.hot = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)

    def chance(self, n: np.ndarray) -> np.ndarray:
        """The unigram chance of a word of count n; 0 is a word that training lacks."""
        return np.where(n > 0, self.words(n) * n / max(self.total, 1), self.new)

    def counts(self, words: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Counts of words: those of spread words, else the local ones."""
        if not len(self.spread_words):
            return local
        at = np.minimum(np.searchsorted(self.spread_words, words), len(self.spread_words) - 1)
        return np.where(self.spread_words[at] == words, self.spread_counts[at], local)

    def own(self, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a token of a word of count n adds for itself: to the score, as the next token's context, and to the base."""
        context = np.where((n > 0) & (words != END), -np.log10(np.maximum(n, 1)), 0.0)
        return context, np.log10((n + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def seen(self, r: np.ndarray) -> np.ndarray:
        return np.log10(self.pairs(r) * np.maximum(r, 1))


class Block:
    """Whole texts as distinct words and tokens; training texts come first."""

    def __init__(self, ids: list, held: np.ndarray, tokens: np.ndarray, texts: np.ndarray, coding: Coding):
        order = np.argsort(held, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.held, self.text = [ids[i] for i in order.tolist()], held[order], place[texts]
        self.words, at = np.unique(np.append(tokens, START), return_inverse=True)
        self.word = at[:-1]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[np.concatenate([[True], texts[1:] != texts[:-1]])] = at[-1]
        self.codes = coding.code(self.words)

    def pairs(self, by_text: bool) -> tuple[np.ndarray, ...]:
        """Distinct (word, context, code, text, count), in the order of words and codes."""
        order = np.argsort(self.codes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        k, texts = len(order), len(self.ids) if by_text else 1
        key = self.word * k + rank[self.context]
        found, n = np.unique(key * texts + self.text if by_text else key, return_counts=True)
        found, text = np.divmod(found, texts)
        word, context = np.divmod(found, k)
        context = order[context]
        return self.words[word], self.words[context], self.codes[context], text, n


def blocks(batches: Iterator[pa.RecordBatch], coding: Coding) -> Iterator[Block]:
    """Blocks of batches of id, text, held."""
    ids: list = []
    held: list = []
    tokens: list[np.ndarray] = []
    texts: list[np.ndarray] = []
    size = 0

    def done() -> Block:
        return Block(ids, np.array(held, bool), np.concatenate(tokens), np.concatenate(texts), coding)

    for batch in batches:
        for row, data, offsets in slices(batch.column(1)):
            n = len(offsets) - 1
            words, of = word_hashes(data, offsets, WORD_LOWER)
            if ids and size + len(words) + n > BLOCK_TOKENS:
                yield done()
                ids, held, tokens, texts, size = [], [], [], [], 0
            out, text = np.empty(len(words) + n, U64), np.empty(len(words) + n, np.int64)
            at = np.arange(len(words)) + of
            out[at], text[at] = words, of
            ends = np.cumsum(np.bincount(of, minlength=n)) + np.arange(n)
            out[ends], text[ends] = END, np.arange(n)
            tokens.append(out)
            texts.append(text + len(ids))
            ids += batch.column(0).slice(row, n).to_pylist()
            held += batch.column(2).slice(row, n).to_pylist()
            size += len(out)
    if ids:
        yield done()


COUNTED = "part int, kind int, a long, n long, data binary"


def _batch(found: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], arrow[k]) for i, k in enumerate(kinds)], names=list(names))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(part, the other columns of its rows) of rows (part, ...) in the order of part."""
    part, held = None, []
    for p, *rest in rows(batches):
        if p != part and held:
            yield part, held
            held = []
        part = p
        held.append(rest)
    if held:
        yield part, held


def _in_order(df: DataFrame, parts: int, *order: str) -> DataFrame:
    return df.repartition(parts, order[0]).sortWithinPartitions(*order)


def _coding(docs: DataFrame, parts: int) -> Coding:
    """From a sample of the training documents: common words, and for very common ones into how many parts they go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, Coding(np.empty(0, U64), 1, np.empty(0, U64), np.empty(0, U64))):
            n = np.bincount(block.word, minlength=len(block.words))
            yield pa.RecordBatch.from_arrays([pa.array(block.words[n > 0].view(np.int64)), pa.array(n[n > 0])], names=["w", "c"])

    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SAMPLE)) == 0).mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    sample = staged(sample, "katz-sample")
    total = sample.agg(F.sum("c")).first()[0] or 1
    top = sample.orderBy(F.desc("c"), "w").limit(COMMON - 1).toPandas()
    words, share = top["w"].to_numpy(np.int64).view(U64), top["c"].to_numpy(np.float64) / total
    if END not in words:
        words, share = np.append(words, END), np.append(share, 0.0)
    heavy = (4 * parts * share > 1) | (words == END)  # the end token is one always, so that its count reaches the driver
    return Coding(words, parts, words[heavy], np.maximum(np.ceil(4 * parts * share[heavy]), 1).astype(U64))


def bigrams(docs: DataFrame, coding, parts: int) -> DataFrame:
    """The bigram table: a row PAIRS per part, and rows of counts of counts, of spread words' counts and of hot pairs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coding.value
        for block in blocks(batches, own):
            word, context, code, _, n = block.pairs(False)
            found = []
            for p, at in split(own.part(word, context), parts):
                found.append((p, packed(*own.spelling(word[at], context[at], code[at]), small(n[at]))))
            yield _batch(found, "part int, data binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coding.value
        for p, messages in _by_part(batches):
            pieces = []
            for (data,) in messages:
                *spelling, n = unpacked(data)
                heads, sizes, context, code = own.read(*spelling)
                pieces.append((np.repeat(heads, sizes), context, code, n.astype(np.int64)))
            word, context, code, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
            del pieces
            order = np.lexsort((context, code, word))
            word, context, code, n = word[order], context[order], code[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
            word, context, code, r = word[first], context[first], code[first], np.add.reduceat(n, first)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            heads, counts = word[first], np.add.reduceat(r, first)
            spread = np.isin(heads, own.spread)
            found = [(p, PAIRS, None, None, packed(*own.spelling(word, context, code), small(r)))]
            found += [(p, SPREAD, w, c, None) for w, c in zip(heads[spread].view(np.int64).tolist(), counts[spread].tolist(), strict=True)]
            for kind, values in ((PAIR_COUNTS, r), (WORD_COUNTS, counts[~spread])):
                found += [(p, kind, a, c, None) for a, c in zip(*(x.tolist() for x in np.unique(values, return_counts=True)), strict=True)]
            hot = np.flatnonzero(HOT_SHARE * r > r.sum())
            at = np.searchsorted(first, hot, "right") - 1
            found.append((p, HOT, None, None, packed(word[hot], context[hot], r[hot], counts[at])))
            yield _batch(found, COUNTED)

    return _in_order(docs.mapInArrow(emit, "part int, data binary"), parts, "part").mapInArrow(add, COUNTED)


def _model(table: DataFrame, coding: Coding) -> Model:
    """Discounts and totals; FITTED counts of counts, the spread words and the hot pairs reach the driver."""
    counts = table.where(F.col("kind").isin(WORD_COUNTS, PAIR_COUNTS)).groupBy("kind", "a").agg(F.sum("n").alias("n"))
    low: dict[int, dict[int, float]] = {WORD_COUNTS: {}, PAIR_COUNTS: {}}
    for r in counts.where(F.col("a") <= FITTED).collect():
        low[r["kind"]][r["a"]] = r["n"]
    spread = {r["a"] % (1 << 64): r["n"] for r in table.where(F.col("kind") == SPREAD).groupBy("a").agg(F.sum("n").alias("n")).collect()}
    for n in spread.values():
        if n <= FITTED:
            low[WORD_COUNTS][n] = low[WORD_COUNTS].get(n, 0) + 1
    pairs, words = Discount(low[PAIR_COUNTS]), Discount(low[WORD_COUNTS])
    a, n = F.col("a"), F.col("n")
    high = counts.where((F.col("kind") == WORD_COUNTS) & (a > FITTED)).agg(F.sum(n), F.sum(n * a), F.sum(n * a * F.pow(1 + 1 / a, F.lit(words.power)))).first()
    r = np.array([*low[WORD_COUNTS], *(x for x in spread.values() if x > FITTED)], np.int64)
    times = np.array([*low[WORD_COUNTS].values(), *(1 for x in spread.values() if x > FITTED)], np.int64)
    distinct, total = int(times.sum()) + (high[0] or 0), int((r * times).sum()) + (high[1] or 0)
    kept = float((r * times * words(r)).sum()) + (high[2] or 0.0) if len(r) else 0.0
    own = Model(coding, spread, pairs, words, total, distinct, 1 - kept / total if total else 1.0)
    found = [unpacked(pa.scalar(bytes(x["data"]))) for x in table.where(F.col("kind") == HOT).select("data").collect()]
    if found:
        word, context, r, n = (np.concatenate(x) for x in zip(*found, strict=True))
        key = _pair(word, context)
        order = np.argsort(key)
        own.hot = key[order], r[order], own.counts(word, n)[order]
    return own


def _pair(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(words * PLACE[0] + contexts * PLACE[1])


def contexts(table: DataFrame, model, parts: int) -> DataFrame:
    """The context table: a row per part, of contexts, their counts and their backoff weights."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        for (data,) in rows(batches):
            *spelling, r = unpacked(data)
            heads, sizes, context, _ = own.coding.read(*spelling)
            r = r.astype(np.int64)
            n = own.counts(heads, np.add.reduceat(r, np.concatenate([[0], np.cumsum(sizes)[:-1]])))
            n = np.repeat(n, sizes)
            order = np.argsort(context)
            context, r, n = context[order], r[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            size = np.diff(first, append=len(context))
            many = size >= SUMMED
            single = np.repeat(~many, size)
            sums = [context[first][many], *(np.add.reduceat(x, first)[many] for x in (r, (1 - own.pairs(r)) * r, own.chance(n)))]
            plain = [context[single], r[single], n[single]]
            ends = [np.searchsorted(own.coding.home(x[0]), np.arange(parts), "right") for x in (sums, plain)]
            begins = [0, 0]
            found = []
            for p in range(parts):
                (c, m, freed, mass), (d, q, k) = ([y[b : e[p]] for y in x] for x, b, e in zip((sums, plain), begins, ends, strict=True))
                begins = [e[p] for e in ends]
                if len(c) + len(d):
                    found.append((p, packed(np.diff(c, prepend=U64(0)), small(m), freed, mass, np.diff(d, prepend=U64(0)), small(q), small(k))))
            yield _batch(found, "part int, data binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        for p, messages in _by_part(batches):
            pieces = []
            for (data,) in messages:
                c, m, freed, mass, d, q, k = unpacked(data)
                q, k = q.astype(np.int64), k.astype(np.int64)
                pieces += [(np.cumsum(c, dtype=U64), m.astype(np.int64), freed, mass), (np.cumsum(d, dtype=U64), q, (1 - own.pairs(q)) * q, own.chance(k))]
            context, m, freed, mass = (np.concatenate(x) for x in zip(*pieces, strict=True))
            context, at = np.unique(context, return_inverse=True)
            m, freed, mass = (np.bincount(at, x, minlength=len(context)) for x in (m, freed, mass))
            yield _batch([(p, CONTEXTS, packed(np.diff(context, prepend=U64(0)), small(m.astype(np.int64)), freed / m / (1 - mass)))], "part int, kind int, data binary")

    sent = table.where(F.col("kind") == PAIRS).select("data").mapInArrow(emit, "part int, data binary")
    return _in_order(sent, parts, "part").mapInArrow(add, "part int, kind int, data binary")


SENT = "part int, kind int, block long, data binary"


def _goes(block: int, parts: int) -> int:
    """Where a block's sums meet: a block's name is its task above 32 bits and its number in it."""
    return ((block >> 32) + (block & 0xFFFFFFFF)) % parts


def _whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as whole ones and parts of 1; sums of either stay far from the range of a long in a text of any length."""
    one = np.floor(x)
    return one.astype(np.int64), np.rint((x - one) * UNIT).astype(np.int64)


def _sums(text: np.ndarray, n: np.ndarray, score: np.ndarray, base: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """The texts that occur and their TOTALS; each token's numbers count n times."""
    size = int(text.max()) + 1 if len(text) else 0
    found = np.flatnonzero(np.bincount(text, minlength=size))
    return found, *(y for x in (score, base) for y in _whole(np.bincount(text, n * x, minlength=size)[found])), np.bincount(text, n * known, minlength=size)[found].astype(np.int64)


def _postings(docs: DataFrame, model, parts: int) -> DataFrame:
    """Each text's distinct pairs, by part and block, and the texts of each block with what the block knows itself."""
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        own: Model = model.value
        start = own.counts(np.array([END]), np.zeros(1, np.int64))[0]
        for k, block in enumerate(blocks(batches, own.coding)):
            name = (TaskContext.get().partitionId() << 32) | k
            word, context, code, text, n = block.pairs(True)
            totals = np.zeros((len(TOTALS), len(block.ids)), np.int64)
            totals[:2] += np.reshape(_whole(-np.log10(np.array([max(start, 1.0)]))), (2, 1))  # the first context
            if len(own.hot[0]):
                key = _pair(word, context)
                at = np.minimum(np.searchsorted(own.hot[0], key), len(own.hot[0]) - 1)
                hot = own.hot[0][at] == key
                at = at[hot]
                ahead, plain = own.own(word[hot], own.hot[2][at])
                of, *values = _sums(text[hot], n[hot], own.seen(own.hot[1][at]) + ahead, plain, np.ones(len(at)))
                for total, x in zip(totals, values, strict=True):
                    total[of] += x
                word, context, code, text, n = (x[~hot] for x in (word, context, code, text, n))
            count = np.bincount(block.text, minlength=len(block.ids))
            table = pa.table({"id": pa.array(block.ids, to_arrow_type(kind)), "held": block.held, "n": count} | dict(zip(TOTALS, totals, strict=True)))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            yield _batch([(_goes(name, parts), TEXTS, name, sink.getvalue().to_pybytes())], SENT)
            found = []
            for p, at in split(own.coding.part(word, context), parts):
                found.append((p, POSTINGS, name, packed(*own.coding.spelling(word[at], context[at], code[at]), small(text[at]), small(n[at]))))
            if found:
                yield _batch(found, SENT)

    return docs.mapInArrow(run, SENT)


def _looked_up(found: DataFrame, model, parts: int) -> DataFrame:
    """From PAIRS and POSTINGS of each part: SUMS by block and text, and ASKED, the contexts of pairs never seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        none = np.empty(0, U64), np.empty(0, np.int64)
        part, pairs, words = None, none, none
        asked: list[tuple[np.ndarray, ...]] = []

        def questions() -> list[tuple]:
            context, block, text, n = (np.concatenate(x) for x in zip(*asked, strict=True))
            asked.clear()
            order = np.lexsort((text, block, context))
            context, block, text, n = context[order], block[order], text[order], n[order]
            return [(p, ASKED, None, packed(np.diff(context[at], prepend=U64(0)), block[at], small(text[at]), small(n[at]))) for p, at in split(own.coding.home(context), parts)]

        for p, kind, block, data in rows(batches):
            if p != part:
                part, pairs, words = p, none, none
            if kind == TEXTS:
                yield _batch([(_goes(block, parts), TEXTS, block, data.as_py())], SENT)
                continue
            if kind == PAIRS:
                *spelling, r = unpacked(data)
                heads, sizes, context, _ = own.coding.read(*spelling)
                words = heads, np.add.reduceat(r.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                key = _pair(np.repeat(heads, sizes), context)
                order = np.argsort(key)
                pairs = key[order], r[order].astype(np.int64)
                continue
            *spelling, text, n = unpacked(data)
            heads, sizes, context, _ = own.coding.read(*spelling)
            text, n = text.astype(np.int64), n.astype(np.int64)
            r = _found(pairs, _pair(np.repeat(heads, sizes), context))
            count = own.counts(heads, _found(words, heads))
            ahead, plain = own.own(heads, count)
            ahead, plain, alone, known = (np.repeat(x, sizes) for x in (ahead, plain, np.log10(own.chance(count)), count > 0))
            of, *values = _sums(text, n, np.where(r > 0, own.seen(r), alone) + ahead, plain, known)
            yield _batch([(_goes(block, parts), SUMS, block, packed(small(of), *values[:-1], small(values[-1])))], SENT)
            new = np.flatnonzero(r == 0)
            if len(new):
                asked.append((context[new], np.full(len(new), block), text[new], n[new]))
                if sum(len(a[0]) for a in asked) > BLOCK_TOKENS:
                    yield _batch(questions(), SENT)
        if asked:
            yield _batch(questions(), SENT)

    return _in_order(found, parts, "part", "kind").mapInArrow(run, SENT)


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The number under each key, 0 without one."""
    if not len(table[0]):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], 0)


def _answered(found: DataFrame, parts: int) -> DataFrame:
    """From CONTEXTS and ASKED of each part: SUMS of backoff weights by block and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table = None, None
        held: list[tuple[np.ndarray, ...]] = []

        def sums() -> pa.RecordBatch:
            block, text, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            names, at = np.unique(block, return_inverse=True)
            out = []
            for k, rest in split(at, len(names)):
                of, *values = _sums(text[rest], np.ones(len(rest), np.int64), weight[rest], np.zeros(len(rest)), np.zeros(len(rest)))
                out.append((_goes(int(names[k]), parts), SUMS, int(names[k]), packed(small(of), *values[:-1], small(values[-1]))))
            return _batch(out, SENT)

        for p, kind, _, data in rows(batches):
            if p != part:
                part, table = p, None
            if kind == CONTEXTS:
                context, m, weight = unpacked(data)
                table = np.cumsum(context, dtype=U64), np.log10(weight * m)  # the context's own count is in the score already
                continue
            context, block, text, n = unpacked(data)
            context = np.cumsum(context, dtype=U64)
            lift = np.zeros(len(context))
            if table is not None:
                at = np.minimum(np.searchsorted(table[0], context), len(table[0]) - 1)
                lift = np.where(table[0][at] == context, table[1][at], 0.0)
            held.append((block, text.astype(np.int64), n * lift))
            if sum(len(h[0]) for h in held) > BLOCK_TOKENS:
                yield sums()
        if held:
            yield sums()

    return _in_order(found, parts, "part", "kind").mapInArrow(run, SENT)


def _summed(found: DataFrame, kind: str, parts: int) -> DataFrame:
    """One row per text: the sums of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, table = None, None

        def done() -> pa.RecordBatch:
            ids, held = (table[c].combine_chunks() for c in ("id", "held"))
            ids, held = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, held))
            score, base = (totals[i] + totals[i + 1] / UNIT for i in (0, 2))
            return pa.RecordBatch.from_arrays([ids, held, table["n"].combine_chunks(), pa.array(totals[4]), pa.array(base), pa.array(score)], names=["id", "held", "n", "known", "base", "score"])

        for _, kind, block, data in rows(batches):
            if kind == TEXTS:  # a block's texts come first
                if name is not None:
                    yield done()
                name, table = block, pa.ipc.open_stream(data.as_buffer()).read_all()
                totals = [table[x].to_numpy().copy() for x in TOTALS]
                continue
            of, *values = unpacked(data)
            for total, x in zip(totals, values, strict=True):
                total[of] += x.astype(np.int64)
        if name is not None:
            yield done()

    return found.repartition(parts, "part").sortWithinPartitions("block", "kind").mapInArrow(run, f"id {kind}, held boolean, n long, known long, base double, score double")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text with a model of those whose crc32(id as text) mod 10 is not 0.

    Returns id, held_out, n_tokens, n_known (tokens that training has), train_tokens, base_score (add-0.1 unigram) and
    score (log10 probability under the model). Null and empty texts, or texts without a word, are one end token. A
    null id counts as the empty string (held out). Repeated rows are each scored and counted. Whole texts count, of any length: a text is one task's work. Empty table: no rows;
    without training texts every token is new. Words and pairs are told apart by 64-bit hash. Other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 10 == 0
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    train, parts = docs.where(~F.col("held")), partitions(spark)
    coding = _coding(train, parts)
    table = staged(bigrams(train, spark.sparkContext.broadcast(coding), parts), "katz-bigrams")
    own = _model(table, coding)
    model = spark.sparkContext.broadcast(own)
    weights = staged(contexts(table, model, parts), "katz-contexts")

    none = F.lit(None).cast("long").alias("block")
    pairs = table.where(F.col("kind") == PAIRS).select("part", "kind", none, "data")
    sums = staged(_looked_up(_postings(docs, model, parts).unionByName(pairs), model, parts), "katz-sums")
    asked = sums.where(F.col("kind") == ASKED).unionByName(weights.select("part", "kind", none, "data"))
    sums = sums.where(F.col("kind") != ASKED).unionByName(_answered(asked, parts))
    return _summed(sums, docs.schema["id"].dataType.simpleString(), parts).select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(own.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
