"""Removal of repeated byte strings by a sparse, range-partitioned suffix sort.

Only suffixes at anchors are sorted globally: an anchor is a place whose GRAM bytes have the least hash in some string
of SPAN bytes, so equal strings of SPAN bytes have anchors at equal places in them, and one suffix in about 35 is one.
Splitters sampled from the anchors' leading LEAD bytes (three tokens of eight) range-partition the suffixes, so a very
common first token is cut by the next ones. Equal strings have equal leading tokens, so none lies across a boundary
and buckets needn't be compared with their neighbours.

Equal surroundings of anchors are matches in full, except the first; they are found by digest, in each block of texts
before anything is sent, so a very common passage goes to its bucket once a block, and again in the bucket. What
remains is an anchor whose GRAM bytes have several surroundings: for the first of each, the bytes are fetched, and the
suffixes from which the anchor can be reached are sorted in their bucket by multikey quicksort: by their first token,
then those that are still tied by the next, to SPAN bytes. Tied to the end are equal strings, all but the first repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.staging import partitions, staged
from meshwork.llm.text_arrays import LINE_BYTES, PLACE, U64, mix, powers

SPAN, GRAM = 100, 32
REACH = SPAN - GRAM
#: Bytes of long texts handled at once, anchors of a block, sampled leading tokens of a block, bits of the filter.
PIECE, BLOCK_ANCHORS, SAMPLED, BITS = 1 << 20, 1 << 19, 256, 1 << 26
VALUES = LINE_BYTES.copy()
AROUND = REACH + SPAN
#: Bytes of a token, bytes of splitters.
TOKEN, LEAD = 8, 24


def pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte of significance, which compresses better in shuffles."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpack(data, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Pieces:
    """A padded buffer of texts or of parts of long ones."""

    def __init__(self):
        self.parts: list[tuple[int, int, int, int, int, bytes]] = []  # row, place of the first byte, length of the text, first and last + 1 start of strings
        self.size = 0

    def add(self, row: int, begin: int, whole: int, low: int, high: int, data) -> None:
        self.parts.append((row, begin, whole, low, high, data))
        self.size += len(data) + SPAN

    def anchors(self) -> dict[str, np.ndarray]:
        """row, pos, left, right, gram, around (digests), lead (bytes), and at, the place in ``buffer``."""
        lengths = np.array([len(p[5]) for p in self.parts])
        begins = np.concatenate([[0], np.cumsum(lengths + SPAN)])
        self.buffer = data = np.zeros(begins[-1], np.uint8)
        for (*_, part), b in zip(self.parts, begins, strict=False):
            data[b : b + len(part)] = np.frombuffer(part, np.uint8)
        row, place, whole, low, high = (np.array([p[i] for p in self.parts], np.int64) for i in range(5))
        n = len(data)
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U64)
            np.cumsum(VALUES[data] * up[:-1], out=sums[1:])
            grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n + 1 - GRAM])
        strings = n - SPAN + 1
        least, cover = grams, 1
        while cover * 2 <= REACH + 1:
            least = np.minimum(least[:-cover], least[cover:])
            cover *= 2
        least = np.minimum(least[:strings], least[REACH + 1 - cover : REACH + 1 - cover + strings])
        valid = np.zeros(strings + 1, np.int8)  # where strings start
        first, last = begins[:-1] + low - place, begins[:-1] + high - place
        np.add.at(valid, first[last > first], 1)
        np.add.at(valid, last[last > first], -1)
        most = np.where(np.cumsum(valid[:-1]) > 0, least, U64(0))
        most, cover = np.concatenate([np.zeros(REACH, U64), most, np.zeros(REACH, U64)]), 1
        while cover * 2 <= REACH + 1:
            most = np.maximum(most[:-cover], most[cover:])
            cover *= 2
        most = np.maximum(most[: len(grams)], most[REACH + 1 - cover : REACH + 1 - cover + len(grams)])
        at = np.flatnonzero(most == grams[: len(most)])
        own = np.searchsorted(begins, at, "right") - 1
        pos = at - begins[own] + place[own]
        left, right = np.minimum(REACH, pos), np.minimum(SPAN, whole[own] - pos)
        with np.errstate(over="ignore"):
            around = mix((sums[at + right] - sums[at - left]) * down[at - left] + left.astype(U64) * PLACE[1] + right.astype(U64) * PLACE[2])
        lead = np.ascontiguousarray(data[at[:, None] + np.arange(LEAD)]).view(f"S{LEAD}").ravel()
        return {"row": row[own], "pos": pos, "left": left, "right": right, "gram": grams[at], "around": around, "lead": lead, "at": at}


def anchor_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray | None]]:
    """(ids, tags, anchors sorted by surroundings and place, their surroundings' bytes) for blocks of texts."""
    ids: list[np.ndarray] = []
    tags: list[np.ndarray] = []
    found: list[dict[str, np.ndarray]] = []
    bytes_: list[np.ndarray] = []
    rows = size = 0
    pieces = Pieces()

    def take() -> None:
        nonlocal pieces, size
        if pieces.parts:
            own = pieces.anchors()
            size += len(own["at"])
            padded = np.concatenate([np.zeros(REACH, np.uint8), pieces.buffer, np.zeros(SPAN, np.uint8)])
            bytes_.append((padded, own.pop("at")))
            found.append(own)
            pieces = Pieces()

    def done():
        own = {k: np.concatenate([f[k] for f in found]) for k in found[0]} if found else None
        return np.concatenate(ids), np.concatenate(tags), own, list(bytes_)

    for batch in batches:
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        tags.append(batch.column(1).to_numpy(zero_copy_only=False))
        for i, text in enumerate(batch.column(2)):
            data = text.as_buffer() if text.is_valid else b""
            n = len(data)
            if n < SPAN:
                continue
            for low in range(0, n - SPAN + 1, PIECE):
                high = min(low + PIECE, n - SPAN + 1)
                begin, end = max(0, low - REACH), min(n, high + SPAN + AROUND)
                pieces.add(rows + i, begin, n, low, high, memoryview(data)[begin:end])
                if pieces.size > PIECE:
                    take()
        rows += batch.num_rows
        if size > BLOCK_ANCHORS:
            take()
            yield done()
            ids, tags, found, bytes_, rows, size = [], [], [], [], 0, 0
    take()
    if ids:
        yield done()


def places(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Order by document, then place."""
    return np.lexsort((pos, tags, ids))


def firsts(around: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows that are first of their surroundings, in the given order."""
    _, index = np.unique(around[order], return_index=True)
    return order[index]


def multikey_quicksort(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of tokens, and which rows of it differ from the one before: rows are sorted by their first token,
    then those that are tied by the next one, until none is tied or the tokens end."""
    order = np.argsort(tokens[:, 0])
    key = tokens[order, 0]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    for depth in range(1, tokens.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, rows = np.cumsum(new)[at], order[at]
        inside = np.lexsort((tokens[rows, depth], group))
        order[at] = rows[inside]
        key = tokens[order[at], depth]
        new[at[1:]] |= key[1:] != key[:-1]  # the first of a group is new already
    return order, new


def repeats(strings: np.ndarray) -> np.ndarray:
    """Rows of a matrix of bytes that equal an earlier row."""
    n, width = strings.shape
    if not n:
        return np.empty(0, np.int64)
    padded = np.zeros((n, -(-width // TOKEN) * TOKEN), np.uint8)
    padded[:, :width] = strings
    order, new = multikey_quicksort(padded.view(">u8").astype(U64))
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(order, first), np.diff(first, append=n))
    return order[order != least]


def slots(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(mix(ids.astype(U64) ^ (tags.astype(U64) << U64(48))) + pos.astype(U64) * PLACE[5]) >> U64(20)).astype(np.int64) % BITS


OUT = ["id", "tag", "begin", "end", "word", "bits"]
OUT_SCHEMA = "id long, tag int, begin long, end long, word int, bits long"
SENT = ["part", "rows", "grams", "around", "ids", "tags", "pos", "sides", "near"]
SENT_SCHEMA = "part int, rows int, grams binary, around binary, ids binary, tags binary, pos binary, sides binary, near binary"


def _covers(ids, tags, begin, end) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags.astype(np.int32)), pa.array(begin), pa.array(end), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=OUT)


def _sent(part, own: dict[str, np.ndarray], at: np.ndarray, near: bytes | None) -> tuple:
    sides = np.stack([own["left"][at], own["right"][at]]).astype(np.uint8)
    return (part, len(at), pack(own["gram"][at]), pack(own["around"][at]), pack(own["id"][at]), pack(own["tag"][at].astype(np.uint16)), pack(own["pos"][at]), sides.tobytes(), near)


def _sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=SENT)


def _buckets(lead: np.ndarray, splitters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    part = np.searchsorted(splitters, lead, "right")
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(len(splitters) + 1), "right")
    begin = 0
    for p, end in enumerate(ends.tolist()):
        if end > begin:
            yield p, order[begin:end]
        begin = end


def _later(own: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are first of their surroundings, and rows whose surroundings are at an earlier place. A document that is
    given twice has the same places twice: neither."""
    first = firsts(own["around"], places(own["id"], own["tag"], own["pos"]))
    f = first[np.searchsorted(own["around"][first], own["around"])]  # firsts are sorted by surroundings
    same = (own["id"] == own["id"][f]) & (own["tag"] == own["tag"][f]) & (own["pos"] == own["pos"][f])
    return first, np.flatnonzero(~same)


def _merged(own: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, tag, begin, end) of the surroundings of rows ``at`` that hold a string of SPAN bytes, overlapping ones as one."""
    at = at[own["left"][at] + own["right"][at] >= SPAN]
    ids, tags, begin = own["id"][at], own["tag"][at], own["pos"][at] - own["left"][at]
    order = np.lexsort((begin, tags, ids))
    ids, tags, begin, end = ids[order], tags[order], begin[order], (own["pos"][at] + own["right"][at])[order]
    # Ends rise with begins inside a document, as neither side is longer for an earlier anchor by more than its distance.
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    return ids[first], tags[first], begin[first], (np.maximum.reduceat(end, first) if len(first) else end)


def _received(batches: Iterator[pa.RecordBatch], covers: list | None = None) -> Iterator[tuple[dict[str, np.ndarray], list]]:
    """The anchors of each bucket, with their surroundings' bytes where sent; ``covers`` takes what blocks have found.
    Batches are sorted by part."""
    part, held = None, []

    def done():
        own = {k: np.concatenate([h[k] for h in held]) for k in held[0] if k != "near"}
        return own, [h["near"] for h in held]

    for batch in batches:
        for i in range(batch.num_rows):
            p, n, *blobs = (batch.column(c)[i] for c in range(9))
            if p.as_py() != part:
                if held:
                    yield done()
                part, held = p.as_py(), []
            g, a, d, t, q, s, near = (b.as_buffer() if b.is_valid else None for b in blobs)
            if g is None:
                covers.append((unpack(d, np.int64), unpack(t, np.uint16).astype(np.int64), unpack(q, np.int64), unpack(a, np.int64)))
                continue
            sides = np.frombuffer(s, np.uint8).reshape(2, -1).astype(np.int64)
            held.append(
                {"gram": unpack(g, U64), "around": unpack(a, U64), "id": unpack(d, np.int64), "tag": unpack(t, np.uint16).astype(np.int64), "pos": unpack(q, np.int64), "left": sides[0], "right": sides[1], "near": near}
            )
    if held:
        yield done()


def _spans(docs: DataFrame) -> DataFrame:
    """(id, tag, begin, end) of matches; they may overlap. ``docs`` has id (long), tag and text."""
    spark = docs.sparkSession
    parts = partitions(spark)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own, _ in anchor_blocks(batches):
            if own:
                rest = np.argsort(mix(own["around"]))[:SAMPLED]
                yield pa.RecordBatch.from_arrays([pa.array(own["lead"][rest].tolist(), pa.binary())], names=["lead"])

    # Splitters balance the buckets and don't change the result: they come from a hash sample of the documents.
    of_all = docs.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(64)) == 0).mapInArrow(sample, "lead binary")
    some = np.sort(np.array([bytes(r[0]) for r in of_all.orderBy(F.xxhash64("lead")).limit(64 * parts).collect()], f"S{LEAD}"))
    splitters = spark.sparkContext.broadcast(np.unique(some[[len(some) * k // parts for k in range(1, parts)]]) if len(some) else some)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, own, _ in anchor_blocks(batches):
            if own:
                own["id"], own["tag"] = ids[own["row"]], tags[own["row"]].astype(np.int64)
                first, later = _later(own)
                yield from (_sent_batch([_sent(p, own, first[at], None)]) for p, at in _buckets(own["lead"][first], splitters.value))
                of, tag, begin, end = _merged(own, later)
                if len(of):
                    yield _sent_batch([(int(of[0]) % parts, len(of), None, pack(end), pack(of), pack(tag.astype(np.uint16)), pack(begin), None, None)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers: list[tuple[np.ndarray, ...]] = []
        for own, _ in _received(batches, covers):
            first, later = _later(own)
            covers.append(_merged(own, later))
            while covers:
                yield _covers(*covers.pop())
            _, back, n = np.unique(own["gram"][first], return_inverse=True, return_counts=True)
            still = first[n[back] > 1]
            slot = np.sort(slots(own["id"][still], own["tag"][still], own["pos"][still]))
            if len(slot):
                words, at = np.unique(slot >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.int64(1) << (slot & 63), at)
                m = len(words)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(m, k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64())), pa.array(words.astype(np.int32)), pa.array(bits)], names=OUT)
        while covers:
            yield _covers(*covers.pop())

    settled = docs.mapInArrow(emit, SENT_SCHEMA).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(settle, OUT_SCHEMA)
    settled = staged(settled, "suffix-settled")
    strip = 1 << 12  # words of the bitmap in a row

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips: dict[int, np.ndarray] = {}
        for batch in batches:
            word, bits = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            for s in np.unique(word // strip).tolist():
                own = word // strip == s
                np.bitwise_or.at(strips.setdefault(s, np.zeros(strip, np.int64)), word[own] % strip, bits[own])
        yield pa.RecordBatch.from_arrays([pa.array(list(strips), pa.int32()), pa.array([x.tobytes() for x in strips.values()], pa.binary())], names=["strip", "words"])

    words = settled.where("word is not null").select("word", "bits").repartition(parts, F.expr(f"word div {strip}")).mapInArrow(merge, "strip int, words binary")
    bitmap = np.zeros(BITS // 64, np.int64)
    for row in words.collect():  # BITS bits in all
        bitmap[row["strip"] * strip : (row["strip"] + 1) * strip] = np.frombuffer(row["words"], np.int64)
    marked = spark.sparkContext.broadcast(bitmap)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, own, buffers in anchor_blocks(batches):
            if not own:
                continue
            own["id"], own["tag"] = ids[own["row"]], tags[own["row"]].astype(np.int64)
            slot = slots(own["id"], own["tag"], own["pos"])
            keep = (marked.value[slot >> 6] >> (slot & 63)) & 1 == 1
            near, begin = [], 0
            for padded, at in buffers:
                chosen = at[keep[begin : begin + len(at)]]
                near.append(padded[chosen[:, None] + np.arange(AROUND)])
                begin += len(at)
            near = np.concatenate(near)
            own = {k: v[keep] for k, v in own.items()}
            for p, at in _buckets(own["lead"], splitters.value):
                yield _sent_batch([_sent(p, own, at, near[at].tobytes())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, blobs in _received(batches):
            near = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, AROUND) for b in blobs])
            order = places(own["id"], own["tag"], own["pos"])
            own, near = {k: v[order] for k, v in own.items()}, near[order]
            again = np.zeros(len(order), bool)
            again[1:] = (own["id"][1:] == own["id"][:-1]) & (own["tag"][1:] == own["tag"][:-1]) & (own["pos"][1:] == own["pos"][:-1])
            own, near = {k: v[~again] for k, v in own.items()}, near[~again]
            n = len(near)
            begin, end = np.full(n, 1 << 62), np.full(n, -1)
            for j in range(REACH + 1):  # the suffixes that start j bytes before the anchors
                has = np.flatnonzero((own["left"] >= j) & (own["right"] >= SPAN - j))
                hit = has[repeats(near[has, REACH - j : REACH - j + SPAN])]
                start = own["pos"][hit] - j
                begin[hit], end[hit] = np.minimum(begin[hit], start), np.maximum(end[hit], start + SPAN)
            hit = end > 0
            yield pa.RecordBatch.from_arrays([pa.array(own["id"][hit]), pa.array(own["tag"][hit].astype(np.int32)), pa.array(begin[hit]), pa.array(end[hit])], names=OUT[:4])

    fetched = docs.mapInArrow(fetch, SENT_SCHEMA).repartition(parts, "part").sortWithinPartitions("part")
    compared = fetched.mapInArrow(compare, "id long, tag int, begin long, end long")
    return settled.where("word is null").select(*OUT[:4]).unionByName(compared)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Remove each byte covered by a SPAN-byte string that also starts earlier (smaller id, or same document, earlier
    start); overlaps count, and strings are judged on the input.

    Returns id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes, concatenated)
    and, with ``texts``, the remaining bytes. Texts are UTF-8 bytes; a null text is empty. Ids are integers; a null id
    is the smallest. Rows equal in id and text are one document, reported each; rows that share an id alone are
    ordered by a digest of the text. Texts under SPAN bytes are left alone. Empty table: no rows. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    docs = docs.select(key.alias("id"), F.expr(f"cast(xxhash64(`{id_col}`, `{text_col}`) & 65535 as int)").alias("tag"), text.alias("text"), F.col(id_col).alias("given"))
    spans = _spans(docs.select("id", "tag", "text")).groupBy("id", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # bounded by the text's length
    joined = docs.join(spans, ["id", "tag"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = value.as_buffer()
                kept, runs, upto, size = [], 0, 0, len(data)
                last = -1
                for begin, end in sorted((s["begin"], s["end"]) for s in found or ()):
                    if begin > last:
                        runs += 1
                        kept.append(memoryview(data)[upto:begin])
                        last = upto = end
                    elif end > last:
                        last = upto = end
                kept.append(memoryview(data)[upto:])
                rest = b"".join(kept)
                rows.append((size, size - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[4], pa.binary())] * texts, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts])

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return joined.select("given", "text", "spans").mapInArrow(cut, schema)
