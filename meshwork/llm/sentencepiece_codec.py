"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Symbols are merged by a score-ordered agenda of adjacent pairs: the best score first, then the leftmost. No piece of
such a vocabulary holds the space mark after another character, so a text is cut before each run of marks and each
unit is merged by itself and kept in a bounded cache. Every unit that enters the cache, and the first text of each
Arrow batch as a whole, are compared with the sentencepiece library; a difference raises.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: Units in each of the two generations of a worker's cache.
CACHE_UNITS = 300_000
#: Symbols from which a unit's agenda is a heap; a shorter one is a plain list in text order, searched for its best pair.
HEAP_FROM = 40
NEVER = float("inf")


class Codec:
    """Encoder and decoder of one model file, in one Python worker."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a space mark after another character; units can't be encoded apart")
        self.rank = {self.pieces[i]: -library.get_score(i) for i in plain}
        self.id_of = {self.pieces[i]: i for i in plain}
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(n) if library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.spaced, self.decimal = [x.replace(MARK, " ") for x in self.pieces], [str(i) for i in range(n)]
        self.end, self.unknown = library.eos_id(), library.unk_id()
        self.units: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit."""
        symbols = self.merged_in_list(list(unit)) if len(unit) < HEAP_FROM else self.merged_in_heap(list(unit))
        try:
            return [self.id_of[s] for s in symbols]
        except KeyError:
            ids: list[int] = []
            for s in symbols:
                ids += [self.id_of[s]] if s in self.id_of else [self.byte_id.get(b, self.unknown) for b in s.encode()]
            return ids

    def merged_in_list(self, symbols: list[str]) -> list[str]:
        rank = self.rank.get
        agenda = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)  # the leftmost
            symbols[i] = pair = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + pair, NEVER)
            if i < len(agenda):
                agenda[i] = rank(pair + symbols[i + 1], NEVER)
        return symbols

    def merged_in_heap(self, symbols: list[str]) -> list[str]:
        rank = self.rank
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda = []
        for i in range(len(symbols) - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, pair))
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            j = right[i]
            if not symbols[i] or j < 0 or symbols[i] + symbols[j] != pair:
                continue  # one side has been merged since
            symbols[i], symbols[j] = pair, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (further := pair + symbols[k]) in rank:
                    heappush(agenda, (rank[further], i, further))
            if (h := left[i]) >= 0 and (further := symbols[h] + pair) in rank:
                heappush(agenda, (rank[further], h, further))
        return [s for s in symbols if s]

    def text_of(self, ids: list[int]) -> str:
        """Text of a unit's ids, marks as spaces; runs of byte pieces are read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.spaced[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def learn(self, units: set[str]) -> None:
        """Encode units that the cache lacks, each checked against the library."""
        new = []
        for u in units:
            if u in self.older:
                self.units[u] = self.older[u]
            else:
                new.append(u)
        merged = [self.merge(u) for u in new]
        for u, ours, theirs in zip(new, merged, self.library.encode([u[1:].replace(MARK, " ") for u in new], num_threads=1), strict=True):
            if ours != theirs and u != MARK:  # the library gives no ids for an empty text
                raise ValueError(f"{u!r} is encoded as {ours}, by the library as {theirs}")
            self.units[u] = (" ".join([self.decimal[i] for i in ours]), len(ours), self.text_of(ours))

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """Decimal ids joined by spaces (the end id last), their number, and the decoded text."""
        if not text:
            return str(self.end), 1, ""
        units = UNIT.findall(MARK + text.replace(" ", MARK))
        if len(self.units) > CACHE_UNITS:
            self.older, self.units = self.units, {}
        known = self.units
        if new := set(units).difference(known):
            self.learn(new)
        found = [known[u] for u in units]
        ids, counts, parts = zip(*found, strict=True)
        return f"{' '.join(ids)} {self.end}", sum(counts) + 1, "".join(parts)[1:]

    def check(self, text: str | None) -> None:
        """Compare a whole text with the library, both ways."""
        ids, _, decoded = self.encode(text)
        theirs = self.library.encode(text or "") + [self.end]
        if ids != " ".join(map(str, theirs)) or decoded != self.library.decode(theirs):
            raise ValueError(f"a text is encoded or decoded otherwise than by the library: {(text or '')[:80]!r}")


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every whole text with an end id only and no sampling.

    Returns id, n_tokens, ids_sha256 (of decimal ids joined by one space), decoded_sha256; with ``ids``, also the ids
    as text and the decoded text. Null and empty texts give the end id and an empty text. Each row is handled by
    itself: repeated rows give repeated results, an empty table no rows; other columns are dropped. A text is held
    whole by its task. ``model`` must be readable on every executor.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids string, decoded string" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            texts = batch.column(1)
            if len(texts):
                own.check(texts[0].as_py())
            rows = []
            for value in texts:
                found, n, decoded = own.encode(value.as_py())
                rows.append((n, digest(found), digest(decoded), *((found, decoded) if ids else ())))
            out = pd.DataFrame(rows, columns=["n", "a", "b", "c", "d"][: 3 + 2 * ids])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n"], pa.int64()), *(pa.array(out[c], pa.string()) for c in list(out)[1:])],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 4 + 2 * ids],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
