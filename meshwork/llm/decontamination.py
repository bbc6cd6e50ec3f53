"""Benchmark decontamination by a positional inverted index of training tokens. DataFrame functions only.

Words are maximal runs outside ``\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F`` after A-Z are lower-cased, told apart by 64-bit hash.
The index has a row per place of a training word that some test item has: which words these are is decided by a bitmap
of VOCABULARY bits, whose false hits only make the index longer. Each part of the index holds the postings of its own
documents, as they were read: postings are never shuffled, test terms come to them.

A window is ``size`` consecutive words of an item. Its LISTS rarest terms by training count have their posting lists
shifted by the term's place in the window and intersected: what is left are documents and places where the window may
begin. There, and only there, the lists of its other terms are intersected too. Places near a candidate are found with a
second bitmap, so what is shuffled follows the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest terms of a window whose lists are intersected first; bits of the bitmaps, 64 in a row of a broadcast table.
LISTS, VOCABULARY, PLACES = 2, 1 << 20, 1 << 24
#: Places of a document that share a bit.
SPAN = 16


def _words(text: str) -> Column:
    """The words of a text, with an empty one before a leading and after a trailing separator."""
    return F.split(F.translate(F.col(text), UPPER, LOWER), SEPARATORS)


def _bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """(cell, mask): the bits of hashes (column ``hash``), at most ``bits`` / 64 rows."""
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    return staged(hashes.select(F.shiftright(bit, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(hash & 63 as int))").alias("m")).groupBy("cell").agg(F.bit_or("m").alias("mask")), "bitmap")


def _hit(rows: DataFrame, bitmap: DataFrame, bits: int, how: str = "inner") -> tuple[DataFrame, Column]:
    """``rows`` (with ``hash``) beside their cell's mask, and whether their bit is set. The bitmap is small by its size."""
    joined = rows.withColumn("cell", F.shiftright(F.col("hash").bitwiseAND(F.lit(bits - 1)), 6)).join(F.broadcast(bitmap), "cell", how)
    return joined, F.coalesce(F.expr("shiftrightunsigned(mask, cast(hash & 63 as int)) & 1L") == 1, F.lit(False))


def test_terms(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, q, term, need): the words of each item by place from 0; ``need`` is the length of its windows.

    Rows of ``items`` with the same id and words are one item; rows that share an id alone are told apart."""
    words = F.filter(_words(text_col), lambda w: w != "")
    some = items.select(F.col(id_col).alias("item_id"), words.alias("ws")).where("size(ws) > 0").distinct()
    some = some.select(F.xxhash64(F.col("item_id").cast("string"), "ws").alias("item"), "item_id", "ws")
    return some.select("item", "item_id", F.posexplode("ws").alias("q", "w"), F.least(F.size("ws"), F.lit(size)).alias("need")).select("item", "item_id", "q", F.xxhash64("w").alias("term"), "need")


def postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index: (doc, tag, at, term, n_words); ``at`` is a word's place from 0. ``tag`` tells texts under one id apart; ``n_words`` is on one row of each
    row of ``docs`` and null on the others; ``term`` is null on rows that are there for ``n_words`` alone."""
    split = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("tag"), _words(text_col).alias("ws"))
    n = F.size("ws") - (F.element_at("ws", 1) == "").cast("int") - ((F.element_at("ws", -1) == "") & (F.size("ws") > 1)).cast("int")
    places = split.select("doc", "tag", F.when(F.col("ws").isNull(), 0).otherwise(n).alias("n"), (F.element_at("ws", 1) == "").cast("int").alias("lead"), F.posexplode_outer("ws").alias("at", "w"))
    places = places.select("doc", "tag", (F.col("at") - F.col("lead")).alias("at"), F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n")).alias("n_words"), F.when(F.col("w") != "", F.xxhash64("w")).alias("hash"))
    bitmap = _bitmap(terms.select(F.col("term").alias("hash")).distinct(), VOCABULARY)
    joined, hit = _hit(places, bitmap, VOCABULARY, "left")
    return staged(joined.select("doc", "tag", "at", F.when(hit, F.col("hash")).alias("term"), "n_words").where("term is not null or n_words is not null"), "postings")


def _windows(terms: DataFrame) -> DataFrame:
    """(item, w, q, term, need): the places of each window, by its first place ``w``."""
    ends = terms.groupBy("item").agg(F.max("q").alias("last"))
    begin = F.explode(F.sequence(F.greatest(F.col("q") - F.col("need") + 1, F.lit(0)), F.least(F.col("q"), F.col("last") - F.col("need") + 1)))
    return terms.join(ends, "item").select("item", "q", "term", "need", begin.alias("w"))


def _rarest(windows: DataFrame, index: DataFrame, lists: int) -> DataFrame:
    """The ``lists`` rarest terms of each window: (item, w, q, term, need, k), the rarest with k = 0."""
    wanted = windows.select("term").distinct()
    counts = index.where("term is not null").groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term")
    order = Window.partitionBy("item", "w").orderBy(F.coalesce("n", F.lit(0)), "q")  # at most a window's words
    return windows.join(counts, "term", "left").withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < lists).drop("n")


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, matches) of all places where ``size`` consecutive words of an item (all its words, if fewer) occur.

    ``documents`` has (doc, tag, n_words) for every row of ``docs``; ``matches`` has (doc, tag, item, item_id, from, to)
    for each longest run of consecutive words that a text and an item share, from the first to the last word by place
    in the text. Null texts and texts without words match nothing; whole texts of any length are indexed; repeated rows
    have their matches once under their (doc, tag); other columns are ignored; empty tables give no matches.
    """
    terms = staged(test_terms(items, size, item_col, item_text_col), "test-terms")
    index = postings(docs, terms, id_col, text_col)
    windows = staged(_windows(terms), "test-windows")
    rarest = staged(_rarest(windows, index, LISTS), "test-rarest")

    # Offset-adjusted lists: a term at place q of an item and at place ``at`` of a text puts the item at at - q.
    shifted = index.where("term is not null").join(rarest.select("term", "item", "q").distinct(), "term").select("doc", "tag", "item", (F.col("at") - F.col("q")).alias("d"), "q")
    lists = shifted.join(rarest.select("item", "q", "w", "need", "k"), ["item", "q"])
    common = lists.groupBy("doc", "tag", "item", "d", "w").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("found"), F.min(F.least(F.col("need"), F.lit(LISTS))).alias("lists"))
    candidates = common.where("found = shiftleft(1, lists) - 1").select("doc", "tag", "item", "d", "w")
    wanted = candidates.join(windows.select("item", "w", "q", "term"), ["item", "w"]).select("doc", "tag", "item", "d", "q", (F.col("d") + F.col("q")).alias("at"), "term").distinct()
    wanted = staged(wanted, "phrase-places")

    place = F.xxhash64("doc", "tag", F.floor(F.col("at") / SPAN)).alias("hash")
    near, hit = _hit(index.where("term is not null").select("doc", "tag", "at", "term", place), _bitmap(wanted.select(place), PLACES), PLACES)
    near = near.where(hit).select(F.col("doc").alias("doc2"), "tag", "at", "term")
    here = wanted.alias("a").join(near.alias("b"), F.expr("a.doc <=> b.doc2 and a.tag = b.tag and a.at = b.at and a.term = b.term"), "left_semi")
    on = ["doc", "tag", "item", "d"]
    order = Window.partitionBy(*on).orderBy("q")  # at most an item's words
    runs = here.withColumn("run", F.col("q") - F.row_number().over(order)).groupBy(*on, "run").agg(F.min("at").alias("from"), F.max("at").alias("to"))
    names = terms.where("q = 0").select("item", "item_id", "need")
    matches = runs.join(names, "item").where("to - from + 1 >= need").select("doc", "tag", "item", "item_id", "from", "to")
    return index.where("n_words is not null").select("doc", "tag", "n_words"), matches


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside a match), n_items (ids of items with a match),
    items_sha256 (of those ids, sorted as strings, joined by commas), contaminated, item_ids and spans (from, to).

    A null item id counts as an id and isn't in the joined text. Cases as in ``phrase_matches``.
    """
    documents, matches = phrase_matches(docs, items, size, id_col, text_col, item_col, item_text_col)
    per = matches.groupBy("doc", "tag").agg(  # at most a document's matches
        F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"), F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("\0")))).alias("ids")
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["from"] - 1, a["upto"]))).alias("n"), F.greatest(a["upto"], s["to"]).alias("upto"))
    per = per.select(F.col("doc").alias("doc2"), F.col("tag").alias("tag2"), "spans", F.size("ids").alias("n_items"), F.array_remove("ids", "\0").alias("ids"), F.aggregate("spans", start, step)["n"].alias("n_hit"))
    joined = documents.join(per, F.expr("doc <=> doc2 and tag <=> tag2"), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        F.col("doc").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), ids.alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"),
    )


def proximity_matches(docs: DataFrame, items: DataFrame, size: int = 10, within: int = 15, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc, tag, item, item_id, w, from, to): stretches of at most ``within`` words of a text that hold every different
    word of the window that begins at place ``w`` of an item, in any order; for each place of the window's rarest word the
    shortest such stretch around it, the first of equals. Cases as in ``phrase_matches``.

    The rarest term's postings are the candidates; the other terms' postings meet them in blocks of ``within`` places.
    """
    terms = staged(test_terms(items, size, item_col, item_text_col), "test-terms")
    index = postings(docs, terms, id_col, text_col).where("term is not null").select("doc", "tag", "at", "term")
    windows = staged(_windows(terms).groupBy("item", "w", "term").agg(F.min("q").alias("q")), "test-windows")
    rarest = _rarest(windows, index, 1).select("item", "w", "term")
    begin = index.join(rarest, "term").select("doc", "tag", "item", "w", F.col("at").alias("p")).distinct()
    begin = staged(begin, "near-places")
    block = F.floor(F.col("at") / within)
    around = begin.withColumn("block", F.explode(F.array(*[F.floor(F.col("p") / within) + k for k in (-1, 0, 1)])))
    places = index.distinct().select(F.col("doc").alias("doc2"), F.col("tag").alias("tag2"), "at", "term", block.alias("block2"))
    needed = windows.groupBy("item", "w").agg(F.collect_set("term").alias("all"))  # at most a window's words
    met = around.join(needed, ["item", "w"]).join(places, F.expr("doc <=> doc2 and tag = tag2 and block = block2")).where(F.expr(f"abs(at - p) < {within} and array_contains(all, term)"))
    met = met.groupBy("doc", "tag", "item", "w", "p").agg(F.sort_array(F.collect_set(F.struct("at", "term"))).alias("near"), F.first("all").alias("all"))  # at most 2 within - 1 places
    # For each beginning the shortest stretch that has every term and the place p.
    upto = lambda a: F.array_max(F.transform(F.col("all"), lambda t: F.array_min(F.transform(F.filter("near", lambda x: (x["at"] >= a["at"]) & (x["term"] == t)), lambda x: x["at"]))))
    full = lambda a: F.forall("all", lambda t: F.exists("near", lambda x: (x["at"] >= a["at"]) & (x["term"] == t)))
    spans = F.transform(F.filter("near", lambda a: (a["at"] <= F.col("p")) & full(a)), lambda a: F.struct((F.greatest(upto(a), F.col("p")) - a["at"]).alias("length"), a["at"].alias("from")))
    best = met.withColumn("best", F.array_min(spans)).where(F.col("best.length") < within)
    return best.join(terms.where("q = 0").select("item", "item_id"), "item").select("doc", "tag", "item", "item_id", "w", F.col("best.from").alias("from"), (F.col("best.from") + F.col("best.length")).alias("to")).distinct()


#: DuckDB SQL for ``contamination`` with windows of ten words.
ORACLE = r"""
with d as (select doc_id, row_number() over () r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from documents),
i as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from benchmark),
iw as (select distinct item_id, least(10, len(ws)) n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') g from (select *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) s from i where len(ws) > 0)),
dw as (select r, s, n, array_to_string(ws[s:s + n - 1], ' ') g from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) s from d, (select distinct n from iw) where len(ws) >= n)),
m as (select r, s, dw.n, item_id from dw join iw on dw.g = iw.g and dw.n = iw.n),
h as (select r, count(distinct p) n_hit from (select r, unnest(range(s, s + n)) p from m) group by 1),
t as (select r, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct r, item_id::varchar item_id from m) group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit > 0, false) contaminated
from d left join h on h.r = d.r left join t on t.r = d.r"""
