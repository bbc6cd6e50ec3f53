"""Line dedup as an exact set-similarity join. DataFrame functions only.

A line's tokens are its distinct five-word shingles (with fewer words: the whole sequence). Tokens are ordered from
rare to common by the count of their first word in the corpus, which bounds their own, kept in CELLS cells, then by
hash. Two lines of similarity t share a token among the first n - ceil(t n) + 1 of either (prefix filter), their sizes
differ by a factor t at most (length filter), and what follows the shared token must suffice (positional filter). What
is left is verified on whole sets.

A line needs one earlier match only. Equal lines are found by digest; then each line is compared with the earliest
line under each of its prefix tokens; only lines without a match so far are compared with others, a growing block of
earlier lines under each token at a time, and leave at their first match. Before two lines become a pair, the bits in
which their sketches differ must not be more than the tokens in which matches may (bitmap filter): each token turns one bit of a
sketch over, so bits never differ in more places than sets do, and no match is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.skew import with_groups
from meshwork.llm.staging import partitions, staged

WORDS, CELLS = 5, 1 << 14
#: Bits of the bitmap that decides which lines are sent to be compared, 64 in a row of a broadcast table.
BITS = 1 << 24
#: Numbers of 64 bits in a sketch.
SKETCH = 8
#: Earlier lines under a token that are looked at in the first round; each round has so many times more.
BLOCK = 16
#: White space between words other than the space; the line feed ends lines.
OTHER_BLANKS = "\t\x0b\f\r"


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text): tag tells texts under one id apart. White space in the text is spaces and line feeds."""
    text = F.col(text_col)
    some = F.contains(text, F.lit(OTHER_BLANKS[0]))
    for blank in OTHER_BLANKS[1:]:
        some = some | F.contains(text, F.lit(blank))
    plain = F.when(some, F.translate(text, OTHER_BLANKS, " " * len(OTHER_BLANKS))).otherwise(text)
    return docs.select(F.col(id_col).alias("doc"), F.hash(text).alias("tag"), plain.alias("text")).where("doc is not null and text is not null")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, tag, no, line, words) of each line with a word: its words with one space between, and ``line``, their hash."""
    lines = docs.select("doc", "tag", F.posexplode(F.split("text", "\n")).alias("no", "given")).where("btrim(given) != ''")
    apart = F.array_join(F.array_remove(F.split("given", " "), ""), " ")
    words = lines.select("doc", "tag", "no", F.when(F.contains("given", F.lit("  ")), apart).otherwise(F.btrim("given")).alias("words"))
    return words.withColumn("line", F.xxhash64("words"))


def _keys(words: str, rank: Column) -> Column:
    """The tokens of words with one space between as numbers in the common order, sorted: the rank of the first word's cell
    above, 55 bits of the shingle's hash below. ``rank`` is an array of CELLS numbers."""
    hashes = F.transform(F.split(words, " "), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        def token(first: Column, i: Column) -> Column:
            return F.shiftleft(rank[first.bitwiseAND(F.lit(CELLS - 1)).cast("int")], 55).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*[h[i + k] for k in range(WORDS)]), 9))

        runs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WORDS - 1), F.lit(0))), token)
        return F.when(F.size(h) < WORDS, F.array(F.shiftrightunsigned(F.xxhash64(h), 9))).otherwise(runs)

    return F.sort_array(F.array_distinct(F.transform(F.array(hashes), shingles)[0]))


def _rank(docs: DataFrame) -> Column:
    """Rank (0-255, by the logarithm of the count) of each cell of words: CELLS numbers, whatever the corpus."""
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w != ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.count("*").alias("n"))
    ranks = ["0"] * CELLS
    for row in counts.select(F.col("cell").cast("int"), F.least(F.lit(255), F.floor(F.log2("n") * 8)).cast("int").alias("r")).collect():
        ranks[row["cell"]] = str(row["r"])
    return F.split(F.lit(",".join(ranks)), ",").cast("array<bigint>")


def _matches(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (later, earlier) of lines whose whole sets reach the similarity."""
    one = sets.select(F.col("line").alias("later"), F.col("keys").alias("x"))
    two = sets.select(F.col("line").alias("earlier"), F.col("keys").alias("y"))
    sized = pairs.join(one, "later").join(two, "earlier").select("later", "earlier", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("both"))
    return sized.where(f"{den} * shared >= {num} * (both - shared)").select("later", "earlier", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))


def repeated_lines(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that match an earlier line (smaller id, or the same id and earlier line), judged on the input.

    Returns id, line_no (from 0), kind ('equal': the same words; 'near': Jaccard similarity ``num / den`` or more, with
    no equal line before), earlier_id, earlier_line_no (the earliest of the matches found) and similarity. Lines are
    split at ``\\n``; words keep their case; a line without a word matches nothing. Null texts have no lines; rows with
    a null id are left out. Rows that share an id and a text have the same lines, reported once; where texts differ
    under an id, their lines share numbers. Empty table: no rows. Other columns are ignored. Lines are told apart by
    64-bit hash.
    """
    return _repeated(_documents(docs, id_col, text_col), num, den).select(F.col("doc").alias(id_col), "line_no", "kind", F.col("earlier.doc").alias("earlier_id"), F.col("earlier.no").alias("earlier_line_no"), "similarity")


def _repeated(docs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, tag, line_no, kind, earlier, similarity) of ``repeated_lines``; ``earlier`` is a place (doc, no, tag)."""
    lines = _lines(docs)
    rank = _rank(docs)
    place = F.struct("doc", "no", "tag")

    keyed = staged(lines.select("doc", "tag", "no", "line"), "line-keyed")
    total = keyed.count()
    firsts = staged(keyed.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("m")), "line-firsts")
    # A very common line is in many places: these stay where they are, and its first one alone goes on.
    later = with_groups(keyed, firsts.where("m > 1"), ["line"], "m", total).where("found").where(place != F.col("first"))
    later = later.select("doc", "tag", "no", "first").dropDuplicates(["doc", "tag", "no"])
    common = firsts.where(F.col("m") > total / (4 * partitions(docs.sparkSession))).select("line", F.col("first").alias("only"))  # four a partition at most
    once = lines.join(F.broadcast(common), "line", "left").where(F.col("only").isNull() | (place == F.col("only")))

    keys = once.select("line", _keys("words", rank).alias("keys"))
    n = F.size("keys")
    prefix = F.slice("keys", 1, n - F.ceil(n * num / F.lit(den)).cast("int") + 1)
    entries = keys.select("line", n.alias("n"), F.posexplode(prefix).alias("place", "key")).select("key", "line", F.expr("shiftleft(cast(n as bigint), 32) | place").alias("at"))
    under = Window.partitionBy("key")
    shared = entries.withColumns({"low": F.min("line").over(under), "high": F.max("line").over(under)}).where("low != high").select("key", "line", "at").distinct()
    # Place the lines that share a key by their first occurrence; the earliest under a key is the centre of its star.
    shared = shared.join(firsts.select("line", "first"), "line")
    shared = staged(shared.withColumn("centre", F.min(F.struct("first", "line", "at")).over(under)), "line-shared")

    size = lambda at: f"shiftright({at}, 32)"
    rest = lambda at: f"({size(at)} - ({at} & 4294967295L))"
    fits = lambda a, b: f"{den} * least({size(a)}, {size(b)}) >= {num} * greatest({size(a)}, {size(b)})"
    placed = lambda a, b: f"{den + num} * least({rest(a)}, {rest(b)}) >= {num} * ({size(a)} + {size(b)})"

    of = lambda first: F.xxhash64(*[F.col(first)[c] for c in ("doc", "no", "tag")])
    ends = [F.col("line").alias("later"), F.col("centre.line").alias("earlier"), of("first").alias("later_at"), of("centre.first").alias("earlier_at")]
    stars = shared.where("line != centre.line").where(fits("at", "centre.at")).where(placed("at", "centre.at"))
    stars = staged(stars.select(*ends).distinct(), "line-stars")
    wanted = stars.select(F.explode(F.array("later_at", "earlier_at")).alias("at"))
    near = staged(_matches(stars, _sets(docs, wanted, rank), num, den), "line-near")

    near = near.unionByName(_others(docs, shared, near, rank, num, den, of("first"), lambda a, b: f"{fits(a, b)} and {placed(a, b)}"))

    where = firsts.select(F.col("line").alias("l"), "first")
    near = near.join(where.select(F.col("l").alias("earlier"), F.col("first").alias("e")), "earlier")
    near = near.groupBy("later").agg(F.min(F.struct("e", "similarity")).alias("m")).join(where.withColumnRenamed("l", "later"), "later")
    result = lambda d, kind, e, s: [*(F.col(f"{d}{c}") for c in ("doc", "tag")), F.col(f"{d}no").alias("line_no"), F.lit(kind).alias("kind"), F.col(e).alias("earlier"), s.alias("similarity")]
    return later.select(*result("", "equal", "first", F.lit(1.0))).unionByName(near.select(*result("first.", "near", "m.e", F.col("m.similarity"))))


def _others(docs: DataFrame, shared: DataFrame, near: DataFrame, rank: Column, num: int, den: int, place: Column, may: Callable[[str, str], str]) -> DataFrame:
    """Matches (later, earlier, similarity) of lines that aren't in ``near`` with earlier lines other than the centres of their
    tokens, one at least for each line that has any. ``place`` is the hash of a line's place, ``may`` the filter on two columns ``at``."""
    under = Window.partitionBy("key")
    rest = shared.where("line != centre.line").join(near.select("later", F.lit(False).alias("open")).distinct(), F.col("line") == F.col("later"), "left")
    rest = rest.select("key", "line", "at", "first", F.coalesce("open", F.lit(True)).alias("open"))
    rest = rest.withColumns({"nth": F.rank().over(under.orderBy("first")), "last": F.max(F.when(F.col("open"), F.col("first"))).over(under)})
    # A line stays under a token if an open one comes after it there, or if it is open itself and another one comes before it.
    rest = staged(rest.where("first < last or open and nth > 1").select("key", "line", "at", "nth", "open", place.alias("place")), "line-rest")
    most = rest.where("open").agg(F.max("nth")).first()[0] or 0

    sets = _sets(docs, rest.select(F.col("place").alias("at")), rank)
    bits = [F.expr(f"aggregate(filter(keys, k -> shiftright(k, 6) & {SKETCH - 1} = {i}), 0L, (s, k) -> s ^ shiftleft(1L, cast(k & 63 as int)))").alias(f"s{i}") for i in range(SKETCH)]
    drawn = staged(rest.drop("place").join(sets.select("line", *bits), "line"), "line-drawn")
    differ = " + ".join(f"bit_count(s{i} ^ o{i})" for i in range(SKETCH))
    alike = f"{den + num} * ({differ}) <= {den - num} * (shiftright(at, 32) + shiftright(other_at, 32))"
    others = drawn.select("key", F.col("line").alias("earlier"), F.col("nth").alias("other_nth"), F.col("at").alias("other_at"), *[F.col(f"s{i}").alias(f"o{i}") for i in range(SKETCH)])
    waiting, found, begin, end = drawn.where("open").drop("open").withColumnRenamed("line", "later"), near.limit(0), 1, BLOCK
    while begin < most:
        block = others.where((F.col("other_nth") >= begin) & (F.col("other_nth") < end))
        pairs = waiting.where(F.col("nth") > begin).join(block, "key").where("other_nth < nth").where(may("at", "other_at")).where(alike)
        pairs = staged(pairs.select("later", "earlier").distinct(), "line-pairs")
        matches = staged(_matches(pairs, sets, num, den), "line-matches")
        found, waiting = found.unionByName(matches), waiting.join(matches.select("later"), "later", "left_anti")
        begin, end = end, end * BLOCK
    return found


def _sets(docs: DataFrame, places: DataFrame, rank: Column) -> DataFrame:
    """(line, keys): the whole token sets of the lines whose places are hashed in ``places`` (at).

    Texts stay where they are: the wanted places mark a bitmap of a fixed size, lines whose bit is set go on, and of these
    the ones that are wanted are kept. Other lines' words are never hashed.
    """
    wanted = staged(places.select("at").distinct(), "line-wanted")
    cell = F.shiftright(F.col("at").bitwiseAND(F.lit(BITS - 1)), 6)
    marked = wanted.select(cell.alias("cell"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("mask"))
    lines = _lines(docs).withColumn("at", F.xxhash64("doc", "no", "tag")).withColumn("cell", cell).join(F.broadcast(marked), "cell")
    lines = lines.where("shiftright(mask, cast(at & 63 as int)) & 1 = 1").select("at", "line", "words").join(wanted, "at")  # not a semi-join, which would be moved before the bitmap
    return staged(lines.select("line", "words").dropDuplicates(["line"]).select("line", _keys("words", rank).alias("keys")), "line-sets")


def without_repeated_lines(
    docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", drop_emptied: bool = False
) -> DataFrame:
    """``docs`` without the lines of ``repeated_lines``; where present, ``n_chars`` is counted anew.

    Lines go by id and text: texts that share an id each lose their own. Texts without a repeat, null texts and rows
    with a null id are unchanged. A document that loses every line with a word stays with the rest of its text, or goes
    with ``drop_emptied``. Repeated rows fare alike; an empty table has no rows; all columns stay, whatever their names.
    """
    gone = _repeated(_documents(docs, id_col, text_col), num, den).groupBy("doc", "tag").agg(F.collect_set("line_no").alias("gone"))  # at most the document's lines
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.hash(text_col).alias("tag"))
    given = F.col("row")[text_col]
    lines = F.split(given, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), given).otherwise(F.array_join(F.transform(left, lambda i: lines[i]), "\n"))
    out = rows.join(gone, ["doc", "tag"], "left").select("row", F.col("gone").isNotNull().alias("changed"), text.alias("text"))
    if drop_emptied:
        out = out.where(~F.col("changed") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.col("text")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("changed"), F.char_length("text").cast(docs.schema[chars_col].dataType)).otherwise(F.col("row")[chars_col])
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


#: DuckDB SQL for the repeated lines' places.
ORACLE = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) no from documents),
w as (select doc_id, no, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from l),
s as (select doc_id, no, case when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end sh, ws from w where len(ws) > 0),
d as (select min((doc_id, no)) f, ws, any_value(sh) sh from s group by ws),
g as (select f, len(sh) n, unnest(sh) t from d),
near as (select b.f f from g a join g b on a.t = b.t and a.f < b.f group by a.f, b.f, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*)))
select s.doc_id, cast(s.no as int) line_no, case when (s.doc_id, s.no) <> d.f then 'equal' else 'near' end kind
from s join d on s.ws = d.ws where (s.doc_id, s.no) <> d.f or d.f in (select f from near)"""
