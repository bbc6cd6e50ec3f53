"""Hard negatives, spelling variants and decontamination against brute force, with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meshwork.llm import decontamination, hard_negatives, queries, spelling_variants


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Hard negatives


def brute_negatives(rows, anchor=lambda i: i % 4 == 0):
    some = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in some:
        if not anchor(a[0]):
            continue
        others = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in some if b != a and len(b[2]) == len(a[2]))
        for ps, pid, _ in [o for o in others if o[2] == a[1]][:5]:
            fits = [o for o in others if o[2] != a[1] and 80 * -ps <= 100 * -o[0] <= 100 * -ps][:5]
            out += [(a[0], pid, k, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(fits, 1)]
    return sorted(out)


def vector_rows(seed, n=240, width=6, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, r.randrange(4), [c + r.gauss(0, spread) for c in r.choice(centres)]) for i in range(n)]
    rows += [(n + i, r.randrange(4), list(rows[i][2])) for i in range(20)]  # equal vectors: ties
    rows += [(n + 40 + i, 1, [1.0] * width) for i in range(30)]
    odd = [(900, None, [1.0] * width), (901, 1, None), (902, 1, [None] + [1.0] * (width - 1)), (904, 1, [math.inf] * width), (908, 2, [math.nan] * width), (None, 1, [1.0] * width)]
    odd += [(912, 1, [0.0] * width), (916, 2, []), (917, 2, []), (920, 1, [1.0, 2.0]), (921, 2, [1.0, 1.9]), (924, 1, [1.0, 2.1]), (n + 40, 1, [1.0] * width), (4, 3, [0.5] * width)]
    return rows + odd


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("seed,width,spread", [(1, 6, 1.0), (2, 3, 0.2)])
def test_hard_negatives(spark, monkeypatch, seed, width, spread):
    for name, small in (("PAGE", 16), ("BLOCK", 7), ("SHARE", 2), ("PIVOTS", 9)):
        monkeypatch.setattr(hard_negatives, name, small)
    rows = vector_rows(seed, width=width, spread=spread)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "key", "q", "norm", "pivot", "dist", "t")}).repartition(5)
    got = hard_negatives.hard_negatives(hard_negatives.quantized(frame, "vec_id", F.col("label"), "embedding"), F.col("id") % 4 == 0).collect()
    want = brute_negatives(rows)
    assert len(want) > 100 and sorted(map(tuple, got)) == want


def test_large_components_are_exact(spark):
    r = random.Random(5)
    rows = [(i, i % 2, [float(r.randrange(1 << 20)) + r.random() for _ in range(3)]) for i in range(60)]
    got = hard_negatives.hard_negatives(hard_negatives.quantized(spark.createDataFrame(rows, SCHEMA), "vec_id", F.col("label"), "embedding"), F.col("id") % 4 == 0).collect()
    assert got and sorted(map(tuple, got)) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    for frame in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], SCHEMA)):
        assert hard_negatives.hard_negatives(hard_negatives.quantized(frame, "vec_id", F.col("label"), "embedding"), F.col("id") % 4 == 0).count() == 0


# Spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_variants(rows, every):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    n = {w: c for w, c in n.items() if c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in links.items():
        if vs and n[best := min(vs, key=lambda v: (-n[v], [ord(c) for c in v]))] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(links[w]), n.get(form.get(w))) for w in n}


def spelling_rows(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abéz") for _ in range(r.randint(5, 9))) for _ in range(60)] + ["common" + "".join(r.choice("abcd") for _ in range(4)) for _ in range(60)] + ["z" * 5, "z" * 6, "a" * 40, "a" * 41, "a" * 20 + "b" + "a" * 20]
    changed = []
    for w in base:
        for _ in range(3):
            k = r.randrange(len(w))
            changed.append(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abéz") + w[k + 1 :], w[:k] + r.choice("abéz") + w[k:]]))
    words = base * 4 + changed * 2
    rows = [(i, " ".join(r.choice([str.upper, str, str.title])(r.choice(words)) + r.choice(["", ",", "1", "ß", "ÿ×"]) for _ in range(r.randint(0, 120)))) for i in range(60)]
    return rows + [(None, "Words words WORDS wordz"), (70, None), (71, ""), (72, "1 2 3"), (73, "wor\0ds words"), (73, "words words words"), (73, "words words words"), (74, "longer " * 30_000), (75, "x" * 300_000)]


@pytest.mark.parametrize("every", [97, 3])
def test_variants(spark, every):
    rows = spelling_rows(every)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "run", "size", "h", "doc", "form")}).repartition(4)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants.variants(docs, every).collect()}
    want = brute_variants(rows, every)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] != v[0] for w, v in want.items() if v[0])  # some forms have forms


def test_variants_of_nothing(spark):
    assert spelling_variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall(lowered(text))


def brute_contamination(docs, items, size=10):
    out = []
    for doc, text in docs:
        ws, hit, found = plain(text), set(), set()
        places = {}
        for i, w in enumerate(ws):
            places.setdefault(w, []).append(i)
        for item, t in items:
            iw = plain(t)
            k = min(size, len(iw))
            for w in {tuple(iw[s : s + k]) for s in range(len(iw) - k + 1)} if iw else ():
                for i in places.get(w[0], ()):
                    if tuple(ws[i : i + k]) == w:
                        hit |= set(range(i, i + k))
                        found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaking(seed):
    r = random.Random(seed)
    words = ["The", "of", "a", "É", "é", "été", "x1", "9"] + ["".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(12)]
    join = lambda ws: "".join(w + r.choice([" ", ", ", "\n", "--", "_", "`"]) for w in ws)
    some = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, join(some(r.choice([1, 2, 9, 10, 11, 30])))) for i in range(25)] + [(100, None), (101, ""), (102, "?!"), (3, "another text of the third"), (103, "the the the the the the the the the the the"), (None, "no name has this one"), (104, "of a"), (104, "of a")]
    docs = []
    for i in range(60):
        parts = [some(r.randint(0, 12)) for _ in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 3)):
            own = plain(r.choice(items)[1])
            cut = r.randrange(len(own)) if own else 0
            parts.append(own[cut:] if r.random() < 0.3 else own)
        r.shuffle(parts)
        docs.append((i, r.choice(["", " ", "\t"]) + join(sum(parts, []))))
    docs += [(200, None), (201, ""), (202, " .. "), (203, "word"), (204, "the " * 50_000), (205, "no name has this one"), (205, "no name has this one"), (205, "other"), (None, "of a"), (206, "x" * 400_000 + " of a")]
    return docs, items


def frames(spark, docs, items):
    more = {c: F.lit("x") for c in ("doc", "tag", "at", "term", "item", "ws", "n_hit", "hash", "cell", "q")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(more).repartition(4), spark.createDataFrame(items, "item_id long, text string").withColumns(more)


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed):
    docs, items = leaking(seed)
    got = decontamination.contamination(*frames(spark, docs, items)).drop("item_ids", "spans").collect()
    want = brute_contamination(docs, items)
    assert sorted(map(tuple, got), key=str) == want
    assert 5 < sum(w[5] for w in want) < len(want) and any(0 < w[2] < w[1] for w in want)


def test_contamination_with_crowded_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "VOCABULARY", 64)
    monkeypatch.setattr(decontamination, "PLACES", 128)
    docs, items = leaking(3)
    got = decontamination.contamination(*frames(spark, docs, items)).drop("item_ids", "spans").collect()
    assert sorted(map(tuple, got), key=str) == brute_contamination(docs, items)


def test_contamination_of_nothing(spark):
    docs, items = frames(spark, *leaking(1))
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    got = decontamination.contamination(docs, items.limit(0)).collect()
    assert len(got) == docs.count() and not any(r["contaminated"] for r in got) and {r["items_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_proximity(spark):
    docs, items = leaking(4)
    docs = [d for d in docs if d[0] not in (204, None)]
    got = decontamination.proximity_matches(*frames(spark, docs, items), size=4, within=7).select("doc", "item_id", "w", "from", "to").collect()
    stretches: dict = {}
    for r in got:
        stretches.setdefault((r["doc"], r["item_id"]), set()).add((r["from"], r["to"]))
    found = set()
    for doc, text in docs:
        ws = plain(text)
        for item, t in items:
            iw = plain(t)
            k = min(4, len(iw))
            for s in range(len(iw) - k + 1 if iw else 0):
                need = set(iw[s : s + k])
                if any(need <= set(ws[i : i + 7]) for i in range(len(ws))):
                    found.add((doc, item))
    assert set(stretches) == found and found
    text = {d: plain(t) for d, t in docs if d != 205}
    for (doc, item), spans in stretches.items():
        for a, b in spans if doc in text else ():
            assert b - a < 7 and any(set(plain(t)[s : s + min(4, len(plain(t)))]) <= set(text[doc][a : b + 1]) for i, t in items if i == item for s in range(max(1, len(plain(t)) - 3)))


def test_new_queries_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    assert queries.op12_spelling_variants(spark, folder).where("form is not null").count() > 0
    assert queries.op13_decontamination(spark, folder).where("contaminated").count() > 0
    assert queries.op11_hard_negatives(spark, folder).count() > 0
