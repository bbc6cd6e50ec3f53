"""Operators on documents against brute force on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm import katz_model, license_scan, line_dedup, ngram_join, quality_rules, sentencepiece_codec, sharding, source_mixing, suffix_dedup
from meshwork.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(150)]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 30)))
    shared = line() + " " + line() + " " + line()
    texts: list = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.35:
            text = r.choice(texts) or ""
            for _ in range(r.randint(0, 3)):
                own = text.split(" ")
                own[r.randrange(len(own))] = r.choice(words)
                text = " ".join(own)
        else:
            text = "\n".join([line() for _ in range(r.randint(0, 6))] + [shared] * (kind > 0.8))
        texts.append(text)
    texts += [None, "", "  \t\n", "one", "One TWO three", "one two three", "x " * 4000, "THE!! " * 40, "#$% &|< >*" * 20, "a\n\na\n \nb", "nul \x00 and tab\tend", "▁ marks 😀​"]
    return [(i, t, None if i % 17 == 0 else ["en", "fr"][i % 2], "s", None if t is None else len(t)) for i, t in enumerate(texts)]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with extra columns whose names operators use inside."""
    names = ["id", "n", "gram", "kept", "n_words", "shard", "size", "rate", "component_id", "stratum", "digest", "tag", "spans", "mix_n", "words", "line", "held", "score", "base_failed", "rejected_by", "mix_copies"]
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i % 6 == 0 else 1, 1 if i % 10 == 3 else 0) for i in range(0, 70)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(text, k):
    w = words(text, True)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups(n, linked):
    root = {i: i for i in n}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (2, 2), (7, None), (8, 9), *((100 + i, 101 + i) for i in range(40))]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80)])
def test_ngram_join(docs, clashing, size, num):
    sets = {d[0]: shingles(d[1], size) for d in DOCS}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = groups(sets, linked)
    assert len(set(want.values())) < len(want)
    for frame in (docs, clashing):
        got = ngram_join.similar(frame, size=size, num=num)
        assert {r[0]: (r[1], r[2]) for r in got.collect()} == {i: (len(sets[i]), want[i]) for i in sets}
    kept = ngram_join.one_of_each(docs, size=size, num=num)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == set(want.values())


def test_ngram_join_of_star_and_hot_groups(spark):
    """Copies that are near an original but not each other, and many texts under one common passage."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(60):
        own = base[:]
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = f"e{i}"
        texts.append(" ".join(own))
    texts += [" ".join([*base[:40], *(f"u{i}-{k}" for k in range(30))]) for i in range(60)]
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=4, num=85)
    assert {x[0]: x[2] for x in got.collect()} == groups(sets, linked)


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None), (2, t + " x")], "doc_id long, text string")
    assert sorted((r[0] or -1, r[1], r[2] or -1) for r in ngram_join.similar(frame, size=4, num=85).collect()) == [(-1, 0, -1), (-1, 27, 1), (1, 27, 1), (1, 27, 1), (2, 28, 1)]
    assert ngram_join.one_of_each(frame, size=4, num=85).count() == 3
    assert sharding.byte_shards(frame, 2).count() == 5
    assert suffix_dedup.without_repeats(frame).count() == 5
    assert quality_rules.kept_documents(frame.withColumn("lang", F.lit("en")), spark.createDataFrame([], "doc_id long, quality int")).count() == 4


def counts(text):
    text = text or ""
    w = words(text)
    windows: dict = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_quality_rules(docs, clashing, labels, spark):
    for frame in (docs, clashing):
        found = quality_rules.judged(frame, labels)
        got = {r["doc_id"]: r for r in found.collect()}
        for i, text, *_ in DOCS:
            want = counts(text)
            assert tuple(got[i][c] for c in quality_rules.COUNTS[:5]) == want
            assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert got[i]["kept"] <= (not got[i]["base_failed"])
    assert all(r["kept"] != r["base_failed"] for r in got.values())  # too few labels to certify a rule
    assert quality_rules.judged(docs.limit(0), labels).count() == 0
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got.values())


def test_risk_control(spark):
    """Enough labels certify a rule that parts good from bad, and the false rejections stay within the risk."""
    good = [(i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(40)), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(f"W{(i + k) % 997}!!" for k in range(40)), "en") for i in range(200)]
    few = [(9000 + i, " ".join(f"v{k}!" for k in range(40)), "xx") for i in range(30)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d[0], 1) for d in good + few] + [(d[0], 0) for d in bad], "doc_id long, quality int")
    docs = docs.withColumns({c: F.lit("x") for c in ("cut_symbols", "N_WORDS", "end_marks", "row", "id", "Stratum")})
    assert quality_rules.kept_documents(docs, labels).columns == docs.columns
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, labels).collect()}
    assert not any(kept[d[0]] for d in bad)
    assert sum(not kept[d[0]] for d in good) <= 0.02 * len(good)
    assert all(kept[d[0]] for d in few)  # a stratum without enough labels rejects nothing


def test_verdicts_against_plain_counting(spark):
    """The whole verdict again from ratios of whole texts: paths tuned on other strata, one test a step, copies counted once."""
    from fractions import Fraction

    r = random.Random(30)
    plain = lambda: " ".join(f"w{r.randrange(4000)}" + r.choice(["", "", "", ".", "!", "#"][: r.choice([1, 4, 6])]) for _ in range(r.randint(20, 60)))
    rows = [(i, plain(), r.choice(["en", "fr", None])) for i in range(1500)]
    rows += [(2000 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(400)]  # copies of a few good texts
    rows += [(3000 + i, " ".join(f"#{r.randrange(99)}%" for _ in range(40)), r.choice(["en", "fr"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    quality = {i: 0 if i >= 3000 or i % 9 == 0 else 1 for i, *_ in rows if i % 8}
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality_rules.judged(docs, labels).collect()}
    steps, rules = quality_rules.STEPS, quality_rules.RULES

    def rungs(x, rule):
        ratio, ladder = rules[rule]
        above, below = (eval(side, {}, x.asDict()) for side in ratio.split(" / "))  # noqa: S307
        return sum(above / below > c for c in ladder) if below else 0

    good: dict = {}
    for i, text, lang in rows:
        if quality.get(i) == 1 and not got[i]["base_failed"]:
            good.setdefault(lang, {})[text] = {rule: rungs(got[i], rule) for rule in rules}
    assert sum(map(len, good.values())) < sum(quality.get(i) == 1 and not got[i]["base_failed"] for i, *_ in rows)
    policy = {}
    for lang, own in good.items():
        others = [x for k, texts in good.items() if k != lang for x in texts.values()]
        ends = {rule: sum(sum(x[rule] > steps - rung for x in others) <= Fraction("0.01") / len(rules) * len(others) for rung in range(1, steps + 1)) for rule in rules}
        hit = lambda x, step, ends=ends: [rule for rule in rules if (cut := math.ceil(step * ends[rule] / steps)) and x[rule] > steps - cut]
        step, n = 0, len(own)
        while step < steps:
            wrong = sum(bool(hit(x, step + 1)) for x in own.values())
            chance = sum(Fraction(math.comb(n, k)) * Fraction(1, 50) ** k * Fraction(49, 50) ** (n - k) for k in range(wrong + 1))
            if chance > Fraction(5, 100) / len(good):
                break
            step += 1
        policy[lang] = hit, step
    assert any(step for _, step in policy.values())
    for i, _, lang in rows:
        hit, step = policy.get(lang, (None, 0))
        want = ["base"] if got[i]["base_failed"] else hit({rule: rungs(got[i], rule) for rule in rules}, step) if step else []
        assert sorted(got[i]["rejected_by"]) == sorted(want) and got[i]["kept"] == (not want), (i, want)


def test_certified_steps_against_exact_sums():
    """The last step whose chance of so few errors, were the risk exceeded, is small enough; in exact fractions."""
    from fractions import Fraction
    from math import comb

    def below(k, n, p):
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    r = random.Random(3)
    for _ in range(60):
        n, strata = r.choice([0, 50, 217, 300, 900]), r.choice([1, 4])
        wrong = {r.randint(1, 13): r.choice([0, 0, 1, 2, 5]) for _ in range(4)}
        step = 0
        while step < 12 and below(sum(v for k, v in wrong.items() if k <= step + 1), n, Fraction(2, 100)) <= Fraction(5, 100) / strata:
            step += 1
        assert quality_rules.certified(wrong, n, strata, 0.02, 0.05) == step


def test_rules_decide_in_every_stratum(spark):
    """On real labels each language certifies a policy that rejects what the base keeps, and few good documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    cuts = {r["stratum"]: r for r in quality_rules.cutoffs(docs, labels).collect()}
    found = quality_rules.judged(docs, labels).join(labels, "doc_id", "left")
    texts = found.where("not base_failed and quality = 1").select("doc_id", "lang").join(docs.select("doc_id", "text"), "doc_id").groupBy("lang").agg(F.countDistinct("text").alias("n"))
    texts = {r["lang"]: r["n"] for r in texts.collect()}
    by = found.where("not base_failed").groupBy("lang").agg(F.count_if(~F.col("kept")).alias("rejected"), F.count_if((F.col("quality") == 1) & ~F.col("kept")).alias("wrong"), F.count_if(F.col("quality") == 1).alias("good"))
    for r in by.collect():
        assert cuts[r["lang"]]["step"] > 0 and cuts[r["lang"]]["n_good"] == texts[r["lang"]] <= r["good"] and r["rejected"] > 0 and r["wrong"] <= 0.02 * r["good"], r


def test_sharding(docs, clashing):
    for frame, shards in ((docs, 4), (clashing, 16)):
        got = sorted(sharding.byte_shards(frame, shards).collect())
        sizes = {d[0]: len((d[1] or "").encode()) + 1 for d in DOCS}
        total, upto, slots = sum(sizes.values()), 0, {}
        for r, (i, text, *_) in zip(got, DOCS, strict=True):
            shard = (2 * upto + sizes[i]) * shards // (2 * total)
            upto += sizes[i]
            assert tuple(r) == (i, sizes[i], zlib.crc32((text or "").encode()), "bytes", shard, slots.get(shard, 0), None)
            slots[shard] = slots.get(shard, 0) + 1
    assert sharding.byte_shards(docs.limit(0)).count() == 0


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                m[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out[i] = (len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, clashing, spark, monkeypatch):
    r = random.Random(3)
    base = ["".join(r.choice("abc ") for _ in range(r.choice([90, 150, 400, 900]))) for _ in range(12)]
    rows = [(i, "".join(r.choice(base)[r.randrange(100) :][: r.randrange(60, 500)] for _ in range(r.randrange(5)))) for i in range(50)]
    rows += [(100, None), (101, ""), (102, "a" * 5000), (103, "ab" * 900), (104, "a" * 99), (105, "é" * 200), (106, "\x00" * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_removed(rows)
    assert {x[0]: tuple(x)[1:] for x in suffix_dedup.without_repeats(frame).collect()} == want
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)  # long texts in parts
    assert {x[0]: tuple(x)[1:] for x in suffix_dedup.without_repeats(frame).collect()} == want
    want = brute_removed([d[:2] for d in DOCS])
    assert {x[0]: tuple(x)[1:] for x in suffix_dedup.without_repeats(clashing).collect()} == want
    kept = {x["doc_id"]: bytes(x["kept"]) for x in suffix_dedup.without_repeats(docs, texts=True).collect()}
    assert all(hashlib.sha256(kept[i]).hexdigest() == want[i][3] for i in want)
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def brute_lines(rows, num=80):
    lines = [((i, k), words(x)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if words(x)]
    sets = {at: {tuple(w)} if len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for at, w in lines}
    by = dict(lines)
    out = {}
    for at in sorted(sets):
        earlier = [e for e in sets if e < at]
        if any(by[e] == by[at] for e in earlier):
            out[at] = "equal"
        elif any(100 * len(sets[e] & sets[at]) >= num * len(sets[e] | sets[at]) for e in earlier):
            out[at] = "near"
    return out


def test_line_dedup(docs, clashing, spark):
    r = random.Random(8)
    long = [" ".join(f"w{r.randrange(300)}" for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(3):
            w = r.choice(long).split(" ")
            for _ in range(r.randint(0, 2)):
                w[r.randrange(60)] = f"x{r.randrange(50)}"
            own.append(" ".join(w))
        rows.append((i, "\n".join(own)))
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x[0], x[1]): x[2] for x in got.collect()} == brute_lines(rows)
    want = brute_lines([d[:2] for d in DOCS])
    for frame in (docs, clashing):
        assert {(x[0], x[1]): x[2] for x in line_dedup.repeated_lines(frame).collect()} == want
    left = line_dedup.without_repeated_lines(docs)
    assert left.columns == docs.columns
    for x in left.collect():
        text = DOCS[x["doc_id"]][1]
        kept = None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if (x["doc_id"], k) not in want)
        assert x["text"] == kept and x["n_chars"] == (None if kept is None else len(kept))
    assert line_dedup.repeated_lines(docs.limit(0)).count() == 0


def test_lines_of_texts_that_share_an_id(spark):
    """Each text under an id loses its own lines; documents without a line left go if asked; odd columns stay."""
    rows = [(1, "a b c\nd e f"), (2, "new one\nd\te f"), (2, "other\nlast of it"), (3, "a b  c"), (3, " \n"), (None, "a b c"), (4, None), (2, "new one\nd\te f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone": F.lit("x"), "Row": F.lit("y"), "TAG": F.lit("z")})
    got = line_dedup.without_repeated_lines(frame)
    assert got.columns == frame.columns
    texts = [(1, "a b c\nd e f"), (2, "new one"), (2, "other\nlast of it"), (3, ""), (3, " \n"), (None, "a b c"), (4, None), (2, "new one")]
    key = lambda x: (x[0] or 0, x[1] or "")
    assert sorted([tuple(r[:2]) for r in got.collect()], key=key) == sorted(texts, key=key)
    assert {r["gone"] + r["Row"] + r["TAG"] for r in got.collect()} == {"xyz"}
    left = line_dedup.without_repeated_lines(frame, drop_emptied=True).collect()
    assert sorted([tuple(r[:2]) for r in left], key=key) == sorted([x for x in texts if x != (3, "")], key=key)


def test_common_lines_stay_in_place(spark):
    """A line that holds a third of all rows, and near copies of it, with many partitions."""
    line = " ".join(f"w{k}" for k in range(40))
    rows = [(i, line if i % 3 == 0 else line + f" v{i}" if i % 3 == 1 else f"only {i} of its kind here now") for i in range(300)]
    want = brute_lines(rows)
    assert {(x[0], x[1]): x[2] for x in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()} == want


def test_lines_that_share_a_passage_make_few_pairs(spark, monkeypatch):
    """Hundreds of unlike lines under common tokens are not all paired; matches in far blocks under a token are found."""
    r = random.Random(5)
    shared = " ".join(f"p{k}" for k in range(22))
    own = lambda: " ".join(f"r{r.randrange(8)}" for _ in range(30))
    lines = [f"{shared} {own()}" for _ in range(400)]
    for k in (30, 150, 290, 390):  # near copies of lines that are no token's first
        w = lines[k].split(" ")
        w[-2] = "changed"
        lines.append(" ".join(w))
    counts = []

    def counted(frame, name, staged=line_dedup.staged):
        out = staged(frame, name)
        if name == "line-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "staged", counted)
    rows = list(enumerate(lines))
    got = {(x[0], x[1]): x[2] for x in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) and {(400 + i, 0) for i in range(4)} <= set(got)
    assert sum(counts) < 4 * len(rows)


def test_license_scan(spark, docs, clashing):
    mit = license_scan.KNOWN["MIT"]
    rows = [(1, mit), (2, mit.upper().replace("COPYRIGHT (C) <YEAR> <HOLDER>", "Copyright 2020 Someone\n(c) 2021 Other")), (3, mit.replace("sublicense", "sub-license").replace('"', "'")), (4, mit + " more"), (5, None), (6, ""), (7, "©"), (8, mit)]
    known = license_scan.known_licenses(spark)
    got = {r["doc_id"]: r for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert {i: r["license_id"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: "MIT"}
    assert got[5]["digest"] is None and got[5]["canonical_bytes"] is None and got[6]["canonical_bytes"] == got[7]["canonical_bytes"] == 0
    assert license_scan.scanned(clashing, known).count() == len(DOCS) and license_scan.scanned(docs.limit(0), known).count() == 0
    texts = spark.createDataFrame([(k, v) for k, v in license_scan.KNOWN.items()], "doc_id string, text string")
    assert all(r["license_id"] == r["doc_id"] for r in license_scan.scanned(texts, known).collect())


def test_license_canonical_forms(spark):
    """Spellings at ends and next to each other, phrases of two words, and lines that only begin with "copyright"."""
    same = [("licence agreement", "License, agreement"), ("the licence licence", "THE LICENSE LICENSE"), ("sub-licence", "sublicense"), ("copyright owner", "copyright holder"), ("per cent licence", "percent license")]
    rows = [t for pair in same for t in pair]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(license_scan.canonical(F.col("t"))).collect()]
    assert got[::2] == got[1::2] and got[0] == "license agreement" and got[2] == "the license license"
    import textwrap

    for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT"):  # hard-wrapped at every width, with lines that begin with "copyright notice"
        text = license_scan.KNOWN[name]
        head, rest = text.split("\n\n", 1)
        wrapped = [(w, "\n\n".join([head, *(textwrap.fill(p, w) for p in rest.split("\n\n"))])) for w in range(30, 90)]
        found = license_scan.scanned(spark.createDataFrame(wrapped, "doc_id int, text string"), license_scan.known_licenses(spark)).collect()
        assert all(r["license_id"] == name for r in found)


def test_license_files(spark, tmp_path):
    """Whole licences planted among documents are found by a table read from files."""
    texts = {f"L-{k}": "\n".join(f"{k} clause {i}, the licence; words {i * k % 17}" for i in range(2000)) for k in range(5)}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    docs = [(i, f"some document {i}") for i in range(20)] + [(100 + i, "Copyright 2019 A. Holder\n" + t.upper().replace("LICENCE", "license")) for i, t in enumerate(texts.values())]
    found = license_scan.scanned(spark.createDataFrame(docs, "doc_id int, text string"), license_scan.license_files(spark, str(tmp_path))).collect()
    assert {r["doc_id"]: r["license_id"] for r in found if r["license_id"]} == {100 + i: name for i, name in enumerate(texts)}


MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_sentencepiece(docs, clashing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for frame in (docs, clashing):
        got = {r["doc_id"]: r for r in sentencepiece_codec.encoded(frame, MODEL, ids=True).collect()}
        for i, text, *_ in DOCS:
            ids = library.encode(text or "") + [library.eos_id()]
            joined = " ".join(map(str, ids))
            decoded = library.decode(ids)
            assert got[i]["ids"] == joined and got[i]["decoded"] == decoded and got[i]["n_tokens"] == len(ids)
            assert got[i]["ids_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert sentencepiece_codec.encoded(docs.limit(0), MODEL).count() == 0


def test_sentencepiece_agendas_agree():
    own = sentencepiece_codec.Codec(MODEL)
    r = random.Random(4)
    for _ in range(400):
        unit = list("▁" + "".join(r.choice("abeinorst▁éß<0") for _ in range(r.randint(0, 50))))
        assert own.merged_in_list(unit[:]) == own.merged_in_heap(unit[:])
    for size in (0, 1, 5000):
        own.check("".join(r.choice(["the ", "a", "\n", "é", "  ", "😀"]) for _ in range(size)))
    with pytest.raises(ValueError):
        own.rank = {}
        own.units, own.older = {}, {}
        own.check("checking differences between them")


def test_source_mixing(docs, clashing, labels, spark):
    got = source_mixing.decisions(docs, labels).collect()
    names = sorted(source_mixing.TARGETS)
    assert len(got) == len(DOCS)
    p = np.array([[r[f"p_{d}"] for d in names] for r in got])
    n, rate = np.array([r["n_tokens"] for r in got]), np.array([r["rate"] for r in got])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d[0]: len(words(d[1])) for d in DOCS}
    # The same projected steps in numpy from the same posteriors.
    t0 = n @ p
    target = np.array([source_mixing.TARGETS[d] for d in names])
    wanted = target / target.max() * t0[target.argmax()]
    inverse = np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-9, hermitian=True)
    x = np.ones(len(n))
    for _ in range(200):
        x = np.maximum(0, x - p @ (inverse @ ((x * n) @ p - wanted)))
    assert np.allclose((rate * n) @ p, (x * n) @ p, rtol=1e-3)
    assert np.abs((rate * n) @ p - wanted).sum() <= np.abs(t0 - wanted).sum()
    copies = {r["doc_id"]: r["copies"] for r in got}
    mixed = source_mixing.mixed(docs, labels)
    assert mixed.columns == docs.columns
    assert {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
    assert source_mixing.decisions(clashing, labels).count() == len(DOCS)
    odd = docs.withColumns({"Mix_n": F.lit("x"), "MIX_P": F.lit("y"), "row": F.lit(1), "mix_copy": F.lit(2)})
    again = source_mixing.mixed(odd, labels)
    assert again.columns == odd.columns and again.where("Mix_n = 'x' and MIX_P = 'y' and row = 1").count() == sum(copies.values())
    assert source_mixing.decisions(docs.limit(0), labels).count() == 0
    assert source_mixing.decisions(docs, labels.limit(0)).count() == len(DOCS)


def test_mixing_posteriors(docs, labels, spark):
    """Naive Bayes over cells of words, in plain Python; documents with several labels take the smallest domain."""
    found = {r["doc_id"]: r for r in source_mixing.decisions(docs, labels).collect()}
    own = {i: words(t) for i, t, *_ in DOCS}
    every = sorted({w for ws in own.values() for w in ws})
    cell = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.pmod(F.hash("w"), F.lit(source_mixing.CELLS))).collect()}
    names = sorted(source_mixing.TARGETS)
    domain: dict = {}
    for i, quality, toxic in [tuple(r) for r in labels.collect()]:
        if i in own and quality is not None:
            d = "toxic" if toxic == 1 else "low" if quality == 0 else "clean"
            domain[i] = min(d, domain.get(i, d))
    counts = np.ones((3, source_mixing.CELLS))
    for i, d in domain.items():
        for w in own[i]:
            counts[names.index(d), cell[w]] += 1
    prior = np.array([sum(x == d for x in domain.values()) + 0.5 for d in names])
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    for i, ws in own.items():
        s = np.log(prior / prior.sum()) + sum((logs[:, cell[w]] for w in ws), np.zeros(3))
        p = np.exp(s - s.max())
        assert np.allclose(p / p.sum(), [found[i][f"p_{d}"] for d in names], atol=2e-5)


def test_mixing_optimum(spark):
    """Targets are met where they can be, with domains of a tenth of their target; elsewhere the rates are optimal."""
    r = np.random.default_rng(5)
    p = r.dirichlet([0.6, 0.03, 0.03], 400)
    n = r.integers(1, 60, 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "mix_n long, mix_p array<double>")
    for target, reached in (([0.6, 0.3, 0.1], True), ([0.99, 0.001, 0.009], None)):
        rate = np.array([x[0] for x in members.select(source_mixing.rates(source_mixing.solved(members, target))).collect()])
        got = np.array([tuple(x) for x in members.select("mix_n", *[F.col("mix_p")[i] for i in range(3)]).collect()])
        k, q = got[:, 0], got[:, 1:]
        wanted = np.array(target) / max(target) * (k @ q)[int(np.argmax(target))]
        off = (rate * k) @ q - wanted
        gradient = q @ np.linalg.inv((q * k[:, None]).T @ q) @ off  # of half the squared residual, a token
        assert (rate >= 0).all() and np.abs(rate - np.maximum(0, rate - gradient)).max() < 1e-5
        assert not reached or (np.abs(off) / wanted).max() < 1e-4


def test_mixing_accuracy(spark):
    """Held-out accuracy of the classifier, and totals on target."""
    r = random.Random(2)
    vocabulary = {"clean": [f"c{i}" for i in range(50)], "low": [f"l{i}" for i in range(50)], "toxic": [f"t{i}" for i in range(50)]}
    rows, truth = [], {}
    for i in range(600):
        kind = r.choices(["clean", "low", "toxic"], [0.6, 0.25, 0.15])[0]
        truth[i] = kind
        rows.append((i, " ".join(r.choice(vocabulary[kind] if r.random() < 0.7 else [f"z{k}" for k in range(50)]) for _ in range(30))))
    labels = [(i, 0 if truth[i] == "low" else 1, int(truth[i] == "toxic")) for i in range(300)]
    found = source_mixing.decisions(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [x for x in found if x["doc_id"] >= 300]
    right = sum(max(source_mixing.TARGETS, key=lambda d: x[f"p_{d}"]) == truth[x["doc_id"]] for x in held)
    assert right / len(held) > 0.95
    totals = {d: sum(x["rate"] * x["n_tokens"] * x[f"p_{d}"] for x in found) for d in source_mixing.TARGETS}
    assert all(abs(totals[d] / sum(totals.values()) - w) < 0.01 for d, w in source_mixing.TARGETS.items())


def katz_discounts(n):
    """Discount of each count from counts of counts: Katz's formula up to 5, a power law fitted up to 64 elsewhere."""
    import numpy as np

    r = [k for k in range(1, 65) if n[k]]
    slope = -1.1
    if len(r) > 1:
        z = [n[k] / ((r[i + 1] if i + 1 < len(r) else 2 * k - r[i - 1]) - (r[i - 1] if i else 0)) * 2 for i, k in enumerate(r)]
        slope = min(slope, np.polyfit(np.log(r), np.log(z), 1)[0])
    over = 6 * n[6] / n[1] if n[1] else 1

    def discount(k):
        if k <= 5 and n[k] and over < 1 and 0 < ((k + 1) * n[k + 1] / (k * n[k]) - over) / (1 - over) < 1:
            return ((k + 1) * n[k + 1] / (k * n[k]) - over) / (1 - over)
        return (1 + 1 / k) ** (slope + 1)

    return discount


def katz_brute(rows):
    """(held, tokens, counts, chance of b after a) in plain Python."""
    from collections import Counter

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*words(t, True), None] for i, t in rows}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total = sum(c.values())
    pairs = Counter((a, b) for i, t in tokens.items() if not held[i] for a, b in zip(["START", *t], t, strict=False))
    of_pairs, of_words = katz_discounts(Counter(pairs.values())), katz_discounts(Counter(c.values()))
    new = 1 - sum(of_words(n) * n for n in c.values()) / total if total else 1.0
    uni = lambda w: of_words(c[w]) * c[w] / total if w in c else new
    after: dict = {}
    for (a, b), m in pairs.items():
        after.setdefault(a, {})[b] = m

    def chance(a, b):
        if a not in after:
            return uni(b)
        m = sum(after[a].values())
        if b in after[a]:
            return of_pairs(after[a][b]) * after[a][b] / m
        return sum((1 - of_pairs(r)) * r for r in after[a].values()) / m / (1 - sum(uni(x) for x in after[a])) * uni(b)

    return held, tokens, c, chance


def katz_agrees(found, rows):
    from math import log10

    held, tokens, c, chance = katz_brute(rows)
    total, v = sum(c.values()), len(c)
    assert len(found) == len(rows)
    for r in found:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(w in c for w in t), total)
        assert abs(r["base_score"] - sum(log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in t)) < 1e-6 * len(t)
        assert abs(r["score"] - sum(log10(chance(a, b)) for a, b in zip(["START", *t], t, strict=False))) < 1e-6 * len(t)
    return c, chance


def test_katz_scores(docs, clashing, spark):
    rows = [(d[0], d[1]) for d in DOCS]
    for frame in (docs, clashing):
        c, chance = katz_agrees(katz_model.scored(frame).collect(), rows)
    for a in ["START", None, *list(c)[:30]]:  # every context sums to one over all words and the new one
        assert abs(sum(chance(a, b) for b in [*c, "NEW"]) - 1) < 1e-9
    assert katz_model.scored(docs.limit(0)).count() == 0
    alone = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 10 == 0]  # nothing to learn from
    katz_agrees(katz_model.scored(docs.where(F.col("doc_id").isin([i for i, _ in alone]))).collect(), alone)


def test_katz_hot_words_and_small_blocks(spark, monkeypatch):
    """Several blocks, words spelled out, words dealt to several parts, and a pair that fills a part."""
    r = random.Random(4)
    rows = [(i, " ".join(["of the"] * r.randint(0, 40) + [f"w{int(r.paretovariate(0.4))}" for _ in range(r.randint(0, 60))])) for i in range(400)]
    monkeypatch.setattr(katz_model, "COMMON", 6)
    monkeypatch.setattr(katz_model, "SAMPLE", 2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first = katz_model.scored(frame).collect()
    katz_agrees(first, rows)
    monkeypatch.undo()
    assert sorted(first) == sorted(katz_model.scored(frame.coalesce(1)).collect())


def test_katz_scores_of_very_long_texts(spark):
    """Sums of millions of tokens, known and new, against the formula of the base score and the words' own chance."""
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0]
    taught = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10 != 0]
    n = 3_000_000
    long = spark.createDataFrame([(held[0], "new"), (held[1], "known")], "doc_id long, kind string")
    words = F.when(F.col("kind") == "new", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("u"), F.hex(i))), " ")).otherwise(F.repeat(F.lit("x "), n))
    rows = long.select("doc_id", words.alias("text")).unionByName(spark.createDataFrame([(taught[0], "x " * 1_000_001), (taught[1], "x y")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in katz_model.scored(rows).collect()}
    total, distinct = 1_000_001 + 1 + 2 + 1, 3
    base = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    new, known = got[held[0]], got[held[1]]
    assert (new["n_tokens"], new["n_known"], known["n_known"], new["train_tokens"]) == (n + 1, 1, n + 1, total)
    assert new["base_score"] == pytest.approx(n * base(0) + base(2), abs=1e-6 * n) and known["base_score"] == pytest.approx(n * base(1_000_002) + base(2), abs=1e-6 * n)
    assert new["score"] < -5 * n and -n < known["score"] < 0
    one = {r["doc_id"]: r["score"] for r in katz_model.scored(rows.where(F.col("doc_id") != held[0]).unionByName(spark.createDataFrame([(held[0], "ua ub uc")], "doc_id long, text string"))).collect()}[held[0]]
    few = {r["doc_id"]: r["score"] for r in katz_model.scored(rows.where(F.col("doc_id") != held[0]).unionByName(spark.createDataFrame([(held[0], "ua ub")], "doc_id long, text string"))).collect()}[held[0]]
    assert new["score"] == pytest.approx(one + (n - 3) * (one - few), rel=1e-9)  # each new word after a new word adds the same


def test_multikey_quicksort():
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 300):
        x = r.integers(0, 2, (n, 100)).astype(np.uint8)
        x[:, :97] = 7
        rows = [row.tobytes() for row in x]
        assert set(suffix_dedup.repeats(x).tolist()) == {i for i, row in enumerate(rows) if row in rows[:i]}
    tokens = r.integers(0, 3, (500, 4)).astype(np.uint64)
    order, new = suffix_dedup.multikey_quicksort(tokens)
    ranked = [tuple(tokens[i]) for i in order]
    assert ranked == sorted(map(tuple, tokens.tolist())) and new.tolist() == [i == 0 or ranked[i] != ranked[i - 1] for i in range(500)]
