"""Each document operator against brute force, an exact round trip or held-out accuracy, with the awkward rows in."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import bpe, components, decontaminate, licenses, lm, omh, shards, simhash, textkernel, toxicity, urlrep, warc
from strandloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fingerprint string, key long"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts():
    r = random.Random(7)
    words = ["the", "Of", "inor", "THon", "été", "ñandú", "日本", "x1", "lo-wer", "a"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = make(200)
    near = base.replace("inor", "Inor").split(" ")
    near[17] = "changed"
    out = [None, "", " \n\t ", "one", "two words", make(6), base, base, " ".join(near), base + " tail", "q" * 700, make(5000)]
    return out + [make(r.randint(1, 60)) for _ in range(25)] + ["dupe of this text here"] * 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "x", "y", 1) for i, t in enumerate(texts())]
    rows += [(3, "one", "en", "s", 0, "x", "y", 1), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def simhash_of(text, k=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_components(docs, none):
    rows = docs.select("doc_id", "text").collect()
    prints = [simhash_of(r.text) for r in rows]
    group = linked(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {g: min((r.doc_id for r, h in zip(rows, group) if h == g and r.doc_id is not None), default=None) for g in group}
    want = Counter((r.doc_id, p, least[g]) for r, p, g in zip(rows, prints, group))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def shingles_of(text, k=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def test_similar_texts_keep_one_of_each_group(docs, none):
    """All pairs by brute force: five-word shingles, a similarity of 0.8."""
    r = random.Random(11)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    base = [f"w{r.randrange(4000)}" for _ in range(300)]
    for i in range(150):  # copies with up to 14 changed words: on both sides of 0.8
        words = list(base)
        for _ in range(r.randint(0, 14)):
            words[r.randrange(300)] = f"c{r.randrange(4000)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[:20] + [f"o{r.randrange(4000)}" for _ in range(60)])) for i in range(40)]  # only a passage is shared
    spark = docs.sparkSession
    named = sorted({(i, t) for i, t in rows if i is not None})
    sets = [shingles_of(t) for _, t in named]
    want = linked(sets, similar)
    kept = sorted({named[i][0] for i in want})
    frame = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 1) for i, t in rows], DOCS).repartition(5)
    found = {x.id: x.least for x in simhash.similar_groups(frame, slab=16).collect()}
    assert found == {named[i][0]: named[j][0] for i, j in enumerate(want)}
    out = simhash.keep_one(frame)
    assert out.columns == docs.columns
    assert Counter(x.doc_id for x in out.collect()) == Counter([*kept, None])
    assert simhash.keep_one(none).count() == 0


def test_rows_of_the_similarity_join_grow_with_a_group(spark, monkeypatch):
    """A group of near copies: linked ones, ones with many words of their own, some that are just apart, and copies of copies."""
    grouped, counts = simhash._grouped, []

    def counted(rows, *order):
        counts[-1] += rows.count()
        return grouped(rows, *order)

    monkeypatch.setattr(simhash, "_grouped", counted)
    for n in (100, 200):
        r = random.Random(n)
        base = [f"w{i}" for i in range(300)]

        def copy(words, changes, low=150):
            words = list(words)
            for at in r.sample(range(low, low + 144, 6), changes):
                words[at] = f"c{r.randrange(10**9)}"
            return words

        rows = [copy(base, 2, 6) for _ in range(n)] + [copy(base, 7) for _ in range(n)] + [copy(base, 5) for _ in range(10)]
        rows += [copy(rows[n + i], 1) for i in range(5)]
        r.shuffle(rows)
        texts = [" ".join(x) for x in rows]
        want = linked([shingles_of(t) for t in texts], similar)
        assert len(set(want)) == n + 11
        counts.append(0)
        found = {x.id: x.least for x in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), slab=16).collect()}
        assert found == dict(enumerate(want))
    assert counts[1] <= 2.5 * counts[0], counts


@pytest.mark.parametrize("radius", [1, 3, 5, 6])
def test_bit_sliced_comparison(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**63, 40).astype(np.uint64)
    prints = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)])
    run = np.sort(r.integers(0, 5, len(prints)))
    got = {(int(a), int(b)) for x, y in simhash.close_pairs(prints, run, radius) for a, b in zip(x, y)}
    want = {(i, j) for j in range(len(prints)) for i in range(j) if run[i] == run[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}
    assert got == want


def test_links_of_a_hot_key_are_whole(spark):
    """Prints that share a key many times over, with slabs of four."""
    r = random.Random(3)
    prints = sorted({(r.randrange(2**9) << 3) | r.randrange(8) for _ in range(300)})
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), 3, slab=4)
    got = {r.node: r.root for r in components.components(found, Scratch(spark, "t")).collect()}
    want = linked(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert [got.get(p, p) for p in prints] == [prints[i] for i in want]


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(100, 160)] + [(7, 7), (5, 4)]
    r.shuffle(edges)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in [*range(100, 160), 1000]}}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_bpe_is_the_library_s(docs, none):
    ranks = bpe.read_ranks(open(VOCABULARY, "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = own.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), (r.text or "").encode()] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(none, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces_at_random():
    ranks = bpe.read_ranks(open(VOCABULARY, "rb").read())
    codec, r = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(5)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for n in (1, 3, 8, 20, 60, 3000):
        for _ in range(300 if n < 3000 else 2):
            x = "".join(r.choice("aeinrsthl éß日😀\n0.") if n % 2 else r.choice(["the", "tion", "qu", "en", "s", "z", "ß"]) for _ in range(n))
            ids = codec.encode(x)
            assert list(memoryview(ids).cast("I")) == own.encode_ordinary(x)
            assert codec.decode(ids) == x.encode()
    for _ in range(3000):  # white space of all kinds and lengths, at both ends, too
        x = "".join(r.choice(["the", "It's", " ", " ", "  ", "\n", "\t", " \n ", "\u00a0", "42", "...", "é", "'ll"]) for _ in range(r.randrange(14)))
        assert list(memoryview(codec.encode(x)).cast("I")) == own.encode_ordinary(x), x


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)) if w]


def test_decontamination(spark, none):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 14, 30, 60, 60)] + [None, "", "..."]
    edited = items[3].split(" ")
    edited[30] = "other"
    worse = items[4].split(" ")
    worse[10] = worse[30] = worse[50] = "other"
    noise = lambda: " ".join(word() for _ in range(40))
    found = [items[1] + ". " + noise(), noise() + "\n" + items[2].upper() + " " + noise(), noise() + " " + " ".join(edited), items[0], items[3][:250]]
    rows = [(i, t) for i, t in enumerate([None, "", noise(), *found, noise() + " " + " ".join(worse), items[1] + " " + items[1], noise() + " " + items[3] + " " + noise()])]
    rows += [rows[3], (None, items[2])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, item string")

    def brute(text):
        w, out = words_of(text), {}
        for n, item in enumerate(items):
            v = words_of(item)
            k = min(5, len(v))
            if not k or not w:
                continue
            b = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                x = w[s : s + len(v)]
                a = Counter(tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1)))
                same = sum((a & b).values()) / sum((a | b).values())
                if same >= 0.8 and same > out.get(n, (0, 0))[0]:
                    out[n] = same, s
        return out

    want = Counter((i, n, s, round(x, 9)) for i, t in rows for n, (x, s) in brute(t).items())
    assert want.total() >= 8
    for block in (8 << 20, 300):
        got = decontaminate.leaks(docs, bench, block_bytes=block).collect()
        assert Counter((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in got) == want
        kept = decontaminate.without_leaks(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns
        assert Counter(r.text for r in kept.collect()) == Counter(t for i, t in rows if not brute(t))
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_in_small_pieces(spark, monkeypatch):
    """Postings, windows and candidates are taken piece by piece; repetitive texts and items that all share a passage."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 5)))
    common = [word() for _ in range(12)]
    items = [common + [word() for _ in range(8)] for _ in range(40)] + [["la"] * 20, ["la", "lo"] * 10]
    texts = [common * 30, ["la"] * 300, ["la", "lo"] * 200, [word() for _ in range(50)] + items[3] + items[17], items[5][:-1] + [word()], [], common]
    encoded = [" ".join(w).encode() for w in texts]
    index = decontaminate.Index(list(range(len(items))), [" ".join(w).encode() for w in items], 5, 0.8, 23)
    whole = index.search(encoded)
    assert {(d, i) for d, i, *_ in whole} >= {(3, 3), (3, 17), (1, 40), (2, 41), (4, 5)}
    for name, value in (("_POSTINGS", 60), ("_CELLS", 40), ("_WINDOWS", 3)):
        monkeypatch.setattr(decontaminate, name, value)
    assert index.search(encoded) == whole


def test_decontamination_finds_parts_in_another_order(spark):
    """All windows by brute force, for items whose halves are swapped or whose beginning stands at the end."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    items = [[word() for _ in range(n)] for n in (60, 100, 100)] + [[r.choice(["ab", "cd"]) for _ in range(40)]]
    swapped = [w[len(w) // cut :] + w[: len(w) // cut] for w, cut in zip(items, (2, 2, 3, 2))]
    noise = lambda n: [word() for _ in range(n)]
    rows = [noise(200) + w + noise(200) for w in swapped] + [swapped[0] + noise(9), noise(9) + swapped[1], swapped[2], swapped[0][4:], [*items[0], *swapped[0], *items[1]], ["ab"] * 90, noise(150)]

    def brute(w):
        out = {}
        for n, v in enumerate(items):
            b = Counter(tuple(v[i : i + 5]) for i in range(len(v) - 4))
            for s in range(max(1, len(w) - len(v) + 1)):
                x = w[s : s + len(v)]
                a = Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
                same = sum((a & b).values()) / sum((a | b).values())
                if same >= 0.8 and same > out.get(n, (0, 0))[0]:
                    out[n] = same, s
        return out

    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    want = Counter((i, n, s, round(x, 9)) for i, w in enumerate(rows) for n, (x, s) in brute(w).items())
    assert {(0, 0), (1, 1), (2, 2)} <= {k[:2] for k in want}
    got = decontaminate.leaks(docs, bench).collect()
    assert Counter((x.doc_id, x.item_id, x.first_word, round(x.similarity, 9)) for x in got) == want
    assert decontaminate.without_leaks(docs, bench).count() == len(rows) - len({k[0] for k in want})


def test_levenshtein_automaton():
    terms = [("idiot", False), ("worthless", False), ("lowei", True), ("scum", False)]
    matcher, r = toxicity.Matcher(terms), random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(3000):
        word = list(r.choice(terms)[0] + r.choice(["", "", "s", "sch"]))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(word) + 1)
            word[at : at + r.randint(0, 1)] = [r.choice("idotwersl1")] * r.randint(0, 1)
        word = "".join(word)
        want = []
        for n, (t, stem) in enumerate(terms):
            best = min(distance(word[:i], t) for i in (range(len(word) + 1) if stem else [len(word)]))
            if best <= toxicity.edits(t):
                want.append((n, best))
        assert matcher.find(word) == tuple(want), word


def test_toxicity_held_out_and_quotation(spark, none):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeghiklmn") for _ in range(r.randint(3, 7)))
    rows, labels = [(900, None), (901, ""), (None, "nobody"), (902, "a " * 30_000)], [(901, None), (None, 1)]
    for i in range(600):
        bad = i % 4 == 0
        w = [word() for _ in range(30)]
        if bad:
            w[r.randrange(30)] = r.choice(["pathetic", "worthless", "snorfle" + word()])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(903, "you are a pathitic man"), (904, 'they said the word "pathetic" in a lesson'), rows[10]]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, id string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    score, out = {x.doc_id: x.score for x in got}, {x.doc_id for x in known.where(toxicity.held_out()).collect()}
    right = [(score[i] >= 0.5) == bool(t) for i, t in labels if i in out and t is not None]
    assert len(right) > 80 and sum(right) >= 0.97 * len(right)
    assert score[900] == score[901] < 0.5 and score[902] < 0.5
    assert score[904] < 0.5 <= score[903]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x.score < 0.5 for x in got)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, known.limit(0))).where("score >= 0.5").count() == 0


LICENSED = [
    None, "", "MIT", "The MIT license, the mit License; Apache License, Version 2.0",
    "Licensed under the Apache License, Version 2.0.", "gnu general public license version 3 or later", "GNU Lesser General Public License v2.1",
    "Licensed under CC BY-NC 4.0.", "cc by", "Released under the MIT License.", "Copyright (c) 2019 x. All rights reserved.", "SPDX-License-Identifier: BSD-3-Clause",
    "mit  \n license" * 3, "MÍT license mit licenseé", " mit license" * 700 + " general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy",
]


def test_license_scan(spark, none):
    all_rules = licenses.rules()
    assert len(all_rules) > 200

    def brute(text):
        w = words_of(text)
        norm = " " + "".join(x + " " for x in w)
        found = []
        for rank, r in enumerate(all_rules):
            if all(k in norm for k in r.keys):
                for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", norm):
                    start = norm[: m.start()].count(" ") - 1
                    found.append((start, start + m[0].count(" ") + 1, r.priority, rank, r.label, r.base))
        found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
        kept = []
        if len(found) <= 100:
            kept = [d for i, d in enumerate(found) if not any(e[0] <= d[0] and d[1] <= e[1] and e[2] >= d[2] for e in found[:i])]
        else:
            reach = [-1] * 5
            for d in found:
                if max(reach[d[2] :]) < d[1]:
                    kept.append(d)
                reach[d[2]] = max(reach[d[2]], d[1])
        base = [d for d in found if d[5]]
        starts = [d[0] for d in base]
        best = max((d[2] for d in kept), default=0)
        join = lambda x: ",".join(sorted(set(x)))
        return len(w), len(base), min(starts, default=None), max(starts, default=None), join(d[4] for d in base), join(d[4] for d in base + kept), [0.0, 0.4, 0.7, 0.9, 1.0][best]

    rows = list(enumerate(LICENSED + texts())) + [(3, LICENSED[3]), (None, LICENSED[4])]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, labels string")
    got = licenses.summary(licenses.scan(docs))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter((i, *brute(t)) for i, t in rows)
    label = {r.doc_id: r.labels for r in got.collect()}
    assert label[7] == "cc-by-nc" and label[6] == "gpl,lgpl" or label[6] == "lgpl,gpl"
    assert licenses.scan(none).count() == 0


def example(pattern, last):
    """A text that a pattern matches: optional parts left out, or in; of alternatives the first, or the last."""

    def made(tree):
        out = ""
        for op, value in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(value)
            elif name == "IN":
                out += chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])
            elif name == "NOT_LITERAL":
                out += "x"
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += made(value[2]) * (min(value[1], max(value[0], 1)) if last else value[0])
            elif name == "SUBPATTERN":
                out += made(value[3])
            elif name == "BRANCH":
                out += made(value[1][-1 if last else 0])
            else:
                raise AssertionError(name)
        return out

    return made(re._parser.parse(pattern))


def test_every_license_rule_finds_its_example(spark):
    """Each rule's own words, short and long, are detected by it: its keys and pattern fit each other."""
    rules = licenses.rules()
    assert len({r.label for r in rules}) > 70 and len(licenses.SIGNATURES) > 100
    rows = [(n, k, f"Intro; {example(r.pattern, k).upper()}. Outro") for n, r in enumerate(rules) for k in (False, True)]
    docs = spark.createDataFrame([(f"{n} {k}", t) for n, k, t in rows], "doc_id string, text string").repartition(4)
    found = {r.doc_id: {d.rank for d in r.found} for r in licenses.scan(docs).collect()}
    assert [(n, k, t) for n, k, t in rows if n not in found[f"{n} {k}"]] == []


def test_license_names_in_all_their_spellings(spark):
    want = [
        ("Internet Systems Consortium License", "isc"),
        ("ISC license", "isc"),
        ("NCSA license", "ncsa"),
        ("licensed under the NCSA license", "ncsa"),
        ("University of Illinois/NCSA Open Source License", "ncsa"),
        ("University of Illinois NCSA license", "ncsa"),
        ("released under NCSA open source", "ncsa"),
        ("Consortium license of Illinois", ""),
    ]
    docs = spark.createDataFrame(list(enumerate(t for t, _ in want)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.summary(licenses.scan(docs)).collect()} == dict(enumerate(x for _, x in want))


def test_order_minhash(spark, none):
    bodies = texts()[3:] + ["a b c d e f g h i j", "f g h i j a b c d e", "a b c d e f g h i j"]
    rows = [(i * 3, t) for i, t in enumerate(bodies)] + [(500, None), (501, ""), (501, "tie"), (None, "no id")]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, key string").repartition(3)
    line = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    edited = Counter()
    for n, (i, t) in enumerate(line):
        after = line[(n + 1) % len(line)][1]
        half = len(t) // 2
        edited[None if i < 0 else i, len(t), t[: len(t) - half] + after[:half]] += 1
    for bucket in (2000, 3):
        got = omh.edited_fingerprints(docs, bucket_rows=bucket)
        assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
        got = got.collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_text) for r in got) == edited
    text, by = dict(rows), defaultdict(set)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by[r.edited_text].add(r.edited_fingerprint)
        if r.doc_id is not None and r.doc_id != 501:
            by[text[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values())
    assert omh.edited_fingerprints(none).count() == 0
    assert omh.edited_fingerprints(docs.where("doc_id = 0")).first().near_next == 1.0


def test_order_minhash_signature_is_as_defined(spark):
    """Against the definition, with Spark's hash of the parts; repeats are numbered, order counts."""
    r = random.Random(9)
    bodies = [" ".join(r.choice("abcde") for _ in range(n)) for n in (1, 2, 3, 4, 10, 40, 200)]
    sig = {x.text: x.s for x in spark.createDataFrame([(b,) for b in bodies], "text string").select("text", omh.signature(F.col("text"), 3, 4, 2).alias("s")).collect()}

    def hashes(columns, kinds):
        names = [f"c{i}" for i in range(len(kinds))]
        frame = spark.createDataFrame([(n, *c) for n, c in enumerate(columns)], "n long, " + ", ".join(f"{a} {k}" for a, k in zip(names, kinds)))
        return [x.h & (2**64 - 1) for x in frame.select("n", F.xxhash64(*names).alias("h")).orderBy("n").collect()]

    for body in bodies:
        w = body.split()
        runs = [(w + [None, None])[i : i + 3] for i in range(max(1, len(w) - 2))]
        kmers = [h >> 31 for h in hashes(runs, ["string"] * 3)]
        seen, numbered = Counter(), []
        for k in kmers:
            numbered.append((k, seen[k]))
            seen[k] += 1
        g = sorted((h >> 31, i) for i, h in enumerate(hashes(numbered, ["long", "int"])))
        for b in range(4):
            on = [x for x in g if x[0] >> 31 >= b]
            mine = sorted((on + g)[: min(2, len(g))], key=lambda x: x[1])
            assert sig[body][b] & (2**64 - 1) == hashes([[[x[0] for x in mine]]], ["array<long>"])[0]


def test_order_minhash_likeness_by_brute_force(spark):
    """What ``near_edited`` and ``near_next`` are, from the signatures of both texts; and ids that are no numbers."""
    r = random.Random(3)
    rows = [(f"k{i // 3}-{i}é", " ".join(r.choice("abcdefgh") for _ in range(r.randrange(30)))) for i in range(40)] + [(None, "x y z w"), ("k1-3é", "tie")]
    frame = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    line = sorted(rows, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1]))
    next_ = [line[(n + 1) % len(line)][1] for n in range(len(line))]
    edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for (_, t), a in zip(line, next_)]
    every = spark.createDataFrame([(t,) for t in {*(t for _, t in rows), *edited}], "text string")
    sig = {x.text: x.s for x in every.select("text", omh.signature(F.col("text")).alias("s")).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / 32 if any(x is not None for x in sig[a] + sig[b]) else 1.0
    want = Counter((i, e, like(t, e), like(t, a)) for (i, t), e, a in zip(line, edited, next_))
    for bucket in (2000, 3):
        got = omh.edited_fingerprints(frame, bucket_rows=bucket).collect()
        assert Counter((x.doc_id, x.edited_text, x.near_edited, x.near_next) for x in got) == want


def test_warc_round_trip(spark):
    big, other = "<p>é" * 60, "x" * 99
    rows = [(5, "http://a/x", big), (2, "u\r\nInjected: 1", big), (9, None, big), (9, None, big), (1, "", other), (3, "b", other), (4, "c", None), (6, "d", "\r\n\r\nWARC/1.1\r\n" * 20), (None, "e", big), (7, "f", "y" * 100)]
    pages = spark.createDataFrame([(*x, "k") for x in rows], "page_id long, url string, html string, digest string").repartition(3)
    scratch = Scratch(spark, "t")
    folder = scratch.path("archive")
    warc.write(pages, folder)
    got = warc.read(spark, folder)
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        least = min(j for j, _, g in rows if (g or "").encode() == data and j is not None)
        revisit = len(data) >= 100 and i != least
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None] += 1
    assert Counter(tuple(r) for r in warc.summary(got).collect()) == want
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in rows})
    records = sorted(bytes(r.record) for r in got.collect())
    for r in records:
        head, _, rest = r.partition(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == size + 4 and rest.endswith(b"\r\n\r\n") and b"\nInjected" not in head
    files = scratch.path("files")
    warc.export(spark, folder, files)
    whole = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(files).collect())
    back = []
    while whole:  # as a WARC reader does
        head, _, rest = whole.partition(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        back.append(head + b"\r\n\r\n" + rest[: size + 4])
        whole = rest[size + 4 :]
    assert sorted(back) == records
    empty = scratch.path("archive")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_damage_is_found(spark):
    folder = Scratch(spark, "t").path("archive")
    warc.write(spark.createDataFrame([(1, "u", "v" * 200)], "page_id long, url string, html string"), folder)
    spark.createDataFrame([(hashlib.sha256(b"v" * 200).hexdigest(), b"w" * 200)], "digest string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, folder).collect()


def test_feistel_slots():
    for n in (1, 2, 3, 17, 1000, 65537):
        a, b = shards.slots(np.arange(n), n, 1), shards.slots(np.arange(n), n, 2)
        assert sorted(a) == list(range(n)) == sorted(b)
        assert n < 17 or (a != b).any()


def test_training_shards(spark, docs, none):
    folder = Scratch(spark, "t").path("shards")
    write = lambda d, f, **how: shards.write(d, f, 5, VOCABULARY, public_tokenizers.PATTERN, **how)
    index = write(docs, folder, length=64, rows=16)
    about = shards.manifest(spark, folder)
    read = dict(shards.read(folder, about))  # all is there before the index is looked at
    rows = sorted(index.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(about["sequences"])) and len(rows) > 64
    assert len(read) == about["sequences"]
    assert [s for s, _ in shards.read(folder, about, 5, 30)] == list(range(5, 35))
    ranks = bpe.read_ranks(open(VOCABULARY, "rb").read())
    eos, pad, dtype = max(ranks.values()) + 1, max(ranks.values()) + 2, "<u2"
    assert (about["eos"], about["pad"], about["dtype"]) == (eos, pad, dtype)
    for r in rows:
        data = read[r.slot]
        assert (r.shard, r.row, r.n_tokens) == (r.slot // 16, r.slot % 16, len(data))
        assert hashlib.sha256(np.concatenate((data, np.full(64 - len(data), pad, dtype))).tobytes()).hexdigest() == r.sha256
    place = {int(s): i for i, s in enumerate(shards.slots(np.arange(len(rows)), len(rows), 5))}
    stream = np.concatenate([read[s] for s in sorted(read, key=place.get)])
    found = [tuple(x[:-1].tolist()) for x in np.split(stream, np.flatnonzero(stream == eos) + 1)[:-1]]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(found) == Counter(tuple(own.encode_ordinary(r.text or "")) for r in docs.select("text").collect())
    assert {i for r in rows for i in r.ids} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert write(none, Scratch(spark, "t").path("shards")).count() == 0


def test_training_shards_of_long_streams(spark, monkeypatch):
    """Streams that are handed on in parts give the same sequences."""
    texts = spark.createDataFrame([(i, "the quick one " * (i * 37 % 200)) for i in range(50)], "doc_id long, text string").coalesce(1)
    write = lambda f: shards.write(texts, f, 5, VOCABULARY, public_tokenizers.PATTERN, length=32, rows=8)
    whole = {tuple(r) for r in write(Scratch(spark, "t").path("a")).select("slot", "sha256").collect()}
    cut = shards._cut
    monkeypatch.setattr(shards, "_FLUSH", 500)
    tokens = [(([i], [np.arange(i * 13 % 700, dtype="<u2")])) for i in range(60)]
    parts = [b for b, _ in cut(iter(tokens), 32, 9, "<u2")]
    monkeypatch.undo()
    one = [b for b, _ in cut(iter(tokens), 32, 9, "<u2")]
    assert len(parts) > 3 and len(one) == 1 and (np.concatenate(parts) == one[0]).all()
    assert len(whole) > 100


def test_lm_scores(docs, none, spark, monkeypatch):
    """Both models by their definition, each document without its own counts; small blocks and parts, and the usual ones."""
    target = spark.createDataFrame([(6,), (9,), (9,), (3,), (None,)], "doc_id long")
    rows = [(r.doc_id, words_of(r.text)) for r in docs.select("doc_id", "text").collect()]
    follows = lambda ws: list(zip(["^", *ws], ws))
    aims = {6, 9, 3}
    count = {k: Counter(w for i, ws in rows if k or i in aims for w in [*ws, *["^"] * bool(ws)]) for k in (0, 1)}
    pairs = {k: Counter(p for i, ws in rows if k or i in aims for p in follows(ws)) for k in (0, 1)}
    scale = count[0].total() / count[1].total()
    assert max(pairs[1].values()) > 2 and 1 in pairs[1].values()
    want = defaultdict(list)
    for i, ws in rows:
        means = []
        for k, r in ((0, 1.0), (1, scale)):
            own, two = (Counter([*ws, "^"]), Counter(follows(ws))) if k or i in aims else (Counter(), Counter())
            rate = lambda w: (r * (count[k][w] - own[w]) + 1) / (r * (count[k].total() - own.total()) + len(count[1]))  # noqa: E731, B023
            p = lambda v, w: (r * (pairs[k][v, w] - two[v, w]) + 4 * rate(w)) / (r * (count[k][v] - own[v]) + 4)  # noqa: E731, B023
            means.append(np.mean([-np.log(p(v, w)) for v, w in follows(ws)]) if ws else 0.0)
        want[i, len(ws)].append((*means, means[0] - means[1]))
    for small in (True, False):
        if small:
            monkeypatch.setattr(lm, "_BLOCK_BYTES", 3000)
            monkeypatch.setattr(lm, "_PART", 500)
        else:
            monkeypatch.undo()
        got = defaultdict(list)
        for r in lm.score(docs, target, strength=4.0).collect():
            got[r.doc_id, r.n_tokens].append((r.target_loss, r.background_loss, r.score))
        assert {k: sorted(v) for k, v in got.items()} == {k: [pytest.approx(x) for x in sorted(v)] for k, v in want.items()}
    assert lm.score(none, target).count() == 0
    assert lm.score(docs, target.limit(0)).count() == len(rows)


def test_lm_tells_repeated_documents_apart(spark):
    """What stands in two documents costs less under the background than what stands in one."""
    r = random.Random(4)
    make = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(200))
    rows = [(i, make()) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    loss = {x.doc_id: x.background_loss for x in lm.score(frame, spark.createDataFrame([(i,) for i in range(40)], "doc_id long")).collect()}
    assert max(loss[i] for i in (*range(20), *range(100, 120))) < min(loss[i] for i in range(20, 60)) - 3


def test_url_filter(spark):
    from strandloom.llm.registry import URL_RULES

    urls = [None, "", "no scheme", "http://A.Example.COM/en/1?x", "http://www.example.com/en/", "https://example.com/de/", "http://com", "x://net/es/1", "http://a.net/fr", "http://a.net/fr/#f", "http://notexample.com/en/1", "http://h://x/en/", "http://bad.org/1", "http://bad.org/2", "http://new.bad.org/", "http://good.org/\n/2", "http://É.org/A"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(3, urls[3], "k"), (None, urls[4], "k")], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("bad.org", 1)] * 60 + [("good.org", 0)] * 60 + [("x.net", None), (None, 1)], "host string, bad int")
    got = urlrep.judge(pages, URL_RULES, outcomes).collect()
    assert len(got) == len(urls) + 2

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
        return lower(host), path

    for r in got:
        host, path = split(urls[r.page_id] if r.page_id is not None else urls[4])
        fits = [(x, v) for v, x in URL_RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict in (None, r.verdict)
    by = {r.page_id: r for r in got}
    assert by[12].verdict == by[13].verdict == "block" and by[15].verdict == by[0].verdict == "allow"
    assert by[15].reputation < by[16].reputation < by[12].reputation
    assert urlrep.judge(pages.limit(0), URL_RULES, outcomes).count() == 0
    assert urlrep.judge(pages, URL_RULES, outcomes.limit(0)).where("verdict = 'block' and rule is null").count() == 0


def test_url_posterior_is_as_defined(spark):
    """Means, bounds and verdicts of hosts against shrinkage by plain loops, with one level after the other."""
    r = random.Random(4)
    hosts = [f"{h}.{d}.{x}" for x in ("org", "net", "co.uk") for d in ("aa", "bb", "cc", "dd") for h in ("www", "m", "shop")] + ["alone.com", "com", "", "new.aa.org", "new.zz.org", "new.zz.eu"]
    bad = {".".join(h.split(".")[1:]): r.random() for h in hosts[:36]}
    rows = [(h, int(r.random() < bad[".".join(h.split(".")[1:])])) for h in hosts[:36] for _ in range(r.randint(0, 30))] + [("alone.com", 1), ("elsewhere.eu", 1), ("www.aa.org", None), (None, 1)]
    two = lambda h: ".".join(h.split(".")[-2:])
    names = {  # host: (suffix, domain)
        h: (two(h), ".".join(h.split(".")[-3:])) if two(h) == "co.uk" else (h.split(".")[-1], two(h)) for h in hosts
    }
    seen = {h: [x for g, x in rows if g == h and x is not None] for h in hosts}
    level = lambda key: {g: [x for h in hosts if key(h) == g for x in seen[h]] for g in {key(h) for h in hosts}}

    def shrunk(counts, above):
        spread = within = scale = 0.0
        for g, xs in counts.items():
            if xs:
                m = above[g]
                spread += len(xs) * (sum(xs) / len(xs) - m) ** 2
                within += m * (1 - m)
                scale += len(xs) * m * (1 - m)
        rho = (spread - within) / (scale - within) if scale > within else 0.0
        k = 1000.0 if rho <= 1 / 1001 else max(1.0, 1 / rho - 1)
        return {g: (sum(xs) + k * above[g]) / (len(xs) + k) for g, xs in counts.items()}, k

    every = [x for xs in seen.values() for x in xs]
    suffixes = level(lambda h: names[h][0])
    by_suffix, a = shrunk(suffixes, dict.fromkeys(suffixes, (sum(every) + 0.5) / (len(every) + 1)))
    domains = level(lambda h: names[h])
    by_domain, b = shrunk(domains, {g: by_suffix[g[0]] for g in domains})
    means, k = shrunk(seen, {h: by_domain[names[h]] for h in hosts})
    assert 1 < b < 1000 and 1 < k <= 1000
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    got = {x.host: x for x in urlrep.reputation(spark.createDataFrame([(h,) for h in [*hosts, None, hosts[0]]], "host string"), outcomes).collect()}
    assert got.keys() == set(hosts)
    for h, m in means.items():
        off = 1.645 * (m * (1 - m) / (len(seen[h]) + k + 1)) ** 0.5
        assert (got[h].n, got[h].mean, got[h].lower, got[h].upper) == pytest.approx((len(seen[h]), m, max(0.0, m - off), min(1.0, m + off)))
    verdicts = {x.host: (x.verdict, x.reputation) for x in urlrep.judge(pages, [], outcomes).collect()}
    assert {v for v, _ in verdicts.values()} == {"allow", "block"}
    for h, m in means.items():
        lower = m - 1.645 * (m * (1 - m) / (len(seen[h]) + k + 1)) ** 0.5
        assert verdicts[h][0] == ("block" if lower > 0.5 else "allow") and verdicts[h][1] == pytest.approx(m)


def test_url_names(spark):
    """Ports, users and final dots are no part of a name; countries' second levels are; addresses are whole."""
    want = {
        "a.com:8080": ("a.com", "a.com", "com"), "u:p@www.a.co.uk": ("www.a.co.uk", "a.co.uk", "co.uk"), "a.b.c.org.": ("a.b.c.org", "c.org", "org"), "co.uk": ("co.uk", "co.uk", "co.uk"),
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", "10.0.0.1"), "": ("", "", ""), "com": ("com", "com", "com"), "x.gob.mx": ("x.gob.mx", "x.gob.mx", "gob.mx"), "x.y.de": ("x.y.de", "y.de", "de"),
    }
    n = urlrep.name(F.col("h"))
    rows = spark.createDataFrame([(h,) for h in want], "h string").select("h", n.alias("n"), urlrep.domain(n).alias("d"), urlrep.suffix(n).alias("s")).collect()
    assert {r.h: (r.n, r.d, r.s) for r in rows} == want


def test_xxh64_is_the_library_s():
    r = np.random.default_rng(0)
    data = r.integers(0, 256, 4000).astype(np.uint8)
    size = np.array([*range(120), 511, 512, 513, 1000])
    start = r.integers(0, 2000, len(size))
    want = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start, size)]
    assert textkernel.xxh64(data, start, size).tolist() == want
