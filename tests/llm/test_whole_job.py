"""Cases in which a shortcut of an operator would lose part of the result."""

import random

import pytest
from pyspark.sql import functions as F

from starslice.llm import chat, line_dedup, ngram_jaccard
from starslice.llm.common import Scratch
from starslice.llm.components import components


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_links_far_from_every_pivot(spark, seed):
    """Ten linked pairs among many members that link with nothing, with ids that the pivots' random order puts last in every round."""
    r = random.Random(seed)
    order = [F.xxhash64("id", F.lit(k)).alias(f"o{k}") for k in range(ngram_jaccard.ROUNDS)]
    ids = [x.id for x in sorted(spark.range(seed * 10000, seed * 10000 + 3000).select("id", *order).collect(), key=lambda x: min(x[1:]))]
    vocabulary = [f"w{k}" for k in range(60)]
    texts = {i: r.sample(vocabulary, 12) for i in ids[:400]}
    pairs = [sorted(ids[-2 * k - 2:len(ids) - 2 * k]) for k in range(10)]
    for a, b in pairs:
        texts[a] = r.sample(vocabulary, 12)
        texts[b] = texts[a][:11] + [next(w for w in vocabulary if w not in texts[a])]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_jaccard.jaccard_components(rows, size=1, threshold=0.84).collect()}
    assert [(got[a], got[b]) for a, b in pairs] == [(a, a) for a, b in pairs]
    assert sum(i != c for i, c in got.items()) == 10


def windows_left(texts, size):
    """Brute force: for each text the words that no window of ``size`` words shared with a smaller id covers."""
    seen, out = {}, {}
    for i in sorted(texts):
        w = (texts[i] or "").split()
        own = [tuple(w[k:k + size]) for k in range(len(w) - size + 1)]
        gone = {k + j for k, x in enumerate(own) if x in seen for j in range(size)}
        seen |= dict.fromkeys(own)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def lost_blocks():
    a, b, c, d = ([*words(14, k), f"end{k}."] for k in range(4))
    passage, listed = words(60, 9), words(155, 10)
    return {
        # each line of 5 and 6 has an earlier holder of its own
        1: " ".join(a), 2: " ".join(b), 3: " ".join(c), 4: " ".join(d), 5: " ".join(a + b + c + d), 6: " ".join(a + b + c + d),
        # a passage that stands twice, earlier and later
        10: ". ".join([" ".join(passage[k:k + 6]) for k in range(0, 60, 6)] * 2), 11: ". ".join([" ".join(passage[k:k + 6]) for k in range(0, 60, 6)] * 3),
        # lines of one word; a passage inside one sentence, without line feeds or full stops
        20: "\n".join(listed), 21: " ".join(words(30, 11)) + "\n" + "\n".join(listed), 22: " ".join(words(40, 12) + listed[20:75] + words(33, 13)),
        # edits, periodic texts, 19 and 20 words
        30: " ".join(listed[:70] + ["edit"] + listed[71:]), 31: "x " * 90, 32: "x " * 45, 33: "x y z " * 40, 34: "y z x " * 30, 35: " ".join(listed[3:22]), 36: " ".join(listed[3:23]),
        40: None, 41: "",
    }


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_line_dedup_against_all_windows(spark, parts):
    texts = lost_blocks()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts, F.xxhash64("doc_id", F.lit(parts)))
    got = {r.doc_id: (r.text or "").split() for r in line_dedup.dedup_lines(rows).collect()}
    assert got == windows_left(texts, 20)
    assert got[6] == got[11] == got[36] == [] and len(got[5]) == 60 and len(got[22]) == 73


def test_line_dedup_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: " ".join(w.decode() for w in (r.text or "").encode().split()) for r in docs.collect()}
    got = {r.doc_id: [w.decode() for w in r.text.encode().split()] for r in line_dedup.dedup_lines(docs).collect()}
    brute = windows_left({i: " ".join(t.split(" ")) for i, t in texts.items()}, 20)
    assert {i: len(w) for i, w in got.items()} == {i: len(w) for i, w in brute.items()}


def test_jaccard_below_a_half(spark):
    """A text and its first part link at a low threshold, though their sets' parities have widths of several powers of two apart."""
    words = [f"w{k}" for k in range(900)]
    texts = {1: words[:290], 2: words[:100], 3: words[300:], 4: words[300:490], 5: ["other", *words[:40]]}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_jaccard.jaccard_components(rows, size=1, threshold=0.3).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1}  # 5 and 2: 40 of 101


@pytest.mark.parametrize("more", [[], ["room"]])
def test_grouped_rows_carry_what_the_caller_has(spark, more):
    """Operator 9 groups grams without a room, operator 7 tokens with one."""
    rows = spark.createDataFrame([(t, i, t * 100 + i) for t, ids in ((1, [5, 6, 7]), (2, [5]), (3, [8, 9]), (4, []), (-5, [1] * 2)) for i in ids], "token long, id long, room long")
    got = ngram_jaccard.grouped(rows.select("token", "id", *more).repartition(3), *more)
    assert got.columns == ["token", "id", *more]
    assert sorted(tuple(x) for x in got.collect()) == [(t, i, t * 100 + i)[:2 + len(more)] for t, i in ((-5, 1), (-5, 1), (1, 5), (1, 6), (1, 7), (3, 8), (3, 9))]


def linked(sets, num, den):
    """Brute force: the smallest id that links reach from each."""
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and (both := len(sets[x] & sets[y])) * den >= num * (len(sets[x]) + len(sets[y]) - both):
                p, q = root(x), root(y)
                low[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("shape, rounds", [("stars", 0), ("none", 0), ("chain", None), ("random", None)])
def test_components_take_no_round_more_than_they_need(spark, shape, rounds):
    """Each round is eight exchanges that the driver plans; links that are stars already need none, and none is run to see that nothing changes."""
    r = random.Random(7)
    links = {"stars": [(k // 9 * 9, k) for k in range(90) if k % 9] * 2 + [(200, 200)], "none": [(3, 3)], "chain": [(k, k + 1) for k in range(40)],
             "random": [(r.randrange(120), r.randrange(120)) for _ in range(90)]}[shape]
    scratch, put = Scratch(spark, "test"), []
    whole = scratch.put
    scratch.put = lambda name, df: put.append(name) or whole(name, df)
    got = [tuple(x) for x in components(spark.createDataFrame(links, "a long, b long").repartition(3), scratch, "cc").collect()]
    sets = {i: {(min(x), max(x)) for x in links if i in x and x[0] != x[1]} for i in {i for x in links for i in x}}
    low = {i: i for i in sets if sets[i]}
    while True:
        new = {i: min(low[j] for x in sets[i] for j in x) for i in low}
        if new == low:
            break
        low = new
    assert sorted(got) == sorted(low.items())
    assert len(put) - 1 == rounds if rounds is not None else 1 < len(put) < 8


def test_jaccard_family_of_near_copies_makes_few_candidates(spark, monkeypatch):
    """Copies of one text with up to five words replaced, most of them too far from each other: candidates grow with the copies, not with their square."""
    r = random.Random(4)
    base, texts = [f"b{k}" for k in range(150)], {}
    for i in range(400):
        texts[i] = list(base)
        for k in r.sample(range(150), r.randrange(1, 6) if i else 0):
            texts[i][k] = f"new{i}x{k}"
    asked, whole = [], ngram_jaccard.compare
    monkeypatch.setattr(ngram_jaccard, "compare", lambda pairs, *a, **k: asked.append(pairs.count()) or whole(pairs, *a, **k))
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in ngram_jaccard.jaccard_components(rows, size=4, threshold=0.85).collect()}
    assert got == linked({i: {tuple(w[k:k + 4]) for k in range(len(w) - 3)} for i, w in texts.items()}, 17, 20)
    assert 0 < sum(c > 0 for c in got.values()) < 399 and sum(asked) < 4 * len(texts)


@pytest.mark.parametrize("num, den", [(17, 20), (1, 2), (1, 1)])
def test_jaccard_sizes_and_rooms(spark, num, den):
    """Sets of many sizes around a few bases, words left out and added, against all pairs."""
    r = random.Random(num)
    sets = {}
    for i in range(240):
        base = [f"b{i % 3}w{k}" for k in range((5, 24, 60)[i % 3])]
        sets[i] = {w for w in base if r.random() > 0.08 * r.randrange(4)} | {f"o{r.randrange(300)}" for _ in range(r.randrange(len(base) // 8 + 1))}
    rows = spark.createDataFrame([(i, " ".join(sorted(w))) for i, w in sets.items()], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_jaccard.jaccard_components(rows, size=1, threshold=num / den).collect()}
    assert got == linked({i: w for i, w in sets.items() if w}, num, den) | {i: i for i, w in sets.items() if not w}


@pytest.mark.parametrize("num, den", [(17, 20), (3, 10), (1, 1)])
def test_jaccard_pairs_between_labels_are_all_found(spark, num, den):
    """``between`` against all pairs of each group, with labels of which one holds most members of some groups."""
    r = random.Random(den)
    rows = []
    for token in range(12):
        for i in range(60):
            n = r.randrange(1, (4, 30, 400)[token % 3])
            rows.append((token, i, n, n - min(n - 1, r.randrange(1 + n // 4)), r.choice([0, 0, 0, i]) if token % 2 else r.randrange(3)))
    t = ngram_jaccard.Fraction(num, den)

    def fits(x, y):
        small, large = sorted((x[2], y[2]))
        return x[4] != y[4] and small * den >= large * num and min(x[3], y[3]) * (num + den) >= (x[2] + y[2]) * num

    want = sorted((x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and fits(x, y))
    got = ngram_jaccard.between(spark.createDataFrame(rows, "token long, id long, n long, room long, label long"), t)
    assert sorted((x.token, *sorted((x.id, x.id2))) for x in got.collect()) == want and want


def test_one_of_each_keeps_the_greatest_text_of_a_repeated_id(spark):
    rows = spark.createDataFrame([(1, "a b c", "x"), (1, "z y w", "y"), (1, None, "n"), (2, None, "n"), (2, None, "n"), (None, "q", "z")], "doc_id long, text string, source string")
    kept = sorted((tuple(x) for x in ngram_jaccard.one_of_each(rows).collect()), key=repr)
    assert kept == [(1, "z y w", "y"), (2, None, "n"), (None, "q", "z")]


def test_prefixes_of_a_conversation_in_many_parts(spark):
    """One conversation holds most turns; prefixes are numbered, equal and different as in a plain count."""
    def turns(conv, n, odd=None):
        return [(conv, t, "user" if t % 2 else "assistant", f"said {t}" if t != odd else "else") for t in range(n)]

    data = turns(1, 700) + turns(2, 30) + turns(3, 400, odd=399) + turns(4, 700) + [(5, None, None, None)] * 3 + [(None, 1, "user", "x")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    made = chat.prefixes(frame, "conv_id", "turn", "role", "text", Scratch(spark, "test"))
    found = {(r.conv, r.n): (r.h0, r.h1, r.h2, r.h3) for r in made.collect()}
    assert sorted(found) == [(c, n + 1) for c, size in ((1, 700), (2, 30), (3, 400), (4, 700), (5, 3)) for n in range(size)]
    assert all(found[1, n] == found[4, n] for n in range(1, 701)) and all(found[2, n] == found[1, n] for n in range(1, 31))
    assert all(found[3, n] == found[1, n] for n in range(1, 400)) and found[3, 400] != found[1, 400]
    assert len(set(found.values())) == 704
    assert sorted(tuple(r) for r in chat.collapsed(frame).collect()) == [(1, 700, 2), (3, 400, 1), (5, 3, 1)]
