"""Operators against brute force over small tables and fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from starslice.llm import (
    chat, decontaminate, line_dedup, mixing, ngram_jaccard, pii, quality_classifier, quality_rules, registered, suffix_dedup, token_counts,
)

SPACE = b" \t\n\x0b\x0c\r"
rng = random.Random(5)
WORDS = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.15 else "") for _ in range(n))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def find_root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(texts, size, num, den, lower=True):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    ids, parent = sorted(sets), {i: i for i in sets}
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            both = len(a & b)
            if both and both * den >= num * (len(a) + len(b) - both):
                p, q = find_root(parent, ids[x]), find_root(parent, ids[y])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find_root(parent, i)) for i in ids}


def test_jaccard_query(spark, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registered.op7_ngram_jaccard(spark, sf_dir).collect()}
    assert got == brute_components(texts_of(spark, sf_dir), 4, 17, 20)


def test_jaccard_chains_and_groups(spark):
    """Near copies of near copies: groups in which no pivot links to all, so that later rounds and the last pairs are needed."""
    texts, words = {}, [rng.choice(WORDS) for _ in range(120)]
    for k in range(60):
        own = list(words)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        if k % 5 == 0:
            words = own  # the original drifts
        texts[k * 3] = " ".join(own)
    texts |= {1000: None, 1001: "", 1002: " \t", 1003: "One two", 1004: "one TWO", 1005: "a b c d"}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(table(spark, list(texts.items())), size=4, threshold=0.85).collect()}
    assert got == brute_components(texts, 4, 17, 20)


def brute_suffixes(texts, length=50):
    seen, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b), bool)
        own = [b[k:k + length] for k in range(len(b) - length + 1)]
        for k, w in enumerate(own):
            if w in seen:
                gone[k:k + length] = True
        for w in own:
            seen.setdefault(w, i)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_query(spark, sf_dir):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registered.op9_suffix_dedup(spark, sf_dir).collect()}
    assert got == brute_suffixes(texts_of(spark, sf_dir))


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_hard_texts(spark, monkeypatch, hot):
    """Runs of one byte, periodic texts, overlaps, texts of exactly 50 bytes; and the way for grams that are too frequent."""
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", 2)
    base = prose(60)
    texts = {5: base, 3: "x" * 300, 4: "x" * 120 + base[20:200] + "y" * 60, 9: "ab" * 90, 11: "b" + "ab" * 70, 12: base[:50], 13: base[1:50], 14: base[7:57] + base[7:57],
             20: None, 21: "", 22: "é" * 40, 23: "é" * 30, 30: base, 31: prose(30) + base[40:140] + prose(10)}
    got = suffix_dedup.dedup_suffixes(table(spark, list(texts.items()))).withColumn("h", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got} == brute_suffixes(texts)


def test_equal_strings_is_exact():
    r = np.random.default_rng(1)
    rows = r.integers(0, 2, (400, 50)).astype(np.uint8)
    rows[:, :40] = rows[r.integers(0, 5, 400), :40]
    rows[:, 45:] = 0
    group = r.integers(0, 3, 400)
    leaf = suffix_dedup.equal_strings(group, rows)
    keys = [(int(g), x.tobytes()) for g, x in zip(group, rows)]
    first = {}
    for k, key in enumerate(keys):
        first.setdefault(key, leaf[k])
        assert leaf[k] == first[key]
    assert len(set(leaf)) == len(first)


def brute_rules(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if x]
    windows = {}
    for k in range(len(w) - 2):
        windows.setdefault(tuple(w[k:k + 3]), []).append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rules_query(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    for r in registered.op4_quality_rules(spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_rules_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = registered.op4_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.97 * sum(r.quality == 1 for r in rows)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in rows)


def test_classifier_on_held_out_labels(spark):
    """Trained with two thirds of the labelled rows, judged on the others."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = quality_classifier.fit(docs, labels.filter("doc_id % 3 <> 0"))
    rows = quality_classifier.classify(docs.filter("doc_id % 3 = 0"), model).join(labels, "doc_id").collect()
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [not r.keep for r in rows if r.toxic == 1]
    low = [not r.keep for r in rows if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(toxic) >= 0.85 * len(toxic) and sum(low) >= 0.95 * len(low)
    assert (model.form_votes.accuracies() > 0.7).all()


def brute_base(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_query(spark):
    d = "/root/testdata/sf0.01"
    texts = texts_of(spark, d)
    for r in registered.op1_pii(spark, d).collect():
        base = brute_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]


def test_base_patterns_on_random_texts():
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice("a1@.+-( )2é9_0\n") for _ in range(r.randrange(0, 60)))
        assert pii.base_spans(text) == brute_base(text), text


def test_viterbi_and_gradient_against_enumeration():
    from itertools import product

    r = np.random.default_rng(2)
    field = pii.Field(r.normal(size=(pii.FEATURES, pii.LABELS)), r.normal(size=(pii.LABELS + 1, pii.LABELS)))
    move = field.step + pii.allowed()
    runs = [r.integers(0, pii.FEATURES, (n, len(pii.SLOTS))) for n in (1, 2, 3, 3)]
    labels, sure = field.decode(runs)
    for run, own, p in zip(runs, labels, sure):
        score = field.scores(run)
        ways = {y: move[-1, y[0]] + sum(score[t, y[t]] for t in range(len(y))) + sum(move[a, b] for a, b in zip(y, y[1:])) for y in product(range(pii.LABELS), repeat=len(run))}
        best = max(ways, key=ways.get)
        assert tuple(own) == best and abs(p - (ways[best] - np.logaddexp.reduce(list(ways.values())))) < 1e-9


def test_field_learns_a_labelled_table(spark):
    """Numbers that the base misses, learned from a table that somebody labelled."""
    rows = []
    for k in range(60):
        t = f"call {200 + k}-555-{1000 + k} or see item {k}"
        rows.append((t, [("phone", 5, 5 + len(f"{200 + k}-555-{1000 + k}"))]))
    labelled = spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,end:int>>")
    found = pii.find(table(spark, [(1, "please call 999-555-7777 today"), (2, "item 12 of 30"), (3, None)]), pii.fit(labelled)).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in found] == [[("phone", 12, 24)], [], []]


def test_tokens_add_up_and_decode(spark, sf_dir):
    encoder = token_counts.Encoder(token_counts.default_vocabulary())
    texts = texts_of(spark, sf_dir)
    rows = registered.op2_token_counts(spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        ids = encoder.encoding.encode_ordinary(text)
        assert encoder.encoding.decode(ids) == text
        own = sorted(by[i], key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(ids) == own[0].doc_tokens
        assert "".join(text[r.start_char:r.end_char] for r in own) == text and [text[r.start_char:r.end_char].rstrip("\n") for r in own] == [x for x in text.split("\n")][:len(own)]


def test_boundary_tokens_go_to_the_larger_part():
    n, crossing = token_counts.attribute(np.array([4, 9, 12, 14]), np.array([6, 10, 13, 14]))
    # tokens 0-4, 4-9 (two bytes in the first section, three in the second), 9-12 (one and two), 12-14 (one and one: the earlier)
    assert n.tolist() == [1, 1, 2, 0] and crossing.tolist() == [0, 1, 2, 0]
    assert token_counts.attribute(np.array([9]), np.array([1, 6, 9]))[0].tolist() == [0, 1, 0]


def test_chat_collapse(spark):
    turns = [(1, 0, "u", "a"), (1, 1, "s", "b"), (2, 0, "u", "a"), (2, 1, "s", "b"), (2, 2, "u", "c"), (3, 0, "u", "a"), (4, 0, "u", "a"), (4, 1, "s", "b"), (4, 2, "u", "c"),
             (5, 0, "u", "x"), (6, 0, None, None), (7, 0, "", ""), (None, 0, "u", "a"), (8, 5, "u", "a"), (8, 9, "s", "z"), (9, 0, "u", "q"), (9, 0, "u", "q")]
    rows = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in rows] == [(2, 3, 2), (5, 1, 1), (6, 1, 1), (7, 1, 1), (8, 2, 1), (9, 2, 1)]
    assert rows[0].rendered == "<|u|>\na\n<|s|>\nb\n<|u|>\nc\n" and rows[2].rendered == rows[3].rendered == "<||>\n\n"


def test_mix_meets_its_targets(spark):
    rows = [(k, "w " * (1 + k % 7), "abc"[k % 3] if k < 90 else None) for k in range(120)] + [(200, "w " * 50, "tiny"), (201, None, "none")]
    got = mixing.mix(table(spark, rows, "doc_id long, text string, source string")).collect()
    total, by = sum(r.size for r in got), {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size and all(0 < c.position < 1 for c in r.copies) and r.taken == sum(c.words for c in r.copies)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].target <= 3 * own[0].source_size
    assert abs(sum(own[0].target for own in by.values()) - total) < 1e-6
    again = mixing.mix(table(spark, rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_training_order_follows_the_schedules(spark):
    rows = [(k, "w " * 10, "ab"[k % 2]) for k in range(400)]
    order = mixing.training_order(table(spark, rows, "doc_id long, text string, source string"), rates=((1.9, 0.1), (0.1, 1.9))).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    early = [r.source for r in order if r.position < 0.25]
    assert early.count("a") > 4 * early.count("b")  # a is read early, b late


def brute_contained(docs, items):
    def sets(t):
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    out = set()
    for i, t in docs.items():
        own = sets(t)
        for j, x in items.items():
            q = sets(x)
            if q and 5 * len(own & q) >= 4 * len(q):
                out.add((i, j, len(own & q), len(q)))
    return out


def test_containment_of_edited_items(spark):
    items = {k: prose(8 + 4 * k) for k in range(8)} | {50: None, 51: "", 52: "two words", 53: prose(3)}
    docs = {}
    for k in range(8):
        w = items[k].split()
        docs[k] = prose(300) + " " + items[k].upper() + ", " + prose(300)
        docs[100 + k] = prose(50) + " " + " ".join(w[:len(w) // 2] + ["changed"] + w[len(w) // 2 + 1:]) + " " + prose(50)
    docs |= {200: None, 201: "", 202: "two words", 203: "x two words y"}
    got = decontaminate.contained_items(table(spark, list(docs.items())), table(spark, list(items.items()), "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute_contained(docs, items)


def test_lines_are_aligned(spark):
    block = ". ".join(prose(8).replace(".", "") for _ in range(6)) + "."
    texts = {1: f"First own line of one.\n{block}\nLast own line of one here.", 2: f"Quite other words stand here.\n{block}\nAnd an end of its own.",
             3: block, 4: f"{block} {block}", 5: prose(40), 6: "short.", 7: None, 8: ""}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, list(texts.items()))).collect()}
    assert got[1].text == texts[1] and got[1].n_removed_words == 0
    assert got[2].text == "Quite other words stand here.\nAnd an end of its own." and got[2].n_removed_words == 48 and got[2].n_blocks == 1
    assert got[3].text == "" and got[3].n_removed_words == got[3].n_words
    assert [got[k].text for k in (5, 6, 7, 8)] == [texts[k] for k in (5, 6, 7, 8)]


def test_line_blocks_are_in_an_earlier_document(spark, sf_dir):
    """Whatever a document of the table loses stands, word for word, in an earlier one; nothing else changes."""
    texts = texts_of(spark, sf_dir)
    before = {}
    for r in line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).orderBy("doc_id").collect():
        a, b = texts[r.doc_id].encode().split(), r.text.encode().split()
        assert len(a) - len(b) == r.n_removed_words
        if r.n_removed_words:
            early = b" \n ".join(b" ".join(texts[i].encode().split()) for i in texts if i < r.doc_id)
            k = 0
            while b[k:] != a[k + len(a) - len(b):] and k < len(b) and a[k] == b[k]:
                k += 1
            if r.n_blocks == 1:
                assert b" ".join(a[k:k + len(a) - len(b)]) in early or any(b" ".join(a[x:x + len(a) - len(b)]) in early for x in range(max(0, k - 30), k + 1))
        before[r.doc_id] = r
    assert sum(r.n_blocks for r in before.values()) > 0


def test_patience_takes_the_longest_run():
    late, early = np.array([0, 1, 2, 3, 4, 5]), np.array([9, 1, 2, 8, 3, 4])
    assert line_dedup.ascending(late, early) == [1, 2, 4, 5]
