"""Byte-level BPE, spelling variants and the divergence audit: brute force, the library, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from starslice.llm import bpe, divergence, registered, spelling
from starslice.llm.common import Scratch
from starslice.llm.matches import SMALL, UPPER, matches

rng = random.Random(11)
LONG = "Some words of a very long text, naïve ones. " * 30_000  # more than SMALL code points
ODD = [(1, None, "a", None), (2, "", None, "en"), (3, " \t\n", "a", "en"), (4, LONG, "b", "en"), (4, LONG, "b", "en"), (5, "x", None, None), (5, "x", None, None), (None, "nobody's text", "c", "en"), (None, None, None, None)]
CLASH = ("n_tokens", "ids", "decoded", "word", "n", "id", "root", "form", "term", "count", "docs", "p", "q", "slab", "own", "part", "side")


def odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASH})


def drawn(letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Codec.load().ranks, special_tokens={})


def test_matches_of_long_texts():
    pattern = re.compile("[a-z]+")
    assert [x for part in matches(pattern, LONG) for x in part] == pattern.findall(LONG) and len(LONG) > SMALL
    assert not list(matches(pattern, None))


def test_bpe_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registered.op11_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


@pytest.mark.parametrize("letters", ["a", "ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "äßé日本語", " \t\n", ".,-=*#", "0123456789"])
def test_bpe_rows_of_all_lengths(library, letters):
    texts = [drawn(letters, n) for n in [*range(1, 80), 200, 1000, 5000] for _ in range(3)]
    got = bpe.Codec.load().encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_bpe_lower_rank_made_by_a_merge():
    """Ranks at odds with the order of making: after ab, the pair x + ab ranks lower than the next ab."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abx": 300, b"ab": 400, b"abxab": 299, b"xa": 500, b"bx": 600}
    codec = bpe.Codec(ranks, ".+")

    def plain(raw):
        parts = [bytes([b]) for b in raw]
        while True:
            open_pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not open_pairs:
                return [ranks[p] for p in parts]
            _, k = min(open_pairs)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    texts = [drawn("abx", n) for n in range(2, 60) for _ in range(5)]
    assert [np.frombuffer(g, "<u4").tolist() for g in codec.encode(texts)] == [[ranks[t.encode()]] if t.encode() in ranks else plain(t.encode()) for t in texts]


@pytest.mark.parametrize("rows", [ODD, []])
def test_bpe_edges(spark, library, rows):
    docs = odd(spark, rows)
    got = bpe.decode(bpe.encode(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "") and r.n_tokens == len(r.ids) and r.word == "mine word"
    assert bpe.encode(bpe.encode(docs), packed=True).columns.count("ids") == 1


def brute_words(rows):
    total = Counter()
    for doc_id, text in rows:
        runs = Counter(w.translate(UPPER) for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
        for w, n in runs.items():
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += n
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def brute_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def variants_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert variants_of(registered.op12_spelling(spark, sf_dir)) == brute_variants(brute_words(rows))


@pytest.mark.parametrize("share", [1, 40, 2000])
def test_spelling_of_all_lengths_with_any_dictionary(spark, share):
    """Words and their edits at every place, lengths 5 to 40, few letters so that all grams are frequent, and many; chains of forms."""
    words = {}
    for length in [*range(5, 14), 17, 24, 40]:
        for letters in ("ab", "thinger", "abcdefghijklmnopqrstuvwxyzéß"):
            w = drawn(letters, length)
            for k in range(length):
                for x in (w, w[:k] + rng.choice(letters) + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1:]):
                    if len(x) >= 5:
                        words[x] = rng.choice([3, 3, 6, 12, 24, 50, 200])
    df = spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3)
    assert variants_of(spelling.variants(df, share=share)) == brute_variants(words)


def test_spelling_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(drawn("ab", 300), 3) for _ in range(20)] + [(drawn("abcdef", 6), 3) for _ in range(200)], "word string, n long")
    for share in (1, 7, 50):
        assert len(spelling.frequent_grams(words, share)) <= share


@pytest.mark.parametrize("rows", [ODD, []])
def test_spelling_edges(spark, rows):
    got = variants_of(spelling.spelling_variants(odd(spark, rows)))
    assert got == brute_variants(brute_words([(r[0], r[1]) for r in rows]))
    assert bool(got) == bool(rows)


def brute_audit(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = Counter(t.translate(UPPER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(terms.keys())
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        every = Counter()
        for g in groups:
            if g[0] == lang:
                every.update(counts[g])

        def p(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        own = p(counts[lang, source])
        found = {"pair": [], "term": []}
        for g in groups:
            if g[0] == lang and g[1] != source:
                q = p(counts[g])
                found["pair"].append((-sum((own[t] - q[t]) ** 2 // q[t] for t in kept), g[1].encode()))
        q = p(every)
        found["term"] = sorted((-((own[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, source][t] and own[t] > q[t])[:top]
        for part, items in found.items():
            out |= {(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(items))}
    return out


def test_divergence_small_blocks(spark):
    """More sources than a block and more terms than a slab, hot terms, groups without terms."""
    rows = []
    for lang in ("en", "de"):
        for k in range(9):
            for _ in range(4):
                rows.append((lang, f"s{k}", " ".join(rng.choice(["The", "of", "Straße", *[f"w{chr(97 + (x + k) % 26)}{chr(97 + x)}" for x in range(26)]]) for _ in range(rng.randint(0, 60)))))
    rows += [("en", "none", "12 34"), ("fr", "a", "seul"), ("fr", "b", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    terms, groups = divergence.shares(docs, Scratch(spark, "test"), lang_col="lang", source_col="source", text_col="text")
    want = brute_audit(rows)
    for block, slab in ((4, 8), (1, 1000), (32, 4096)):
        got = {(r.lang, r.source, r.other, r.value) for r in divergence.pair_divergences(terms, groups, block, slab).collect()}
        assert got == {(x[0], x[1], x[3], x[4]) for x in want if x[2] == "pair"}
    assert {tuple(r) for r in divergence.audit(docs).collect()} == want


def test_divergence_top_and_large_counts(spark):
    rows = [("en", f"s{k % 2}", " ".join(f"q{drawn('abcdef', 3)}" for _ in range(400))) for k in range(12)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert {tuple(r) for r in divergence.audit(docs, top=7).collect()} == brute_audit(rows, top=7)
    large = spark.createDataFrame([(10 ** 13, 7 * 10 ** 13, 5)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert large[0][0] == 1 + 10 ** 9 * (10 ** 13 + 1) // (7 * 10 ** 13 + 5)


@pytest.mark.parametrize("rows", [ODD, []])
def test_divergence_edges(spark, rows):
    assert {tuple(r) for r in divergence.audit(odd(spark, rows)).collect()} == brute_audit([(r[3], r[2], r[1]) for r in rows])


def test_bpe_matrices_are_of_32_bits_and_rows_come_out_as_bytes():
    """Rows of many lengths in one matrix, with repeats that merge in one round, against one merge a round."""
    codec = bpe.Codec.load()
    assert codec.table.ranks.dtype == np.int32 and codec.byte_ids.dtype == np.int32
    rng = random.Random(5)
    raw = [bytes(rng.choice(b"ab anthe") for _ in range(rng.randint(1, 90))) for _ in range(300)] + [b"aaaaaaaaa" * 9, b"ababababa" * 7]

    def plain(row):
        parts = [row[k:k + 1] for k in range(len(row))]
        while True:
            best = min(((codec.ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                return b"".join(codec.ranks[p].to_bytes(4, "little") for p in parts)
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    assert codec.merge(raw, max(map(len, raw))) == [plain(r) for r in raw]
