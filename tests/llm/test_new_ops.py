"""Encoding by speculation, phrase mining and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tests.llm.test_text_ops import ROWS

from trailmark.llm import bpe, collocations, fill_middle, packing, secret_trigram, token_counts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i}", b"x", 1.5) for i, t in ROWS], "doc_id long, text string, lang string, ids string, n binary, output double")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(bpe.TOKENIZER))


def mixed(rng, n):
    pools = ("etaoinshrdlu", "aaabbeetthhe  \n\t'sdlé你͸՘\x1c\xa0😀0123.,!-", "  \n\n\t\r", "abcdefghijklmnopqrstuvwxyzABC 0123456789")
    return ["".join(rng.choices(rng.choice(pools), k=rng.randrange(60))) for _ in range(n)]


# ------------------------------------------------------------------ 11


def test_speculation_equals_the_library(library):
    texts = mixed(random.Random(1), 4000) + ["x<|endoftext|> <|endoftext|>y<|endoftext|", "<|endoftext|>", "", "it's we'll 'S ''d"]
    own = bpe.Encoder(bpe.TOKENIZER)
    got = list(own.encode(texts))
    for t, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, t
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == t
    assert 0 < own.merged < own.proposed  # some proposals fail, not all


def test_special_strings_may_be_ordinary_text(library):
    library.encode_special_tokens = True
    try:
        want = library.encode("a<|endoftext|>b", add_special_tokens=False).ids
    finally:
        library.encode_special_tokens = False
    assert next(bpe.encoder().encode(["a<|endoftext|>b"], special=False)).tolist() == want
    assert bpe.encoder().count("a<|endoftext|>b") == len(want)


def test_borders_against_merging_each_pair():
    """A border fails exactly where merging the two tokens' bytes gives something else."""
    own, rng = bpe.encoder(), np.random.default_rng(2)
    a, b = rng.integers(0, 3000, (2, 3000))
    crossed = own._crossed(a, b)
    for x, y, c in zip(a.tolist(), b.tolist(), crossed.tolist(), strict=True):
        merged = np.frombuffer(own.merge(own.bytes[x] + own.bytes[y]), "<u4").tolist()
        assert (merged != [x, y]) == c


def test_merging_together_equals_merging_one_by_one():
    own, words = bpe.encoder(), [w.encode() for t in mixed(random.Random(3), 500) for w in t.split() if w]
    assert own._merge_all(words) == [own.merge(w) for w in words]


LONG = {
    "spaces": " " * 2_000_000, "line ends": "a" + "\n" * 2_000_000 + "b", "tabs": "\t" * 2_000_000 + "x", "inside": "some words " + " " * 2_000_000 + "\n more",
    "letters": "x" * 1_000_000, "random": "".join(random.Random(4).choices("etaoinshrdlu", k=1_000_000)), "words": "hello world " * 300_000,
}


@pytest.mark.parametrize("name", list(LONG))
def test_very_long_texts(library, name):
    text = LONG[name]
    bpe.encoder(), packing.encoder(packing.TOKENIZER)
    want = library.encode(text, add_special_tokens=False).ids
    began = time.perf_counter()
    ids = next(bpe.encoder().encode([text]))
    took = time.perf_counter() - began
    assert ids.tolist() == want and bpe.encoder().decode(ids) == text
    assert packing.encode(text).tolist() == want
    assert sum(map(token_counts.counter(), token_counts.leaves(text))) == len(want)
    assert took < 30


def test_long_runs_through_the_operators(spark):
    docs = spark.createDataFrame([(1, LONG["inside"]), (2, "a.b@" * 250_000), (3, "eyJ" * 300_000)], "doc_id long, text string").coalesce(1)
    want = {r: len(bpe.encoder().encode([t]).__next__()) for r, t in ((1, LONG["inside"]), (2, "a.b@" * 250_000), (3, "eyJ" * 300_000))}
    rows = packing.pack(docs).collect()
    assert {r["doc_id"]: r["doc_tokens"] - 1 for r in rows} == want and sum(r["length"] for r in rows) == sum(want.values()) + 3
    counts = {r["doc_id"]: r for r in token_counts.recount(token_counts.build(docs)).collect()}
    assert {i: r["n_tokens"] for i, r in counts.items()} == want
    assert counts[1]["n_chars_edited"] == len(re.sub("[ \t]{2,}", " ", LONG["inside"]))
    assert secret_trigram.scan(docs).agg(F.sum("n_spans")).first()[0] == 0


@pytest.mark.parametrize(("pattern", "text"), [(token_counts.CLEANUP[0][0], "a" * 1_000_000), (token_counts.CLEANUP[0][0], "a.b@" * 250_000), ("jwt", "eyJ" * 330_000), ("jwt", "eyJaaaaaaaaaaa." * 66_000)])
def test_linear_patterns(pattern, text):
    found = secret_trigram.scanner([r for r in secret_trigram.RULES if r.kind == "jwt"]) if pattern == "jwt" else lambda t: re.findall(pattern, t[0])
    began = time.perf_counter()
    found([text])
    assert time.perf_counter() - began < 1


def test_tokens_in_a_run_of_their_letters():
    text = "xx eyJabcdefghijk.abcdefghijklm.zz  abceyJabcdefghijk.abcdefghijklm.zz. eyJab.eyJabcdefghijk.abcdefghijklm.zz"
    rule = next(r for r in secret_trigram.RULES if r.kind == "jwt")
    plain = [m.span() for m in re.finditer(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", text)]
    assert [(a, b) for a, _, b in secret_trigram.scanner([rule])([text])[0]] == plain and len(plain) == 3


def test_encode_and_decode_tables(spark, docs, library):
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((i or -1, t or "") for i, t in ROWS)
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in back) == want
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, [447, 108]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(broken).collect()} == {1: library.decode([447, 108]), 2: "", 3: ""}
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>")).collect()


# ------------------------------------------------------------------ 12


def phrases(rows, least, top):
    """The contract word for word."""
    out = []
    known = lambda x: "und" if x is None else x
    for lang in {known(r[1]) for r in rows}:
        f, n = Counter(), 0
        for _, other, text in rows:
            if known(other) != lang:
                continue
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for size in range(1, 6):
                    f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        within = {}
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    q = p[i : i + size]
                    within[q] = max(within.get(q, 0), a)
        ranked = []
        for p, a in found.items():
            if 100 * within.get(p, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, k, p.decode(), -a, left, right, n, -score) for k, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "ﬀ", "x\x1cy", "A", "a", " "]
    fixed = [" ".join(rng.choices(words, k=k)) for k in (2, 3, 4, 5, 6, 9)]
    some = lambda: rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words)
    text = lambda: "".join(some() + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\r", " \x0b"]) for _ in range(rng.randrange(40)))
    return [(i, rng.choice(["en", "en", "de", None, "und", ""]), text()) for i in range(n)] + [(n, "en", None), (n, "en", ""), (n + 1, "fr", " ..."), (n + 2, "en", "w1 w2 " * 400), (n + 2, "en", "w1 w2 " * 400)]


@pytest.mark.parametrize(("least", "top", "shard", "ranges"), [(3, 2000, 1 << 20, 1 << 22), (8, 25, 500, 100), (20, 2000, 1, 1000)])
def test_phrases_against_counting_all(spark, least, top, shard, ranges):
    rows = corpus(least)
    docs = spark.createDataFrame([(*r, 1.0, "s") for r in rows], "doc_id long, lang string, text string, n double, phrase string").repartition(3)
    got = collocations.mine(docs, least=least, top=top, shard_bytes=shard, range_words=ranges).collect()
    assert sorted(tuple(r) for r in got) == phrases(rows, least, top)


def test_phrase_edges(spark):
    schema = "doc_id long, lang string, text string"
    assert collocations.mine(spark.createDataFrame([], schema)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None), (2, "en", ""), (3, "en", " .,\n")], schema), least=1).count() == 0
    got = collocations.mine(spark.createDataFrame([(1, None, "to be or not to be")] * 2, schema), least=2).collect()
    assert [tuple(r)[:3] for r in got][0] == ("und", 1, "to be or not to") or all(r["lang"] == "und" for r in got)


def test_products_beyond_64_bits(spark):
    a, n, left, right = 9_000_000_007, 9_000_000_000_011, 9_100_000_003, 10_000_000_019
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert df.select(F.expr(collocations.SCORE_SQL)).first()[0] == 1000 * a * n // (left * right)


def test_intervals_of_the_suffix_array():
    rng = np.random.default_rng(5)
    for _ in range(50):
        ids = rng.integers(0, 4, rng.integers(0, 60))
        pieces = [p.split() for p in " ".join("|" if i == 0 else str(i) for i in ids).split("|")]
        want = {m: Counter(tuple(p[i : i + m]) for p in pieces for i in range(len(p) - m + 1)) for m in range(1, 6)}
        for m, at, times in collocations.ngrams(ids, 1, 5):
            assert {tuple(str(x) for x in ids[i : i + m]): int(t) for i, t in zip(at, times, strict=True)} == want[m]


# ------------------------------------------------------------------ 13


def filled(doc, text):
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle_by_hand(spark):
    rng = random.Random(6)
    pool = "ab<>PSM \n\t\x00é你😀é‍"
    rows = [*ROWS, *((100 + i, "".join(rng.choices(pool, k=rng.randrange(40)))) for i in range(600)), (9000, "x<M>y"), (9001, "<P"), (9002, "\x00"), (9003, "😀" * 1_500_000), (9004, None)]
    docs = spark.createDataFrame([(i, t, "f", 3, "o") for i, t in rows], "doc_id long, text string, form string, n int, output string")
    got = fill_middle.transform(docs).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(((i, *filled(i, t)) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], r["back"]) for r in got), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_other_marks(spark):
    options = fill_middle.Options("<pre>", "<suf>", "<mid>", transformed=100, suffix_first=50)
    docs = spark.createDataFrame([(i, f"some text {i} it's") for i in range(40)], "doc_id long, text string")
    got = fill_middle.transform(docs, options=options).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), options)).collect()
    assert {r["form"] for r in got} == {"psm", "spm"} and all(r["back"] == f"some text {r['doc_id']} it's" for r in got)
    with pytest.raises(ValueError, match="marks"):
        fill_middle.transform(docs, options=fill_middle.Options("<P>", "<P>", "<M>"))


def test_slices_have_bounded_bytes():
    import pyarrow as pa

    from trailmark.llm.common import by_bytes

    texts = ["a" * k for k in (5, 0, 300, 7, 7, 7)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    parts = list(by_bytes(iter([batch, batch.slice(0, 0)]), 20))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(7))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 20 for p in parts)
