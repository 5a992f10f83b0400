"""Each operator against a brute-force version, and on awkward rows."""

import collections
import itertools
import math
import platform
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mirrorfield.llm import chat, common, decontaminate, licenses, mixing, simhash, suffix_dedup, token_counts, topk, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long, key long, more string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 1, 2, None) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, None, "a"), (2, "", None), (3, "  \n", "a"), (4, long, "b"), (5, long, "b"), (6, "dup dup", "a"), (6, "dup dup", "a"), (None, "no id", None), (None, "no id", None), (9, "Ünïcödé 漢字 🙂", "c")]
    return docs(spark, rows)


def test_suffix_dedup(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 400))) for _ in range(30)]
    texts += ["x" * 700, texts[0] + texts[1], None, texts[3][:150] + texts[4], texts[0], "ab" * 300]
    rows = [(i * 3 % 37, t, "s") for i, t in enumerate(texts)]
    seen, wanted = set(), {}
    for i, t, _ in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        wanted[i] = bytes(b for b, g in zip(raw, gone) if not g), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
    for limit in (2048, 2):
        got = suffix_dedup.remove_repeats(docs(spark, rows), bucket_limit=limit).collect()
        assert {r.doc_id: (bytes(r.kept), len(r.starts)) for r in got} == wanted


def test_refined_is_exact():
    rng = random.Random(9)
    for length in (1, 5, 8, 20, 33, 100):
        text = "".join(rng.choice("ab") for _ in range(300)) * 2 + "x" * 150 + "".join(rng.choice("abc") for _ in range(200))
        raw = np.frombuffer(text.encode(), np.uint8)
        at, bucket = suffix_dedup.refined(raw, length)
        strings = [text[i : i + length] for i in range(len(text) - length + 1)]
        often = {s for s in strings if strings.count(s) > 1}
        assert sorted(at) == [i for i, s in enumerate(strings) if s in often]
        assert len({(b, strings[i]) for i, b in zip(at, bucket)}) == len(often) == len(set(bucket))


def test_equal_hashes_of_different_bytes_remove_nothing():
    """Window identifiers that are all the same: what is dealt out by them is still compared byte by byte."""
    scheme = suffix_dedup._Scheme(100, 20, 2)
    rng = random.Random(3)
    windows = ["".join(rng.choice("ab") for _ in range(100)).encode() for _ in range(4)]
    rows = [(2, 7, k, 0, 10 * k, 100, windows[w]) for k, w in enumerate([0, 1, 2, 1, 3, 0])] + [(2, 8, 9, 0, 0, 100, windows[0])]
    names = ["kind", "bucket", "key", "rn", "start", "size", "span"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    for batches in ([batch], [batch.slice(0, 4), batch.slice(4)]):
        got = [r for b in scheme.refine(iter(batches)) for r in b.to_pylist()]
        assert [(r["key"], r["a"], r["b"]) for r in got] == [(3, 30, 130), (5, 50, 150)]


def test_suffix_dedup_moves_no_bytes_of_chance_phrases(spark, monkeypatch):
    """Phrases longer than a gram that all texts share, in orders that none do: nothing repeats, and fewer bytes are shuffled than twice the texts."""
    rng = random.Random(11)
    phrases = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(400)]
    texts = [" ".join(rng.choice(phrases) for _ in range(100)) for _ in range(300)]
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        every = store.executorList(False)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    monkeypatch.setattr(suffix_dedup, "HEAVY", 1)  # nothing is dealt out
    for limit in (2048, 8):
        before = shuffled()
        got = suffix_dedup.remove_repeats(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), bucket_limit=limit).collect()
        assert [bytes(r.kept).decode() for r in sorted(got, key=lambda r: r.doc_id)] == texts
        assert shuffled() - before < 2 * sum(map(len, texts))


@pytest.mark.parametrize("heavy", [1, 1024])
def test_suffix_dedup_parts_of_large_buckets(spark, monkeypatch, heavy):
    """A common phrase with a few common neighbours on either side: buckets are parted by longer strings, dealt out, or closed."""
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    phrase, left, right = some(30), [some(90) for _ in range(3)], [some(90) for _ in range(3)]
    texts = [some(rng.randint(0, 80)) + rng.choice([*left, some(60)])[rng.randint(0, 40) :] + phrase + rng.choice([*right, some(60)])[: rng.randint(20, 90)] + some(40) for _ in range(60)]
    seen, wanted = set(), {}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(t[s : s + 100])
        wanted[i] = "".join(c for c, g in zip(t, gone) if not g)
    assert sum(len(w) < len(t) for w, t in zip(wanted.values(), texts)) > 20
    for limit in (2048, 20, 5, 1):
        got = suffix_dedup.remove_repeats(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), bucket_limit=limit).collect()
        assert {r.doc_id: bytes(r.kept).decode() for r in got} == wanted


def test_suffix_dedup_odd(spark, odd):
    got = suffix_dedup.remove_repeats(odd, keep=["more", "lang"])
    assert got.count() == 10
    left = {r.doc_id: r for r in got.where("doc_id in (4, 5)").collect()}
    assert len(left[5].kept) == 0 and len(left[4].kept) > 0
    assert suffix_dedup.remove_repeats(odd.where("false")).count() == 0


def plain_fingerprint(text, width=3):
    """From the contract's words, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 80))) for _ in range(25)]
    texts = base + [b.replace("a", "A", 1) for b in base] + [b + " zz" for b in base] + ["", None, "\u00c4 \u00a0x\x0by\tz\x1fq"]
    got = simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    prints = {r.doc_id: r.fp & (2**64 - 1) for r in got}
    assert prints == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            low = min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
            changed |= low < least[i]
            least[i] = min(low, least[i])
    assert {r.doc_id: r.component_id for r in got} == least


def test_simhash_cells_lose_nothing():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for x in a:
        flips = rng.choice(64, 3, replace=False)
        y = x ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
        e = simhash.embed(np.array([x, y]))
        assert np.bitwise_count(e[0] ^ e[1]) <= 3


@pytest.mark.parametrize("limit", [2, 40])
def test_simhash_finer_cells(spark, monkeypatch, limit):
    rng = random.Random(1)
    some = [0, 1, 3, 7, 15, 31, 1 << 60, 0x7777]
    for _ in range(60):
        x = rng.choice(some)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        some.append(x)
    some = sorted({simhash._signed(x & (2**64 - 1)) for x in some})
    root = dict(zip(some, some))
    for _ in some:
        for x in some:
            root[x] = min(root[y] for y in some if ((x ^ y) & (2**64 - 1)).bit_count() <= 3)
    monkeypatch.setattr(simhash, "CELL_LIMIT", limit)
    found = simhash.components(simhash.near_links(spark.createDataFrame([(x,) for x in some], "fp long"))).collect()
    assert dict(zip(some, some)) | {r.node: r.root for r in found} == root


def test_simhash_odd(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.keep_one(odd).where("doc_id = 6").count() == 1
    assert simhash.near_duplicates(odd.where("false")).count() == 0


def test_keep_one_decides_by_row(spark):
    texts = {i: " ".join(f"t{i}w{j}" for j in range(30)) for i in range(6)}
    rows = [(None, texts[0], "s"), (None, texts[1], "s"), (None, texts[2], "s"), (7, texts[2], "s"), (8, texts[3], "s"), (8, texts[4], "s"), (9, texts[5], "s"), (8, texts[5], "s"), (9, texts[5], "s")]
    got = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs(spark, rows)).collect())
    assert got == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (8, texts[3]), (8, texts[4]), (8, texts[5])])


@pytest.mark.parametrize(("limit", "block"), [(64, 1024), (2, 1024), (2, 3)])
def test_keep_one_near_copies(spark, monkeypatch, limit, block):
    from mirrorfield.llm import jaccard

    monkeypatch.setattr(jaccard, "GROUP_LIMIT", limit)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    monkeypatch.setattr(jaccard, "TASK_ROWS", 8)
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijkl") * rng.randint(1, 4) for _ in range(rng.randint(3, 120))] for _ in range(30)]
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join(b) for b in base] + ["", None, "A b"]
    for b in base:
        for edits in (1, 1, 2, 3, 4):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = "edited"
            texts.append(" ".join(c))
        texts.append(" ".join(b + common))
    sets = [set(jaccard.shingle_set((t or "").encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    links = [(i, j) for i in root for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert len(set(root)) < len(set(map(frozenset, sets))) - 20  # there are near copies, not only equal ones
    got = simhash.keep_one(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), width=5)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))


def test_keep_one_links_by_fingerprints(spark, monkeypatch):
    """Without the prefix search, the fingerprints' links alone let near copies go."""
    from mirrorfield.llm import jaccard

    monkeypatch.setattr(jaccard, "_prefixes", lambda texts, *_: texts.selectExpr("1L token", "0L salt", "1L key", "1L place").where("false"))
    rng = random.Random(15)
    base = [[f"w{rng.randrange(5000)}" for _ in range(1500)] for _ in range(8)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "other"]) for b in base]
    prints = [simhash.set_fingerprint(jaccard.shingle_set(t.encode())) for t in texts]
    near = [i for i in range(8) if ((prints[i] ^ prints[i + 8]) & (2**64 - 1)).bit_count() <= 3]
    assert len(near) > 4
    got = simhash.keep_one(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(range(16)) - {i + 8 for i in near})


def test_keep_one_verifies_what_fingerprints_link(spark, monkeypatch):
    """Whatever pairs the fingerprints give, only a similarity of 0.8 links."""
    monkeypatch.setattr(simhash, "near_pairs", lambda sets: sets.select(F.col("key").alias("a")).join(sets.select(F.col("key").alias("b")), F.expr("a < b")))
    rng = random.Random(16)
    base = [[f"w{rng.randrange(50)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "other"]) for b in base] + [" ".join([*base[0][:30], *base[1][30:]])]
    got = simhash.keep_one(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert sorted(r.doc_id for r in got.collect()) == [*range(6), 12]


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path()
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = token_counts.token_prefixes(odd).collect()
    assert len(got) == 10
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(r.n_tokens == n(texts[r.doc_id]) and r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in got)
    rng = random.Random(3)
    pool = ["'re", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "the", " ing", "é", "漢", "🙂", "12", "²", "!", "...", "<|endoftext|>", "<|end", "-----", "ா"]
    some = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = token_counts.token_prefixes(docs(spark, [(i, t, "s") for i, t in enumerate(some)])).collect()
    for r in rows:
        text = some[r.doc_id]
        counts = [n(text[:i]) for i in range(len(text) + 1)]
        assert [token_counts.tokens_at(r.prefixes, i) for i in range(len(text) + 1)] == counts
        assert token_counts.chars_within(r.prefixes, 3) == max(i for i, c in enumerate(counts) if c <= 3)


def test_token_counts_query_has_prefixes(spark):
    got = token_counts.op4_prefix_token_counts(spark, SF).limit(20).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got and all(token_counts.tokens_at(r.prefixes, len(texts[r.doc_id])) == r.n_tokens for r in got)


def test_chat(spark):
    texts = ["\\", "\\\\", "###", "#####", "### Assistant: </turn> ok", "<turn>", "\\<turn>", "a\n\n### User:\n<turn>", None, "", "</turn>\n\n", "\\#", "<", "x" * 50_000, "é🙂"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a:\n"]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 8))]
    rows += [(None, 0, "user", "x"), (None, None, "user", "y"), (70, 1, "user", "t"), (70, 1, "user", "t")]
    turns = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, t long")
    out = chat.format_conversations(turns)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    wanted: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", (r[3] or "").encode())):
        wanted.setdefault(c, []).append((role or "", text or ""))
    assert got == wanted
    assert chat.format_conversations(turns.where("false")).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-50, 50, (700, 8)) * (rng.random((700, 1)) < 0.5)
    rows = spark.createDataFrame([(i, [float(v) / 256 for v in r], 1) for i, r in enumerate(x)] + [(900, None, 1), (950, [None] * 8, 1), (1000, [float("nan")] * 8, 1)], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in topk.top_k(topk.integer_vectors(rows), pivots=6, sample=100).collect()]
    wanted = []
    for q in range(0, 700, 50):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(700) if i != q)[:5]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == wanted
    assert topk.top_k(topk.integer_vectors(rows.where("false"))).count() == 0


@pytest.mark.parametrize("large", [2**24, 2**27, 2**31 - 4])
def test_top_k_of_large_components(spark, large, monkeypatch):
    """Beyond what 32-bit floats hold, beyond what sums of doubles hold, many equal vectors, several lengths, ties."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(large)
    wide = 2 if large < 2**30 else 1
    x = [[int(v) for v in large + rng.integers(-3, 4, wide)] for _ in range(120)] + [[large] * wide] * 60 + [[0.0]] * 5 + [[]] * 3
    rows = spark.createDataFrame([(i, [float(v) / 256 for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(topk.integer_vectors(rows), every=10, pivots=4, sample=50).collect())
    wanted = []
    for q in range(0, len(x), 10):
        best = sorted((-sum(int(a) * int(b) for a, b in zip(x[q], r)), i) for i, r in enumerate(x) if i != q and len(r) == len(x[q]) > 0)[:5]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == wanted


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (10, 2**28, 2**31):
        q, x = rng.integers(-top, top, (3, 2)), rng.integers(-top, top, (4, 2))
        assert topk.products(q, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q]
    with pytest.raises(OverflowError):
        topk.products(np.array([[2**40]]), np.array([[2**40]]))


def test_mixing(spark, odd):
    slots = mixing.rounded({"a": 3, "b": 1, "c": 1.7, "d": 0.2}, 128)
    had = dict.fromkeys(slots, 0)
    for s, _, t in mixing.schedule(slots):
        had[s] += 1
        assert all(abs(had[x] - n * (t + 1) / 128) < 1 for x, n in slots.items())
    got = mixing.mix(odd, block=2).collect()
    assert len(got) == 10 and len({(r.mix_slot, r.mix_offset) for r in got}) == 10
    many = docs(spark, [(i, "t", "big" if i % 3 else "small") for i in range(9000)])
    out = mixing.mix(many, {"big": 3, "small": 1}, block=4).orderBy("mix_slot", "mix_offset").collect()
    assert sorted(r.doc_id for r in out) == list(range(9000))
    first = out[:8000]
    assert abs(sum(r.source == "big" for r in first) - 6000) < 4
    assert mixing.mix(many.where("false")).count() == 0


@pytest.mark.parametrize("most", [1024, 3])
def test_mixing_against_brute_force(spark, most):
    rng = random.Random(most)
    names = ["a", "b", "c", "d", "e", "f", None]
    rows = [(i if i % 9 else None, f"t{i % 50}", rng.choices(names, [40, 20, 9, 5, 3, 2, 1])[0]) for i in range(700)]
    weights = {"a": 5, "b": 2.5, "c": 4, "d": 1}
    frame, period, block = docs(spark, rows), 32, 3
    got = mixing.mix(frame, weights, block=block, period=period, most=most).collect()
    assert sorted((r.doc_id or 0, r.text, r.source or "") for r in got) == sorted((i or 0, t, s or "") for i, t, s in rows)
    # weights in whole slots, by hand: each source's, or of all but the two largest together
    have = {s or "" for _, _, s in rows}
    target = {s: weights.get(s, 1) for s in have}
    unit = dict.fromkeys(have, "~")
    for s in sorted(have, key=lambda s: (-target[s], s))[: most - 1 if len(have) > most else most]:
        unit[s] = s
    sums = collections.Counter()
    for s in sorted(have):
        sums[unit[s]] += target[s]
    slots = mixing.rounded(dict(sorted(sums.items())), period)
    assert all(abs(slots[s] - sums[s] * period / sum(sums.values())) < 1 or slots[s] == 1 for s in sums)
    # slot by slot the released block with the earliest deadline, by search
    where, done = {}, collections.Counter()
    for t in range(period * 40):
        ready = [(-(-(done[s] + 1) * period // n), s) for s, n in slots.items() if done[s] * period // n <= t]
        _, s = min(ready)
        where[s, done[s]] = t
        done[s] += 1
    for r in got:
        assert r.mix_slot == where[unit[r.mix_source], r.mix_block]
    places = collections.defaultdict(list)
    for r in got:
        places[unit[r.mix_source]].append(r.mix_block * block + r.mix_offset)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    if most == 3:  # the pool's sources keep their ratio
        pool = sorted((r.mix_block * block + r.mix_offset, r.mix_source) for r in got if unit[r.mix_source] == "~")
        left = collections.Counter(s for _, s in pool)
        for k in range(1, len(pool) // 2):
            had = collections.Counter(s for _, s in pool[:k])
            assert max((had[s] - 1) / target[s] for s in left) <= min((had[s] + 1) / target[s] for s in left if had[s] < left[s])


def exclusive(rng, n):
    """Texts of common words, labelled by whether they hold exactly one of two of them."""
    words, rows = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"], []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(12)] + [w for w in ("grk", "zlt") if rng.random() < 0.5]
        rng.shuffle(text)
        rows.append((int(("grk" in text) != ("zlt" in text)), " ".join(text)))
    return rows


def test_factors_learn_what_weights_cannot():
    rng = random.Random(2)
    rows, held = exclusive(rng, 1500), exclusive(rng, 400)
    right = {}
    for k in (4, 0):
        model = toxicity.fit([(label, toxicity.terms_of(t)) for label, t in rows], n_factors=k)
        right[k] = np.mean((model.scores([t for _, t in held]) >= 0.5) == [label for label, _ in held])
    assert right[4] > 0.95 and right[0] < 0.8


def test_toxicity(spark, odd):
    """An insult with the mention of a group is toxic, each by itself is not; rows learned from are never those held out."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(12)] + (["grk", "zlt"] if toxic else rng.choice([["grk"], ["zlt"], []]))
        rng.shuffle(text)
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(toxic) if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - int(toxic)))
    d = docs(spark, rows)
    l = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, l)
    got = toxicity.score(d, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in got if r.held_out]) > 0.95
    some = toxicity.score(odd, model).collect()
    assert len(some) == 10 and len({r.score for r in some if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in some if r.doc_id in (4, 5)}) == 1
    left = toxicity.reject(odd.unionByName(d.where("doc_id >= 100")), model)
    kept = {r.doc_id for r in got if not r.predicted and r.doc_id >= 100}
    assert {r.doc_id for r in left.collect() if r.fp == "x" and (r.doc_id or 0) >= 100} == kept and left.columns == odd.columns
    assert toxicity.reject(odd.where("false"), model).count() == 0
    none = toxicity.train(odd, l.where("false"))
    assert toxicity.score(odd, none).where("predicted = 1").count() == 0 and toxicity.reject(odd, none).count() == 10


def test_toxicity_held_out_recall(spark):
    """On labelled rows of the middle table that were not learned from."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op2_toxicity_fm(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.015


def test_decontaminate(spark, odd):
    b = spark.createDataFrame([(7, "and Jim has 3 apples and Sue gives him 2 kg more, how many apples does Jim have now?", 1), (8, "hm", 1), (9, None, 1), (None, "x y", 1)], "item_id long, text string, h int")
    ask = "well so {} has {} apples and {} gives him 9 kg more , how many apples does {} have now ?"
    rows = [(1, ask.format("Bob", 77, "Eve", "Bob"), "s"), (2, ask.format("Bob", 77, "Eve", "Joe"), "s"), (3, "apples are more now", "s"), (4, None, "s"), (None, ask.format("Al", 1.5, "Zoe", "Al"), "s"), (5, "Hm", "s")]
    got = {r.doc_id: list(r["items"]) for r in decontaminate.contaminated(docs(spark, rows), b).collect()}
    assert got[1] == [7] and got[3] == [] and got[4] == [] and got[5] == [8]
    assert got[2] == []  # the asked-for name is not the one that had the apples
    assert decontaminate.clean(odd, b).count() == 10
    assert decontaminate.contaminated(odd.where("false"), b.where("false")).count() == 0


def test_decontaminate_names_that_open_sentences(spark):
    ask = "{0} has {2} apples. {1} gives him {3} more apples. {0} then eats {4} of them. How many apples does {0} have now?"
    b = spark.createDataFrame([(1, ask.format("Jim", "Sue", 3, 2, 1)), (2, "The cat sat on the mat. Then the dog came home.")], "item_id long, text string")
    rows = [
        (1, ask.format("Bob", "Eve", 7, 8, 5), "s"),
        (2, "intro words. \"" + ask.format("Bob", "Eve", 7, 8, 5).replace("How", "how") + "\"", "s"),
        (3, "Bob has 7 apples. Eve gives him 8 more apples. Al then eats 5 of them. How many apples does Joe have now?", "s"),
        (4, "we saw the cat sat on the mat. then the dog came home.", "s"),
        (5, "A. B. C. D. E. F. NEW YORK TIMES", "s"),
    ]
    got = {r.doc_id: list(r["items"]) for r in decontaminate.contaminated(docs(spark, rows), b).collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [2], 5: []}


def test_decontaminate_judges_each_copy(spark):
    ask = "so {} has {} apples and {} gives him {} kg more , how many apples does {} have now ?"
    b = spark.createDataFrame([(7, ask.format("Jim", 3, "Sue", 2, "Jim"))], "item_id long, text string")
    good, bad, one = ask.format("Bob", 7, "Eve", 8, "Bob"), ask.format("Al", 7, "Eve", 8, "Joe"), ask.format("Bob", 7, "Bob", 8, "Bob")
    rows = [(1, good + " " + bad, "s"), (2, bad + " " + good, "s"), (3, bad, "s"), (4, one, "s"), (5, good + " " + good, "s"), (6, bad + " " + bad, "s")]
    rows += [(7, ask.format("Bob", 7, "Eve", 7, "Bob"), "s"), (8, ask.format("Mary Ann Lee", 7, "Eve", 8, "Mary Ann Lee"), "s")]
    rows += [(9, good, "s"), (9, "another text", "s"), (None, good, "s"), (None, "no item", "s"), (None, None, "s")]
    # half of the item in one place and half in another are no copy
    rows.append((10, good[: len(good) // 2] + " filler" * 30 + " " + good[len(good) // 2 :], "s"))
    found = decontaminate.contaminated(docs(spark, rows), b).collect()
    assert {r.doc_id for r in found if r.contaminated} - {8} == {1, 2, 5, 7, 9, None}
    assert sum(r.contaminated for r in found if r.doc_id in (9, None)) == 2 and len(found) == len(rows)
    left = decontaminate.clean(docs(spark, rows), b)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.where("doc_id is null or doc_id = 9").collect()) == [(0, ""), (0, "no item"), (9, "another text")]
    assert left.columns == docs(spark, rows).columns


def plain_terms(text):
    """(type, value) of each term: words, numbers (d), units after them (u), names (n) and openers (o), by hand."""
    out, units = [], set(decontaminate.UNITS)
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text):
        t, before = m[0], text[: m.start()]
        if t[0].isdigit():
            out.append(("d", t))
        elif out and out[-1][0] == "d" and t.lower() in units and re.search(r"\d ?$", before):
            out.append(("u", t.lower()))
        elif t[0].isupper():
            out.append(("n" if re.search(r"[a-z\d,;:] $", before) else "o", t.lower()))
        else:
            out.append(("w", t.lower()))
    return out


def plain_holds(text, item, width=5):
    """The docstring's rule, over all pairs of windows and all copies."""
    d, q = plain_terms(text), plain_terms(item)
    width = min(width, len(q))

    def choices(terms):
        sets = [{(k, v)} if k == "w" else {("w", v), ("n", "")} if k == "o" else {(k, "")} for k, v in terms]
        return set(itertools.product(*sets))

    word = lambda terms: tuple(("w", v) if k in "ow" else (k, "") for k, v in terms)
    ours = [choices(q[i : i + width]) for i in range(len(q) - width + 1)]
    total = len({word(q[i : i + width]) for i in range(len(ours))})
    hits = [(i, j) for j in range(len(d) - width + 1) for i, c in enumerate(ours) if c & choices(d[j : j + width])]
    diagonals, runs = sorted({j - i for i, j in hits}), []
    for x in diagonals:
        if runs and x - runs[-1][-1] <= 3:
            runs[-1].append(x)
        else:
            runs.append([x])
    kind = lambda k: "n" if k == "o" else k
    opens = {v: all(k == "o" for k, w in q if w == v and k != "w") for k, v in q if k != "w"}
    for copy in [[x] for x in diagonals] + runs:
        mine = [(i, j) for i, j in hits if j - i in copy]
        if len({word(q[i : i + width]) for i, _ in mine}) < 0.8 * total:
            continue
        places = {(i + k, j + k) for i, j in mine for k in range(width)}
        pairs = [(kind(q[a][0]), q[a][1], d[b][1]) for a, b in places if q[a][0] != "w" and kind(q[a][0]) == kind(d[b][0]) and not (opens[q[a][1]] and q[a][1] == d[b][1])]

        def share(pairs, by):
            groups = {}
            for p in pairs:
                groups.setdefault((p[0], p[by]), collections.Counter())[p[3 - by]] += 1
            groups = [g for g in groups.values() if sum(g.values()) > 1]
            return sum(max(g.values()) for g in groups) / sum(sum(g.values()) for g in groups) if groups else 1

        if share(pairs, 1) >= 0.8 and share([p for p in pairs if p[0] == "n"], 2) >= 0.8:
            return True
    return False


@pytest.mark.parametrize("opening", ["", "the boy reads and "])
def test_decontaminate_against_brute_force(spark, monkeypatch, opening):
    rng = random.Random(12)
    pool = ["Jim", "Sue", "Bob", "3", "4 kg", "2.5", "apples", "gives", "has", "to", "and", "the", "boy", "reads"]

    def text(n):
        parts = [rng.choice(pool) for _ in range(n)]
        return " ".join(p + rng.choice(["", "", "", ".", ",", " \""]) for p in parts)

    items = [opening + text(rng.randint(1, 14)) for _ in range(12)]
    texts = []
    for item in items:
        for _ in range(8):
            swap = dict(zip(["Jim", "Sue", "Bob", "3", "apples"], rng.sample(["Al", "Zoe", "Jim", "Sue", "7", "pears", "Eve"], 5))) if rng.random() < 0.7 else {}
            copies = [re.sub(r"\w+", lambda m: swap.get(m[0], m[0]) if rng.random() < 0.9 else m[0], item) for _ in range(rng.randint(1, 3))]
            texts.append(rng.choice([" ", ". ", " and "]).join([text(rng.randint(0, 6)), *copies, text(rng.randint(0, 6))]).strip())
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts + ["no such words", None, ""])])
    words = decontaminate._filled(decontaminate._terms(b, "item_id"))
    asked = decontaminate._windows(words, [1, 2, 3, 4, 5], "item_id", base=True).where("h is not null").withColumnsRenamed({"at": "item_at"})
    assert bool(opening) == (decontaminate._telling(rows, words, asked.where("size = 5") if opening else asked, 0.8) is not None)
    got = {r.doc_id: list(r["items"]) for r in decontaminate.contaminated(rows, b).collect()}
    monkeypatch.setattr(decontaminate, "TELLING", 0)  # all texts are read
    assert got == {r.doc_id: list(r["items"]) for r in decontaminate.contaminated(rows, b).collect()}
    want = {i: [k for k, item in enumerate(items) if plain_holds(t, item)] for i, t in enumerate(texts)} | {len(texts) + i: [] for i in range(3)}
    assert 10 < sum(map(len, want.values())) and got == want


def test_licenses(spark, odd):
    model = licenses.train(odd)
    rows = [(1, "foo\nReleased under the MIT License.\nbar", "s"), (2, "Licensed under CC BY-NC 4.0.", "s"), (3, "the license of the software is unclear", "s"), (4, None, "s"), (None, "Licensed under the Apache License, Version 2.0.", "s"), (None, "nothing", "s")]
    rows += [(5, "Licensed under the Blatt License, Version 2.0.", "s"), (6, "MIT License\n\nCopyright (c) 2020", "s"), (7, "the MIT License server is down", "s"), (2, "no notice under this id", "s"), (1, rows[0][1], "s")]
    got = sorted(((r.doc_id or 0, tuple(r.licenses), r.notices) for r in licenses.scan(docs(spark, rows), model).collect()), key=str)
    assert got == sorted([(1, ("MIT",), 1), (1, ("MIT",), 1), (2, ("CC-BY-NC",), 1), (2, (), 0), (3, (), 0), (4, (), 0), (0, ("Apache-2.0",), 1), (0, (), 0), (5, (), 0), (6, ("MIT",), 1), (7, (), 0)], key=str)
    assert licenses.scan(odd, model).count() == 10
    assert licenses.scan(odd.where("false"), licenses.train(odd.where("false"))).count() == 0


def wrapped(text, width, sign):
    lines, line = [], sign
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = sign
        line += " " + word
    return "\n".join([*lines, line])


def test_licenses_of_wrapped_and_unseen_notices(spark):
    """Texts in lines of 60 to 80 columns, in comment signs; notices in frames that no template has; prose around them."""
    rng = random.Random(3)
    prose = ["the river runs under the old bridge", "a program of public works was agreed to", "she read the notice and the terms of the contract", "use of the source is free to all persons"]
    model = licenses.Classifier(prose * 20)
    texts, want = [], []
    for family, some in licenses.TEXTS.items():
        for text in some:
            for width, sign in ((60, ""), (72, " *"), (80, "//"), (76, "#")):
                texts.append("\n".join([rng.choice(prose), "", wrapped(text, width, sign), "", rng.choice(prose)]))
                want.append([family])
    seen = len(texts)
    for family, names in licenses.NAMES.items():
        for name in names:
            for frame in ("You may use it: it is licensed under the terms of {}", "Copyright 2021 by us. Released under {}, see the file", "All files are distributed under {} unless stated otherwise"):
                texts.append(rng.choice(prose) + "\n" + frame.format(name if name.startswith("CC ") else "the " + name) + "\n" + rng.choice(prose))
                want.append([family])
    n = len(texts)
    texts += prose + ["licensed under the " + w + " license version 2.0" for w in ("Bakery", "Fishing", "Driver")] + [". ".join(prose) * 3]
    want += [[]] * (len(texts) - n)
    found = {r.doc_id: list(r.licenses) for r in licenses.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()}
    right = [found[i] == w for i, w in enumerate(want)]
    assert np.mean(right[:seen]) >= 0.95 and np.mean(right[seen:n]) >= 0.9 and all(right[n:]), [(texts[i], found[i]) for i, ok in enumerate(right) if not ok]


def test_license_notices_against_brute_force(spark):
    """The scan's paragraphs, probabilities and shares by loops."""
    rng = random.Random(8)
    model = licenses.Classifier(["some lines of prose", "others of the kind"] * 30)
    every = licenses.templates()
    pieces = [" ".join(w) for _, w, _ in every] + ["", "", "and so it is", "of the software", "the license"]
    texts = ["\n".join(rng.choice(pieces) if rng.random() < 0.7 else " ".join(rng.choice(pieces).split()[: rng.randint(1, 9)]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    telling, number, want = set(licenses.telling_words()), {g: i for i, g in enumerate(model.features)}, set()
    for i, text in enumerate(texts):
        lines = [licenses.words_of(line) for line in text.split("\n")]
        for at, own in enumerate(lines):
            if not telling & set(own):
                continue
            first, last = at, at
            while first > max(0, at - licenses.REACH) and lines[first - 1]:
                first -= 1
            while last < min(len(lines) - 1, at + licenses.REACH) and lines[last + 1]:
                last += 1
            for words in (own, [w for line in lines[first : last + 1] for w in line]):
                z = (model.bias + sum((model.weights[number[g]].astype(float) for g in set(licenses.grams(words)) if g in number), np.zeros(len(model.bias)))) / model.temperature
                p = np.exp(z - z.max())
                family = model.families[int(p.argmax())]
                if family == licenses.UNKNOWN or p.max() / p.sum() < 0.5:
                    continue
                have, shares = licenses.two_grams(words), collections.Counter()
                for f, t, title in every:
                    part = len(have & licenses.two_grams(t)) / len(licenses.two_grams(t))
                    shares[f] = max(shares[f], part if not title or (part == 1 and len(words) == len(t)) else 0)
                if shares[family] >= 0.6 and shares[family] == max(shares.values()):
                    want.add((i, at, family))
    got = licenses.notices(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()
    assert len(want) > 60 and {(r["_id"], r.line, r.family) for r in got} == want


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://sub.example.org/en/2", "ftp://x.com/fr/a#b", "no scheme", None, "http://notexample.org", "http://h.net/de/5", "http://com/de/", "x://y?z/q", "://"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(rows).collect()}
    rule = [got[i].rule for i in range(len(urls))]
    assert rule == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", None, None, None, None, "com/de/", None, None]
    assert [(got[i].host, got[i].path) for i in (0, 1, 4, 5, 6, 9, 10)] == [("a.example.org", "/es/1"), ("example.org", "/en/12"), ("", ""), ("", ""), ("notexample.org", ""), ("y", ""), ("", "")]
    many = spark.createDataFrame([(i, f"http://h{i % 3}.net/{'bad' if i % 2 else 'good'}/{i}", (i % 2) if i < 200 else None) for i in range(300)], "page_id long, url string, label int")
    found = url_filter.judge(many, rules=(), label="label").collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in found)
    assert url_filter.judge(rows.where("false")).count() == 0


def test_urls_deep_and_rare_sections(spark):
    deep = [f"http://d.net/a/b/c/d/{'spam' if i % 2 else 'news'}/{i}" for i in range(60)]
    rare = ["bad"] * 12 + [f"ok{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60) for _ in range(3)]
    hot = [f"http://h.net/{s}/{i}" for i, s in enumerate(rare)] + [f"http://h.net/good/{i}" for i in range(2800)]
    urls = [(u, int("spam" in u or "/bad/" in u)) for u in deep + hot]
    rows = spark.createDataFrame([(i, u, bad if i % 2 or i % 4 == 0 else None) for i, (u, bad) in enumerate(urls)], "page_id long, url string, label int")
    found = {r.page_id: r.verdict for r in url_filter.judge(rows, rules=(), label="label").collect()}
    assert found == {i: "block" if bad else "allow" for i, (_, bad) in enumerate(urls)}


def test_urls_merge_similar_branches(spark):
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.55, "e": 0.95, "f": 1.0}
    urls = [(f"http://h.net/{s}/x{i}", int(i < 40 * share)) for s, share in shares.items() for i in range(40)]
    urls += [("http://h.net/" + "/".join("pq"[k % 2] for k in range(3000)), 0), ("http://h.net//a//x1/", 0)]
    rows = spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "page_id long, url string, label int")
    found = url_filter.judge(rows.unionByName(rows), rules=(), label="label").collect()
    assert len(found) == 2 * len(urls)
    by = {(r.path.split("/")[1], r.template, r.verdict) for r in found if r.page_id < 240}
    assert {(s, t.split("/")[1]) for s, t, _ in by} == {("a", "~a"), ("b", "~a"), ("c", "~c"), ("d", "~c"), ("e", "~e"), ("f", "~e")}
    assert {s for s, _, v in by if v == "block"} == {"e", "f"}


def test_urls_against_brute_force(spark):
    """Hosts, templates, merging and purities by loops over all urls."""
    rng = random.Random(5)
    apart = lambda l, b, m, c: l > 0 and m > 0 and abs(b / l - c / m) > 2.58 * math.sqrt((p := (b + c + 0.5) / (l + m + 1.0)) * (1 - p) * (1 / l + 1 / m))
    urls = []
    for i in range(900):
        host, parts = f"h{rng.choice([0, 0, 0, 1, 2])}.net", [rng.choice("abcdefg") for _ in range(rng.randint(0, 3))] + ["7"] * rng.randint(0, 1)
        chance = 0.9 if parts[:1] in (["a"], ["b"]) else 0.6 if "c" in parts else 0.05
        urls.append((host, parts, None if rng.random() < 0.4 else int(rng.random() < chance)))
    typed = [(h, ["{N}" if s == "7" else s for s in parts], label) for h, parts, label in urls]

    def counts(keys):
        out = {}
        for key, label in keys:
            n, l, b = out.get(key, (0, 0, 0))
            out[key] = n + 1, l + (label is not None), b + (label or 0)
        return out

    here = counts(((h, i, tuple(p[:i]), p[i]), label) for h, p, label in typed for i in range(len(p)))
    level = counts(((h, i, p[i]), label) for h, p, label in typed for i in range(len(p)))
    host = collections.Counter(h for h, _, _ in typed)

    def differs(key, table, sibling):
        n, l, b = table[key]
        total = [sum(v[i] for k, v in table.items() if sibling(k) == sibling(key)) for i in (1, 2)]
        return n >= 3 and l >= 3 and apart(l, b, total[0] - l, total[1] - b)

    common = {k for k, (n, _, _) in level.items() if (n >= 3 and n >= 0.01 * host[k[0]]) or differs(k, level, lambda k: k[:2])}
    stay = {k for k in here if k[3][0] != "{" and ((k[0], k[1], k[3]) in common or differs(k, here, lambda k: k[:3]))}
    part, by = {}, collections.defaultdict(list)
    for k in stay:
        _, l, b = here[k]
        part[k] = k[3]
        if l:
            by[k[:3]].append((b / l, k[3], l, b))
    for parent, some in by.items():
        runs = []
        for x in sorted(some):
            last = runs[-1][-1] if runs else None
            if last and not apart(x[2], x[3], last[2], last[3]) and (x[0] >= 0.6) == (last[0] >= 0.6):
                runs[-1].append(x)
            else:
                runs.append([x])
        for run in runs:
            for x in run:
                part[(*parent, x[1])] = "~" + min(y[1] for y in run) if len(run) > 1 else x[1]
    templates = [[s if s[0] == "{" else part.get((h, i, tuple(p[:i]), s), "*") for i, s in enumerate(p)] for h, p, _ in typed]
    nodes = counts(((h, tuple(t[:i])), label) for (h, _, label), t in zip(typed, templates) for i in range(len(t) + 1))
    over = counts((tuple(t[:i]), label) for (_, _, label), t in zip(typed, templates) for i in range(len(t) + 1))
    own = set()
    for (h, t), (_, l, b) in nodes.items():
        share = (over[t][2] + 0.5) / (over[t][1] + 1.0)
        if l and abs(b / l - share) > 2.58 * math.sqrt(share * (1 - share) / l):
            own.add((h, t))
    rest = counts((tuple(t[:i]), label) for (h, _, label), t in zip(typed, templates) for i in range(len(t) + 1) if (h, tuple(t[:i])) not in own)
    want = {}
    for k, ((h, _, _), t) in enumerate(zip(typed, templates)):
        purity, speaks = 0.0, ()
        for i in range(len(t) + 1):
            node = tuple(t[:i])
            _, l, b = nodes[h, node] if (h, node) in own else rest[node]
            if l >= 3:
                purity, speaks = (b + 4.0 * purity) / (l + 4.0), node
        want[k] = "/" + "/".join(speaks), round(purity, 9), "block" if purity >= 0.6 else "allow"
    rows = spark.createDataFrame([(i, f"http://{h}/" + "/".join(p), label) for i, (h, p, label) in enumerate(urls)], "page_id long, url string, label int")
    got = {r.page_id: (r.template, r.purity, r.verdict) for r in url_filter.judge(rows, rules=(), label="label").collect()}
    assert {v for _, _, v in want.values()} == {"block", "allow"} and any("~" in t for t, _, _ in want.values())
    assert len(got) == len(want) and all(got[k][0] == w[0] and got[k][2] == w[2] and got[k][1] == pytest.approx(w[1], abs=1e-8) for k, w in want.items())


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    before = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = out.collect()
    assert 0 < len(rows) < len(before) and out.columns == [*corpus_pipeline.COLUMNS, "mix_block", "mix_slot", "mix_offset"]
    for r in rows:  # what stays is what was there, less whole passages
        assert r.source == before[r.doc_id].source and r.lang == before[r.doc_id].lang
        assert r.n_chars == len(r.text or "") and len(r.text or "") <= len(before[r.doc_id].text or "")
    assert len({(r.mix_slot, r.mix_offset) for r in rows}) == len(rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels that call what holds one word toxic, and a benchmark of one item."""
    home = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (6, None)], "doc_id long, toxic int").write.parquet(str(home / "labels.parquet"))
    spark.createDataFrame([(1, "how many apples does Jim have if he had 3 and ate 2 of them"), (None, "x")], "item_id long, text string").write.parquet(str(home / "benchmark.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(home / f"{name}.parquet")).where("false").write.parquet(str(home / "empty" / f"{name}.parquet"))
    return str(home)


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_on_awkward_rows(spark, odd, folder, stage):
    """Nulls in all columns, empty, blank and very long texts, repeated rows and ids, ties, clashing columns, empty tables."""
    name, run = corpus_pipeline.STAGES[stage]
    taught = [(1000 + i, ("zap " if i % 3 == 0 else "") + " ".join(f"w{(i * 7 + j * j) % 91}" for j in range(15)), "s") for i in range(300)]
    rows = odd.unionByName(docs(spark, [(None, None, None), *taught] if stage == 0 else [(None, None, None)]))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(1) for c in ("root", "row", "_row", "_id", "size", "salt", "gram", "mix_slot", "item_id")})
    out = run(spark, rows, folder)
    assert out.columns[:5] == corpus_pipeline.COLUMNS and (stage == 4 or len(out.columns) == 5)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    every = sorted(((r.doc_id, r.text) for r in rows.collect()), key=str)
    if stage == 0:
        assert got == [r for r in every if not (r[1] or "").startswith("zap")]
    elif stage == 1:  # of the texts without words the one with the least id, of the long ones and of the repeated ones one
        assert [i for i, _ in got] == [1, 4, 6, 9, None]
    elif stage == 2:  # of the two long texts one is left, and empty ones as they were; short texts stay
        assert sorted(((i, t or "") for i, t in got), key=str) == sorted(((i, t or "") for i, t in every if i != 5), key=str)
    else:
        assert got == every
    nothing = run(spark, rows.where("false"), f"{folder}/empty")
    assert nothing.count() == 0
    if stage in (0, 3):
        assert run(spark, rows, f"{folder}/empty").count() == rows.count()


def test_cut_passages_by_whole_characters(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("aé漢🙂\ufffd ") for _ in range(80))
    rows = [(i, "".join(rng.choice("xyzé漢\ufffd") for _ in range(rng.randint(0, 60))) + passage[rng.randint(0, 3) :] + rng.choice("qé🙂"), "s") for i in range(20)]
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, docs(spark, rows), SF).collect()}
    raw = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
    for i, text, _ in rows:
        # a character is kept if all its bytes are
        data, at, want = text.encode(), 0, ""
        gone = [any(a <= k < b for a, b in zip(raw[i].starts, raw[i].ends)) for k in range(len(data))]
        for c in text:
            n = len(c.encode())
            want += "" if any(gone[at : at + n]) else c
            at += n
        assert (i in got) == bool(want) and (not want or (got[i].text, got[i].n_chars) == (want, len(want) if any(gone) else None))
    assert sum(len(r.starts) > 0 for r in raw.values()) >= 18


def test_benchmark_leaks_go_whole(spark, folder):
    item = "how many apples does Jim have if he had 3 and ate 2 of them"
    rows = [(1, "intro " + item, "s"), (2, item.replace("Jim", "Bob").replace("3", "8"), "s"), (3, "how many apples are there", "s"), (3, item, "s"), (None, "clean", "s")]
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_benchmark_leaks(spark, docs(spark, rows), folder).collect()) == [(0, "clean"), (3, "how many apples are there")]


@pytest.mark.parametrize("stage", [0, 1, 2])
def test_stages_give_workers_small_batches(spark, folder, stage):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    spark.conf.unset(limit)
    try:
        few = docs(spark, [(i, f"text {i}", "s") for i in range(5)])
        corpus_pipeline.STAGES[stage][1](spark, few, SF).collect()
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"]) for b in batches)
        got = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 2000) as text").mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 9000 and max(r.size for r in got) < 1.1 * common.BATCH_BYTES
        spark.conf.set(limit, "1000000")
        corpus_pipeline.STAGES[stage][1](spark, few, SF)
        assert spark.conf.get(limit) == "1000000"
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def test_pieces_give_freed_memory_back():
    # blocks that glibc takes from its heap, under one that stays
    code = """
import pathlib, re
from mirrorfield.llm.common import pieces
used = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", pathlib.Path("/proc/self/status").read_text())[1]) // 1024
blocks = [bytearray(100_000) for _ in range(2000)]
top = blocks.pop()
blocks.clear()
before = used()
assert list(pieces([])) == []
print(before - used())
"""
    if not platform.libc_ver()[0] == "glibc":
        pytest.skip("only glibc keeps it")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(corpus_pipeline.__file__).parent)
    assert int(out.stdout) > 100
