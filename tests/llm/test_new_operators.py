"""Packing, Merkle manifest and phrase mining against brute force, on hand-made tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import merkle, packing, phrases, queries, token_files

WORD_BPE = queries.tokenizer(queries.WORD_BPE)


def counts_of(lengths, size):
    return np.bincount(lengths, minlength=size + 1)


def fewest(lengths, size):
    """Sequences that a full search needs."""
    best = len(lengths)

    def search(rest, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if not rest:
            best = len(gaps)
            return
        n = rest[0]
        for i in range(len(gaps)):
            if gaps[i] >= n and gaps.index(gaps[i]) == i:
                search(rest[1:], [*gaps[:i], gaps[i] - n, *gaps[i + 1:]])
        search(rest[1:], [*gaps, size - n])

    search(sorted(lengths, reverse=True), [])
    return best


def first_fit(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else size) - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once_and_few_sequences(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 16, 64])
    lengths = [rng.randrange(1, size + 1) for _ in range(9)]
    plan = packing.plan(counts_of(lengths, size))
    used = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(x * n for x, n in pattern) <= size
        for x, n in pattern:
            used[x] += n * times
    assert used == Counter(lengths)
    assert sum(t for _, t in plan) <= fewest(lengths, size) + 1


def test_plan_is_no_worse_than_best_fit_and_nearly_full():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 1500), np.clip(rng.lognormal(6, 1.2, 4000).astype(int), 1, 2048), rng.integers(300, 1200, 1500)):
        n = sum(t for _, t in packing.plan(counts_of(lengths, 2048)))
        assert -(-int(lengths.sum()) // 2048) <= n <= first_fit(lengths.tolist(), 2048)


def test_plan_fills_gaps_by_one_two_and_three():
    assert packing.plan(counts_of([16], 16)) == [([(16, 1)], 1)]
    assert sum(t for _, t in packing.plan(counts_of([9, 7, 10, 4, 2, 9, 3, 2, 2], 16))) == 3
    assert packing.plan(np.zeros(17, int)) == []
    assert packing.plan(counts_of([1] * 1000, 16)) == [([(1, 16)], 62), ([(1, 8)], 1)]


def test_slots_give_every_piece_its_own_place():
    rng = random.Random(5)
    lengths = [rng.randrange(1, 65) for _ in range(2000)]
    slots = packing.Slots(packing.plan(counts_of(lengths, 64)))
    seen, places = Counter(), defaultdict(list)
    for n in lengths:
        sequence, offset = slots.place(np.array([n]), np.array([seen[n]]))
        seen[n] += 1
        places[int(sequence[0])].append((int(offset[0]), n))
    assert sorted(places) == list(range(slots.sequences))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64


def check_packed(rows, size):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n >= 1
            at += n
        assert at <= size
    return len(places)


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    texts = {1: "one two, three!", 2: "one two, three!", 3: "", 4: None, 5: "word " * 900, 6: "ab cd " * 30, 7: " \n\t", 8: "Été ÇA'S 12 中文 <|endoftext|>"}
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in texts.items()] + [(None, "a b", "x", 7), (1, "one two, three!", "y", 7)],
                                 "doc_id long, text string, piece string, length int")
    size = 64
    rows = packing.packed(docs.repartition(3), WORD_BPE, size, 0).collect()
    assert check_packed(rows, size) == -(-sum(r.length for r in rows) // size)
    want = Counter()
    for i, t in [*texts.items(), (None, "a b"), (1, texts[1])]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(-(-len(ids) // size)):
            own = ids[p * size:(p + 1) * size]
            want[i, p, p * size, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == want
    whole = packing.sequences(spark.createDataFrame(rows)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in rows) and all(len(r.ids) <= size for r in whole)
    by_place = {(r.sequence_id, r.offset): r.ids for r in rows}
    for r in whole:
        assert r.ids == [x for o in r.offsets for x in by_place[r.sequence_id, o]]


def test_pack_any_rows(spark):
    rng = random.Random(1)
    pieces = spark.createDataFrame([(i, rng.choice([700, 700, 31, 2048, 1348]), i) for i in range(3000)], "id long, length int, offset long").repartition(7)
    rows = packing.pack(pieces).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    check_packed(rows, 2048)
    assert packing.pack(spark.createDataFrame([], "length int")).collect() == []
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(spark.createDataFrame([(0,)], "length int")).collect()


@pytest.mark.parametrize("text", ["don't we'll x's", "a<|endoftext|>b", "...!?", "É È ÿ ß µ ª º ŸŒ", "ﬁ ǅ İ ı Σς", "é àb", "\x1c\x85 x　y", "42 4two 中文字 🙂", "*** (a) \"b\" #c &d $e %f '"])
def test_run_encoder_equals_library(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    encoder = token_files.run_encoder(WORD_BPE)
    assert encoder.by_word
    column = pa.array(["", *[" ".join(p) for p in itertools.permutations(text.split(" ")[:4])], text, None])[1:]
    ids, off = encoder.encode(column)
    for i, t in enumerate(column.to_pylist()):
        assert ids[off[i]:off[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(hashes):
    paths, members, level = [[] for _ in hashes], [[i] for i in range(len(hashes))], list(hashes)
    while len(level) > 1:
        above, joined = [], []
        for at in range(0, len(level), 16):
            run = level[at:at + 16]
            for j in range(len(run)):
                for leaf in members[at + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(sha("".join(run)))
            joined.append([x for m in members[at:at + 16] for x in m])
        level, members = above, joined
    return level[0], paths


def whole_tree(rows):
    groups = defaultdict(list)
    for g, o, h in rows:
        groups[g].append((o is not None, o or 0, h))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([h for *_, h in sorted(groups[g])]) for g in names}
    root, paths = tree([below[g][0] for g in names])
    return Counter((g, h, below[g][0], root, tuple(p + paths[i])) for i, g in enumerate(names) for (*_, h), p in zip(sorted(groups[g]), below[g][1], strict=True))


@pytest.mark.parametrize("sizes,copies", [({"a": 1}, 0), ({"a": 3, "b": 17, None: 16, "é": 300, "": 2}, 40), ({f"s{i}": 1 + i % 3 for i in range(40)}, 0), ({"a": 4097, "b": 4096}, 0)])
def test_manifest_equals_brute_force(spark, sizes, copies):
    rows = [(g, i if i % 7 or g == "a" else None, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)] + [("copies", 5, sha("c"))] * copies
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "root string, hash long, leaf string").withColumn("proof", F.lit(1)).repartition(3)
    got = merkle.manifest(table, "root", ["hash"], "leaf", carry=["hash"]).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert Counter((r.group, r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.proof)) for r in got) == whole_tree(rows)
    assert all(r.again == r.root for r in got)


def test_manifest_of_nothing_and_tampering(spark, tmp_path):
    assert merkle.manifest(spark.createDataFrame([], "g string, o long, leaf string"), "g", ["o"], "leaf").collect() == []
    docs = [(i, None if i % 5 == 0 else "Ab É " * (i % 3), "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, i) for i in range(60)] + [(None, "X", "en", "s1", 1), (70, "long " * 50_000, "en", "s1", None)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    got = queries.QUERIES["op12_merkle_manifest"](spark, path).collect()

    def leaf(i, t, lang, s, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, lang, n, t)))

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_leaf = {leaf(i, t, lang, s, n): (i, leaf(i, t.translate(low) if t and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t, lang, s, n)) for i, t, lang, s, n in docs}
    want = Counter()
    for (_, h, subroot, root, proof), times in whole_tree([(s, i, leaf(i, t, lang, s, n)) for i, t, lang, s, n in docs]).items():
        i, now = by_leaf[h]
        for left, right in proof:
            now = sha(left + now + right) if left or right or len(proof) else now
        want[i, h, subroot, root, sha("".join(a + b for a, b in proof)), now, now == root] += times
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == want
    assert {r.verified for r in got} == {True, False}


def mined(rows, least, top):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]", piece) if x]
            words[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in counts.items():
        candidates = {p for p, a in c.items() if a >= least and len(p) > 1}
        ranked = []
        for p in candidates:
            if any(len(q) > len(p) and 100 * c[q] >= 80 * c[p] and any(q[i:i + len(p)] == p for i in range(len(q))) for q in candidates):
                continue
            score, _, left, right = min((2_000_000 * c[p] // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -c[p], " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    words = ["the", "of", "The", "à", "été", "x", "in", "York", "city", "\x00q", "a\xa0b", "中"]
    stops = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r", "!", "\x0b"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice(stops) for _ in range(n))

    rows = [(rng.choice(["en", "fr", None, ""]), text(rng.randrange(60))) for _ in range(150)]
    return [*rows, ("en", None), (None, None), ("en", ""), ("de", "one two"), ("en", text(3000)), ("en", "new york city hall " * 40), rows[0], rows[0]]


@pytest.mark.parametrize("least,top", [(3, 50), (30, 2000)])
def test_collocations_equal_brute_force(spark, talk, least, top):
    table = spark.createDataFrame([(lang, t, 1, "x") for lang, t in talk], "lang string, text string, n int, phrase string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(table, top=top, least=least).collect())) == mined(talk, least, top)


def test_stripes_of_hot_prefixes_and_full_bit_maps(spark, talk, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 1_000_000)  # every prefix is split
    monkeypatch.setattr(phrases, "MOST_BITS", 64)  # nearly every phrase is a false hit
    table = spark.createDataFrame(talk, "lang string, text string").repartition(2)
    assert sorted(map(tuple, phrases.collocations(table, top=30, least=4).collect())) == mined(talk, 4, 30)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", " \n ")], "lang string, text string")).collect() == []
