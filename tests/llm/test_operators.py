"""Operators of the training-data subpackage against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from munjang.llm import bpe, catalog, components, fingerprints, htmltext, jaccard, kernels, packing, pivots, quality, shared, substring, tokenfiles, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, part int, kind string, blob string, y double, label string"


def docs(spark, *rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "k", "b", 0.5, "x") for r in rows], SCHEMA)


def awkward():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "한국어", "😀", "a,b", "THE", "the"]
    text = lambda n: " ".join(r.choices(words, k=n))
    base, long = text(80), text(6000)
    near = base.split()
    near[40] = "zzz"
    return [
        (1, base), (2, base.upper()), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  two"), (9, long), (10, long + " tail"), (11, text(30) + " " + base[:150]),
        (11, text(30)), (12, base), (12, base), (None, base), (None, None), (-5, text(200)), (20, "x" * 5000), (21, "a " * 400), (22, "a " * 400 + "b"),
    ]


def words_of(text, lower=False):
    w = WORD.findall(text or "")
    return [x.translate({i: i + 32 for i in range(65, 91)}) for x in w] if lower else w


def shingle_set(text, lower=True):
    w = words_of(text, lower)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, same, name):
    same(catalog.queries()[name](spark, DATA).toPandas(), duck(catalog.oracle_sql()[name]))


def test_kernels_see_words_as_the_pattern_does():
    import pyarrow as pa

    texts = [t for _, t in awkward()] + ["a\x0bb\x0cc\rd", " x　y", " lead", "trail "]
    data, offsets = kernels.string_buffers(pa.array(texts))
    w = kernels.Words(data, offsets)
    got = [bytes(data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in words_of(t)]
    sets = [len(x) for x in kernels.document_shingles(pa.array(texts))]
    assert sets == [len(shingle_set(t)) for t in texts]
    for values in (np.arange(0, 10**6, 977, dtype=np.uint64), np.array([5, 2**63], np.uint64), np.zeros(1, np.uint64)):
        assert (kernels.unpack_sorted(kernels.pack_sorted(values)) == values).all() and (kernels.unpack(kernels.pack(values), np.uint64) == values).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(r.getrandbits(60), r.getrandbits(60)) for _ in range(30)]
    edges += [(a, b) for (a, _), (b, _) in zip(edges, edges[1:10], strict=False)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(root)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in root for b in list(root)[:10])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(names.get(find(i), d) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def test_jaccard_join(spark):
    rows = awkward()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(docs(spark, *rows)).collect())
    assert got == brute_components(rows)
    assert jaccard.join(docs(spark, *rows).limit(0)).count() == 0


def test_jaccard_join_of_a_large_group(spark, monkeypatch):
    """More near copies than a block holds, some just too far from the others, and a passage that all documents share."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(5)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(12)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(passage + [f"q{i}-{j}" for j in range(r.choice((2, 3, 30)))])) for i in range(60)]
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard.join(docs(spark, *rows)).collect())
    assert got == brute_components(rows)


def test_tree_keeps_every_pair_that_may_link():
    r = np.random.default_rng(0)
    universe = r.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(r.choice(universe, n)) for n in r.integers(1, 60, 70)]
    sets += [np.unique(np.append(s[: len(s) - len(s) // 8], r.choice(universe, 1))) for s in sets]
    maps = np.stack([jaccard.fold(jaccard.token_bits(s)) for s in sets])
    i, j = jaccard.SignatureTree(maps, np.array([len(s) for s in sets]), np.arange(len(sets))).pairs(75)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    links = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jaccard.similar(sets[a], sets[b], 75)}
    assert links <= kept and len(kept) < len(sets) ** 2 / 4


def test_one_of_each(spark):
    rows = awkward()
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(docs(spark, *rows)).collect()]
    ids = [k for k, _ in kept if k is not None]
    assert {2, 3, 12, 8, 10}.isdisjoint(ids) and {1, 4, 5, 6, 7, 9, 11, 20, 21, -5} <= set(ids)


def test_codec(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    lib, own, plain = Tokenizer.from_file(path(bpe.VOCABULARY)), bpe.codec(), bpe.codec(None, False)
    r = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "the", "'s", "É", "한", "😀", " ", "　", "1", "23", "!!", "<|endoftext|>", "\t", "\x00", "x" * 70, "ing", "\r\n", "\x1c"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in awkward()] + ["ab" * 20_000]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        assert plain.decode(plain.encode(t)) == t and bpe_end not in plain.encode(t)
    rows = awkward()
    got = sorted(map(str, bpe.encode_decode(docs(spark, *rows)).collect()))
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={a}, n_tokens={b}, ids_sha256='{c}', decoded_sha256='{e}')" for a, b, c, e in want)


bpe_end = tokenfiles.END_ID


def test_fingerprints(spark):
    rows = awkward()
    frame = fingerprints.fingerprint(docs(spark, *rows), 16_384)  # more than any document has: exact
    got = frame.toPandas()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for i, (d, _) in enumerate(order):
        t, n = texts[i], texts[(i + 1) % len(order)]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(shingle_set(t), shingle_set(e)), 9), round(like(shingle_set(t), shingle_set(n)), 9)))
    have = [(str(None if d != d else int(d)), int(n), s, round(a, 9), round(b, 9)) for d, n, s, a, b in zip(got.doc_id, got.n_chars, got.edited_sha256, got.near_edited, got.near_next, strict=True)]
    assert sorted(have) == sorted(want)
    assert fingerprints.fingerprint(docs(spark, *rows).limit(0)).count() == 0


def test_sketches_merge():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 2**63, 5000).astype(np.uint64) << np.uint64(1)) for _ in range(2))
    both = np.unique(np.concatenate([a, b[::2]]))
    sa, sb, sab = (fingerprints.sketch(x) for x in (a, both, np.unique(np.concatenate([a, both]))))
    assert (fingerprints.merge(sa, sb) == sab).all()
    assert abs(fingerprints.resemblance(sa, sb) - len(a) / len(both)) < 0.15
    assert fingerprints.containment(sa, sb) > 0.8
    assert abs(fingerprints.distinct(sa) / len(a) - 1) < 0.3
    assert (fingerprints.from_text(fingerprints.text_of(sa)) == sa).all()


def test_toxicity(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = r.choices(words, k=r.randint(20, 200))
        toxic = i % 4 == 0
        if toxic:
            w[3] = r.choice(["nasty", "Awful!", "vileness", "vilest"])
            w += ["nasty"] * r.randint(0, 4)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    table = docs(spark, *rows, (None, None), (1000, ""))
    model = toxicity.train(table, lab.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert sum(got[i].is_toxic == bool(y) for i, y in labels if i % 2) >= 0.99 * 200
    assert (np.diff(model.thresholds) > 0).all()
    assert not got[1000].is_toxic and not got[None].is_toxic
    kept = toxicity.drop_toxic(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.is_toxic}
    none = toxicity.train(table, lab.limit(0))
    assert not any(r.is_toxic for r in toxicity.score(table, none).collect())


def test_token_counts(spark):
    rows = awkward()
    codec = bpe.codec(None, False)
    want = sorted((str(d), len(codec.encode(t or ""))) for d, t in rows)
    for files, blocks in ((1 << 22, 1 << 19), (700, 64), (100, 33)):
        got = sorted((str(r.doc_id), r.n_tokens) for r in tokenfiles.document_counts(docs(spark, *rows).repartition(3), file_tokens=files, block_tokens=blocks).collect())
        assert got == want
    assert tokenfiles.document_counts(docs(spark, *rows).limit(0)).count() == 0


def test_token_scan_without_a_last_end(spark, tmp_path):
    tokens = np.array([9, 9, 1, 1, 5, 5, 5, 1, 7, 7], "<u2")
    (tmp_path / "a.bin").write_bytes(tokens[:5].tobytes())
    (tmp_path / "b.bin").write_bytes(tokens[5:].tobytes())
    files = spark.createDataFrame([(0, 0, f"file://{tmp_path}/a.bin", 5), (0, 1, f"file://{tmp_path}/b.bin", 5), (1, 0, f"file://{tmp_path}/none", 0)], "stream long, shard long, uri string, n_tokens long")
    for size in (1, 2, 3, 100):
        got = sorted((r.ordinal, r.n_tokens) for r in tokenfiles.count(files, end_id=1, block_tokens=size).collect())
        assert got == [(0, 2), (1, 0), (2, 3), (3, 2)]


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(0, 1, 8).astype(np.float32)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(500, None), (600, [1.0, None] * 4), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (900, []), (None, rows[0][1]), (1000, [1.0, 2.0])]
    table = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<float>, score int, rank int")
    good = [(a, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in b]) for a, b in rows if a is not None and b and all(x is not None and np.isfinite(x) for x in b)]
    want = []
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), c) for c, w in good if c != q and len(w) == len(v))[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    for part in (pivots.PART, 40):
        pivots.PART, old = part, pivots.PART
        got = sorted(tuple(r) for r in pivots.top_k(table.repartition(3), query_block=2).collect())
        pivots.PART = old
        assert got == sorted(want)
    assert pivots.top_k(table.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Products over 2**53, over a long, and components that 1024 * x takes past a double, against Python's integers."""
    r = np.random.default_rng(4)
    rows = [(i, (10 ** r.uniform(0, 6) * r.normal(0, 1, 8)).tolist()) for i in range(250)]
    rows += [(300 + i, [1e5 + i * 2**-10, -1e5, 1e5, 0.5] * 2) for i in range(12)]
    rows += [(400, [1e30] * 4), (401, [1e30, -1e30, 1e9, 1.0]), (402, [-1e30] * 4), (500, [1e307, 1.0]), (501, [2.0, 3.0])] + [(503 + i, [1.0, 7.0 + i]) for i in range(3)]
    exact = lambda x: [math.floor(c) * 1024 if abs(c) > 2**53 else math.floor(1024 * c) for c in x]
    want = []
    for q, v in rows:
        if q % 100 == 0:
            scored = [(min(max(sum(a * b for a, b in zip(exact(v), exact(w), strict=True)), -(2**63)), 2**63 - 1), c) for c, w in rows if c != q and len(w) == len(v)]
            want += [(q, k + 1, c, s) for k, (s, c) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:10])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, pivots.top_k(table).collect())) == sorted(want)
    assert sorted(map(tuple, pivots.top_k(table, query_block=1).collect())) == sorted(want)


def brute_repeats(rows, window):
    first = {}
    for d, t in rows:
        if d is not None:
            w = words_of(t)
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((str(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [13, 4])
def test_substring_removal(spark, window):
    rows = awkward()
    r = random.Random(6)
    shared_words = [f"s{i}" for i in range(40)]
    for i in range(30):
        a = r.randrange(30)
        rows.append((200 + i, " ".join([f"u{i}-{j}" for j in range(r.randrange(20))] + shared_words[a : a + r.randrange(20)] + [f"v{i}"])))
    got = substring.remove_repeats(docs(spark, *rows).repartition(3), window=window, filter_bits=14, columns=("part", "kind"))
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_text) for x in got.collect()) == brute_repeats(rows, window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text", "part", "kind"]
    assert substring.remove_repeats(docs(spark, *rows).limit(0)).count() == 0


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_regular_long_words_are_told_apart(spark):
    """Words whose polynomials modulo 2**64 are equal, although no letter agrees in place."""
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rows = [(i, " ".join(f"{w}{'x' * k}" for k in range(13))) for i, w in enumerate((one, two))]
    got = {r.doc_id: r.component_id for r in jaccard.join(docs(spark, *rows)).collect()}
    assert got == {0: 0, 1: 1}
    assert {r.near_next for r in fingerprints.fingerprint(docs(spark, *rows)).collect()} == {0.0}
    assert {r.n_removed for r in substring.remove_repeats(docs(spark, *rows)).collect()} == {0}


def test_rows_of_one_document_with_different_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage), (2, "short"), (2, "a b " + passage + " c"), (2, " ".join(f"u{i}" for i in range(70))), (2, passage)] + [(2, f"w{i}") for i in range(300)]
    got = substring.remove_repeats(docs(spark, *rows), with_repeats=True).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_text) for x in got) == brute_repeats(rows, 13)
    assert {(r.n_words, tuple(map(tuple, r.repeats))) for r in got if r.n_removed} == {(30, ((0, 30),)), (33, ((2, 30),))}


def first_fit_decreasing(lengths, capacity):
    room = []
    for k in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= k), None)
        if at is None:
            room.append(capacity - k)
        else:
            room[at] -= k
    return len(room)


def test_added_tokens_in_upper_case():
    from tokenizers import Tokenizer
    from public_tokenizers import path

    lib = Tokenizer.from_file(path(packing.VOCABULARY))
    lib.no_padding()
    lib.no_truncation()
    coder = packing.WordTokens(path(packing.VOCABULARY))
    for text in ("<|EndOfText|>", "<|ENDOFTEXT|>", "<|STARTOFTEXT|>", "<|StartOfText|>.", "<|endoftext|>", "<|startoftext|>", "Some <|EndOfText|> words<|ENDOFTEXT|>, More", "a<|B"):
        assert np.frombuffer(coder.encode(text), np.uint32).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path(packing.VOCABULARY))
    rows = awkward()
    for capacity in (2048, 64):
        got = packing.pack(docs(spark, *rows).repartition(2), capacity=capacity).collect()
        want = []
        for d, t in rows:
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
            want += [(str(d), k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        bins = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == bins.get(r.sequence_id, 0)
            bins[r.sequence_id] = r.offset + r.length
        assert max(bins.values()) <= capacity and len(bins) <= first_fit_decreasing([w[3] for w in want], capacity)
    assert packing.pack(docs(spark, *rows).limit(0)).count() == 0


def test_plan_uses_every_piece():
    r = random.Random(8)
    for _ in range(20):
        histogram = {}
        for _ in range(r.randrange(400)):
            k = r.randint(1, 50)
            histogram[k] = histogram.get(k, 0) + r.randint(1, 9)
        used = {}
        planned = packing.plan(histogram, 50)
        for times, use in planned:
            assert times > 0 and sum(k * n for k, n in use.items()) <= 50
            for k, n in use.items():
                used[k] = used.get(k, 0) + times * n
        assert used == histogram
        assert sum(t for t, _ in planned) <= 1.02 * first_fit_decreasing([k for k, n in histogram.items() for _ in range(n)], 50) + 1
    assert packing.best_two([3, 4, 6], [1, 2, 1], 9, 7) == (3, 6) and packing.best_two([4], [1], 9, 7) is None


def test_best_two_against_all_pairs():
    r = random.Random(1)
    for _ in range(20_000):
        lengths = sorted(r.sample(range(1, 30), r.randint(1, 8)))
        counts = [r.choice((0, 0, 0, 1, 1, 2, 3)) for _ in lengths]
        room = r.randint(1, 60)
        above = r.randint(0, room)
        sums = [a + b for i, a in enumerate(lengths) for j, b in enumerate(lengths) if i <= j and counts[i] and counts[j] and (i != j or counts[i] > 1) and above < a + b <= room]
        got = packing.best_two(lengths, counts, room, above)
        assert (sum(got) if got else None) == max(sums, default=None)
        assert not got or all(counts[lengths.index(k)] >= got.count(k) for k in got)


def test_word_ids_are_the_library_s(monkeypatch):
    import pyarrow as pa
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from munjang.llm import wordbpe

    lib = Tokenizer.from_file(path(packing.VOCABULARY))
    lib.no_padding()
    lib.no_truncation()
    r = random.Random(5)
    alphabet = [*"abcXYZ'stm ,.!?;:#&<|>-_0129éÉßÿÀ×÷ÖñÑªµ", "  ", "\n", "\x1c", "\x85", "\u00a0", "e\u0301", "Σ", "İ", "한", "😀", "'ll", "don't", "x" * 50, "é" * 30, "ing", "tion", "\x00"]
    added = [f(t) for t in ("<|startoftext|>", "<|endoftext|>") for f in (str, str.upper, str.title, str.swapcase)]
    texts = ["".join(r.choices(alphabet + added, k=r.randint(0, 16))) for _ in range(20_000)] + [None, "", "x" * 5000, "word " * 3000]
    for kept, size in ((wordbpe.KEPT, wordbpe.SLICE), (100, 1 << 12)):
        monkeypatch.setattr(wordbpe, "KEPT", kept)
        monkeypatch.setattr(wordbpe, "SLICE", size)
        coder = wordbpe.WordTokens(path(packing.VOCABULARY))
        got = [ids[a:b].tolist() for ids, ends in coder.columns(pa.array(texts)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_quality(spark):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = r.choices(words, k=r.randint(20, 120))
        good = i % 3 > 0
        rows.append((i, " ".join(w) + "." if good else "!! ".join(w).upper(), r.choice(["en", None]), r.choice(["s1", "s2"]) if good else r.choice(["s2", "s3"]), len(w)))
        labels.append((i, int(good)))
    table = spark.createDataFrame([(*x, 1.0) for x in [*rows, (None, None, None, None, None), (1000, "", "", "", -1)]], "doc_id long, text string, lang string, source string, n_chars long, p_text double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(table, lab.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in quality.score(table, model).collect()}
    assert sum(got[i].keep == bool(y) for i, y in labels if i % 2) >= 0.97 * 200
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}
    assert quality.train(table, lab.where("quality = 1")) is None
    assert all(r.keep and r.p_quality is None for r in quality.score(table, None).collect())


@pytest.fixture(scope="module")
def labeller():
    return htmltext.trained()


def test_blocks():
    page = """<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class=x><nav><ul><li><a href="/a">Home</a><li>Two</ul></nav>
    <article id='main'><h1>Head &amp; tail</h1><p><b>One   two<br>three<p>Four &#51; &lt;x&gt;</article><!-- gone <p>no --><footer>&copy; end<form><input><select><option>no</select></form>"""
    assert [(b.path[-1], b.text) for b in htmltext.blocks(page)] == [("li", "Home"), ("li", "Two"), ("h1", "Head & tail"), ("p", "One two three"), ("p", "Four 3 <x>"), ("footer", "© end")]
    for odd in ("", "<", "<p", "text", "<!-- open", "<script>x", "</p></div>x", "<p>" * 3000 + "x", "<div>" * 3000 + "x"):
        htmltext.blocks(odd)


@pytest.mark.parametrize("page", ["<svg " * 200_000, '<a "' * 250_000, '<a ">"' * 170_000, "</div>" * 170_000, "<div>" * 200_000 + "x", "<li><div>" + "<center>" * 50_000 + "<li></li>" * 10_000, "<a \"'>" * 150_000, "<a '\"><b \"'>" * 90_000, "<!--" * 250_000, "<title>" * 100_000, "<p class=\"x" * 100_000], ids=range(11))
def test_hostile_pages_take_linear_time(page):
    from time import process_time

    began = process_time()
    htmltext.blocks(page)
    assert process_time() - began < 10  # quadratic work takes hours


def test_odd_tags():
    said = lambda page: [b.text for b in htmltext.blocks(page)]
    assert said("<p>a<svg/>b<svg viewBox='0'><text>c</text></svg>d") == ["abd"]
    assert said("<p title='1 > 0'>a</p>x < y<p>1<2") == ["a", "x < y", "1<2"]
    assert said('<p>one<p title="two>three<p>four') == ["one", "three", "four"]
    assert said("a<p") == ["a<p"] and said("<") == ["<"] and said("a</ b>c<>d") == ["a</ b>c<>d"]


def test_paths_name_all_ancestors(labeller):
    deep, end = "<div>" * 20, "</div>" * 20
    text = "".join("<p>The quick river runs along the old town and people walk there every day.</p>" for _ in range(4))
    found = htmltext.blocks(f"<body><article>{deep}{text}{end}</article><aside>{deep}{text}{end}</aside></body>")
    assert [x.path[1] for x in found] == ["article"] * 4 + ["aside"] * 4 and len({x.slots for x in found}) == 2
    assert ((labeller.label([found])[0] >= 0.5) == ([True] * 4 + [False] * 4)).all()


def test_labeller_on_held_out_pages(labeller):
    pages = [x for x in map(htmltext.compose, range(90_000, 90_200)) if x[0]]
    p = np.concatenate(labeller.label([x[0] for x in pages]))
    y = np.concatenate([np.array(x[1]) for x in pages])
    assert ((p >= 0.5) == y).mean() > 0.98
    one = [labeller.label([x[0]])[0] for x in pages[:20]]
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(one, labeller.label([x[0] for x in pages[:20]]), strict=True))


def test_gradients_match_differences():
    model = htmltext.Labeller(3)
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (5, 3, htmltext.PATH_SLOTS + htmltext.WORD_SLOTS + 6)).astype(np.float32)
    mask = np.arange(5)[:, None] < np.array([5, 3, 1])
    y = (r.random((5, 3)) < 0.5).astype(np.float32)

    def loss():
        z = model.forward({d: x @ model.p["x" + d] for d in "fb"}, mask, False)[0]
        return float(np.where(mask, np.logaddexp(0, z) - y * z, 0).sum() / mask.sum())

    grads = model.gradients(x, mask, y)
    for k in ("hf", "hb", "cf", "o", "xb"):
        at = tuple(s // 2 for s in model.p[k].shape)
        old, step = float(model.p[k][at]), 1e-2
        model.p[k][at] = old + step
        up = loss()
        model.p[k][at] = old - step
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / (2 * step) - grads[k][at]) < 2e-3


def test_page_text(spark, labeller):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in htmltext.extract(pages, labeller).collect()}
    for r in pages.collect():
        want = "\n\n".join(b.text for b in htmltext.blocks(r.html) if any(x.split()[0] == "article" for x in b.path))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in htmltext.extract(odd, labeller).collect()] == [("", 0)] * 3


def test_ordinal_fit_is_at_the_best_of_its_likelihood():
    r = np.random.default_rng(7)
    n = 240
    y = (np.arange(n) % 3 == 0).astype(int)
    doc, ids = [], []
    for i in range(n):
        words = r.choice(12, 6, replace=False) + (100 if y[i] else 0) * (r.random(6) < 0.7)
        doc += [i] * 6
        ids += words.tolist()
    doc, ids = np.array(doc), np.array(ids)
    counts = r.integers(1, 4, len(ids))
    model = toxicity.fit(n, doc, ids, counts, y, rounds=3000)
    kept = np.flatnonzero(model.weights)
    assert len(kept) and set(kept) <= set(range(100, 112)) and (np.diff(model.thresholds) > 0).all()
    value = np.log2(1.0 + counts)
    held = np.isin(ids, toxicity.choose(doc, ids, y))
    grades = toxicity.grade(np.bincount(doc[held], value[held], n), y, toxicity.GRADES)
    assert set(grades[y == 0]) == {0} and grades[y == 1].min() == 1
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * n

    def likelihood(weights, thresholds):
        score = np.bincount(doc, value * weights[ids], n)
        total = 0.0
        for i in range(n):
            at_least = [1.0, *(1 / (1 + math.exp(-(score[i] - t))) for t in thresholds), 0.0]
            total += balance[i] * math.log(max(1e-12, at_least[grades[i]] - at_least[grades[i] + 1]))
        return total / n - 0.5e-4 * (weights**2).sum()

    best = likelihood(model.weights, model.thresholds)
    for _ in range(60):
        moved = model.weights.copy()
        moved[kept] += r.normal(0, 0.05, len(kept))
        assert likelihood(moved, np.sort(model.thresholds + r.normal(0, 0.05, len(model.thresholds)))) <= best + 2e-3


def test_logistic_and_co_training_against_plain_sums():
    from munjang.llm.labelled import logistic, sigmoid

    r = np.random.default_rng(8)
    x = r.normal(0, 1, (200, 3))
    y = (r.random(200) < sigmoid(x @ [1.0, -2.0, 0.5] + 0.3)).astype(float)
    w = logistic(x, y, ridge=0.7)
    slope = np.zeros(4)
    for row, t in zip(x, y, strict=True):
        slope += (t - 1 / (1 + math.exp(-(row @ w[:3] + w[3])))) * np.append(row, 1)
    assert np.abs(slope - np.append(0.7 * w[:3], 1e-6 * w[3])).max() < 1e-4
    # Views that see different halves of the truth teach each other: both find classes that few labels show.
    truth = r.integers(0, 2, 1200)
    views = [truth[:, None] * 2.0 + r.normal(0, 0.7, (1200, 2)) for _ in range(2)]
    few = np.arange(16)
    model = quality.co_train([v[few] for v in views], truth[few].astype(float), few, [v[100:1100] for v in views], 0.5)
    p = model.probability(views[0][1100:], views[1][1100:])
    assert ((p >= 0.5) == truth[1100:]).mean() > 0.95


def test_empty_tables_and_long_texts(spark, labeller):
    empty = docs(spark, (1, "x")).limit(0)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert bpe.encode_decode(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.extract(pages, labeller).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    wide = empty.selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "1L AS n_chars")
    assert quality.score(wide, quality.train(wide, labels)).count() == 0 and quality.train(wide, labels.limit(0)) is None
    long = docs(spark, (1, "word and other words, " * 100_000), (2, "x" * 1_000_000), (3, None))
    assert [r.is_toxic for r in toxicity.score(long, toxicity.train(long, labels.limit(0))).collect()] == [False] * 3
    features = quality.text_features(long.select("text").toArrow()["text"].combine_chunks())
    assert features.shape == (3, quality.TEXT_FEATURES) and np.isfinite(features).all()
    page = "<article>" + "<p>The quick river runs along the old town.</p>" * 4000 + "</article>"
    got = htmltext.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), labeller).first()
    assert got.n_chars > 4000 * 20


def test_shared_folder(spark, monkeypatch, tmp_path):
    with monkeypatch.context() as m:
        m.setattr(shared, "folder", lambda spark: f"file://{tmp_path}/shared")
        assert shared.sweep(spark) == 0
        kept = shared.save(spark.range(3), "kept")
        assert shared.sweep(spark, hours=1.0) == 0 and kept.count() == 3
        assert shared.sweep(spark, hours=-1.0) == 1 and not list((tmp_path / "shared" / "munjang").iterdir())
    keys = shared.partition_keys(spark, 7)
    rows = spark.createDataFrame([(k,) for k in keys], "k int").repartition(7, "k").select(F.spark_partition_id().alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(7))

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *_: None)}))

    with pytest.raises(ValueError):
        shared.folder(Cluster)


def test_tree_prunes_pairs_of_nodes():
    """A tree of three levels over groups of near copies: node pairs of different groups go before their leaves are met."""
    r = np.random.default_rng(3)
    sets = []
    for _ in range(16):
        base = r.integers(0, 2**63, 60).astype(np.uint64)
        sets += [np.unique(np.append(base[: 60 - k], r.integers(0, 2**63, k).astype(np.uint64))) for k in range(8)]
    maps, sizes = np.stack([jaccard.fold(jaccard.token_bits(s)) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard.SignatureTree(maps, sizes, np.arange(len(sets)))
    assert [len(x[1]) for x in tree.levels] == [128, 16, 2]
    a, b = np.triu_indices(16, 1)
    assert len(tree.possible(tree.levels[1], a, b, 75)) < len(a) / 2
    kept = set(zip(*(x.tolist() for x in tree.pairs(75)), strict=True))
    assert {(i, j) for i in range(128) for j in range(i + 1, 128) if jaccard.similar(sets[i], sets[j], 75)} <= kept


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    base = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"n_removed": F.lit(1), "kept_text": F.lit("x"), "part": F.lit("y")})
    table, before = base, None
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, shared.save(stage(spark, table, DATA), "test")
        if name != "best-fit packing":
            assert table.columns == base.columns
        rows, was = {r.doc_id: r for r in table.collect()}, {r.doc_id: r for r in before.collect()}
        assert set(rows) <= set(was)
        if name == "n-gram Jaccard join":
            groups = {d: c for d, _, c in brute_components_by_id([(k, v.text) for k, v in was.items()])}
            assert set(rows) == set(groups.values())
        if name == "substring dedup":
            want = brute_repeats([(k, v.text) for k, v in was.items()], substring.WINDOW)
            assert sorted((str(k), v.text, v.n_chars) for k, v in rows.items()) == sorted((d, t, len(t)) for d, _, _, t in want)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    first = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, base, DATA).collect()}
    assert all(d in first for d, r in labels.items() if r.quality == 1) and not any(d in first for d, r in labels.items() if r.quality == 0)


def brute_components_by_id(rows):
    return [(int(d), n, int(c)) for d, n, c in brute_components(rows)]
