"""Corpus operators against brute force, round trips and held-out accuracy, with nulls, empties, ties, repeats and extra columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import byte_bpe, components, lattice, licenses, ngram_join, packing, quality, queries, sketch, suffix, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, id long, side int"


def docs(spark, rows):
    """Rows with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, "k", 9, 1) for i, t in rows], DOCS)


def odd_texts(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 80))] for _ in range(40)]
    rows = []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 3, rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(1001, None), (1002, ""), (1003, " \n "), (1004, "One two"), (1005, "one  TWO"), (1006, "x " * 3000), (None, "one two")]
    rng.shuffle(rows)
    return rows


EMPTY = []


# 1


def brute_links(rows):
    """Sorted (id as text, set size, component) of each row; rows of one id count as one document."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    comp = {i: i for i, _ in sets if i is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    own = [x for x in sets if x[0] is not None and x[1]]
    for k, (a, s) in enumerate(own):
        for b, t in own[k + 1 :]:
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(find(i) if s else i) if i is not None else "None") for i, s in sets)


def linked(spark, rows):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.link_documents(docs(spark, rows)).collect())


def thue_morse(n):
    """n letters, and the same with the letters exchanged: their polynomial hashes modulo a power of two are equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_ngram_join(spark, monkeypatch):
    rows = [*odd_texts(), *enumerate(thue_morse(2048), 7000)]
    got = linked(spark, rows)
    assert got == brute_links(rows)
    assert ngram_join.link_documents(docs(spark, EMPTY)).count() == 0
    kept = [r.doc_id for r in ngram_join.keep_first(docs(spark, rows).withColumn("__gone", F.lit(1))).collect()]
    assert sorted(map(str, kept)) == sorted(i for i, _, c in got if i == c)


def test_ngram_join_beyond_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = [*odd_texts(2), *((5000 + i, " ".join(f"w{j}" if j != i % 50 else f"v{i}" for j in range(50))) for i in range(60))]
    assert linked(spark, rows) == brute_links(rows)


def test_every_link_of_the_ngram_join(spark, monkeypatch):
    """All links between different texts, one tile's as well as those over blocks, and how many documents each links with."""
    near = [(5000 + i, " ".join(f"w{j}" if j not in (i % 50, i * 7 % 50) else f"v{i}x{j}" for j in range(50))) for i in range(60)]
    texts = [(i, t) for i, t in odd_texts(5) if i is not None]
    rows = list({i: (i, t) for i, t in [*texts, *near, (9001, texts[0][1]), (9002, texts[0][1])]}.values())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    linked = {(i, j) for i in sets for j in sets if i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    for block in (1024, 5):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        links, members = ngram_join.link_classes(docs(spark, [*rows, (None, "no id")]))
        of = defaultdict(set)
        for r in members.collect():
            of[r.class_id].add(r.doc_id)
        got = {(i, j) for own in of.values() for i in own for j in own if i != j}
        pairs = [(r.a, r.b) for r in links.collect()]
        assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
        got |= {x for a, b in pairs for i in of[a] for j in of[b] for x in ((i, j), (j, i))}
        assert got == linked
        assert {r.doc_id: r.n_links for r in ngram_join.link_counts(links, members).collect()} == {i: sum((i, j) in linked for j in sets) for i in sets if sets[i]}
    links, members = ngram_join.link_classes(docs(spark, EMPTY))
    assert links.count() == members.count() == 0


def test_ngram_join_of_repeated_ids(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    assert linked(spark, [(3, a), (5, a), (5, b), (7, b), (9, c)]) == [("3", 3, "3"), ("5", 3, "3"), ("5", 3, "3"), ("7", 3, "3"), ("9", 3, "9")]
    # One id is the smallest of several classes.
    assert linked(spark, [(5, a), (5, b), (5, b), (7, b), (8, a), (9, c), (4, c)]) == [("4", 3, "4"), ("5", 3, "5"), ("5", 3, "5"), ("5", 3, "5"), ("7", 3, "5"), ("8", 3, "5"), ("9", 3, "4")]
    rows = [(i // 2 % 100, t) if i is not None else (i, t) for i, t in odd_texts(3)]
    assert linked(spark, rows) == brute_links(rows)


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, rng.integers(1, 300))), np.unique(rng.choice(pool, rng.integers(1, 300)))
        s, t = ngram_join.signature(a), ngram_join.signature(b)
        w = min(len(s), len(t))
        if ngram_join.similar(a, b):
            assert ngram_join.could_link(len(a), ngram_join.fold(s, w), np.array([len(b)]), ngram_join.fold(t, w)[None, :])[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 2


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(4)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 256), 0x1F600 + rng.randrange(60), 0x4E00 + rng.randrange(90), 10, 32, 32, 39, 0x1C, 0x85, 0xA0]))
    return ["".join(pick() for _ in range(rng.randrange(80))) for _ in range(600)] + ["", " ", "  a", "a  ", "it's 3 o'clock\n\n x", "a" * 3000, "<|endoftext|> <unk>"]


def test_byte_bpe(spark, strange):
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(path))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*enumerate(strange), (9999, None), (3, strange[3])]
    got = sorted(byte_bpe.encode_documents(docs(spark, rows), path, public.PATTERN, with_ids=True).collect())
    assert len(got) == len(rows)
    for r in got:
        text = strange[r.doc_id] if r.doc_id < len(strange) else ""
        ids = own.encode_ordinary(text)
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_tables(spark, strange):
    empty = docs(spark, EMPTY)
    assert byte_bpe.encode_documents(empty, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == 0
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(empty, toxicity.fit(empty, lab)).count() == 0
    assert quality.score_documents(empty, quality.fit(empty, lab)).count() == 0


def test_units_fall_apart_at_blanks(strange):
    codec = byte_bpe.Codec(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    assert [codec.encode(t) for t in strange] == codec.encode_many(strange)
    whole = regex.compile(public.PATTERN)
    for t in strange:
        assert codec.decode(codec.encode(t)) == t.encode()
        assert "".join(whole.findall(t)) == t


# 3


def test_lattice(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(400):
        v = base[rng.integers(60)]
        v = v + rng.normal(size=16) * rng.choice([0, 0.1, 0.15, 0.2]) * np.linalg.norm(v) / 4
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [1.0] * 16, None), (504, [None] + [1.0] * 15, 1), (505, [1.0] * 16, 1), (506, [2.0] * 16, 1), (507, [2.0] * 16, 1), (507, [2.0] * 16, 1), (508, [float("inf")] + [1.0] * 15, 1), (509, [1.0] * 8, 1), (510, [], 1), (600, [1.0, -1.0] * 8, 0), (600, [-1.0, 1.0] * 8, 0), (601, [-1.0, 1.0] * 8, 0), (602, [-2.0, 2.0] * 8, 0), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, label int, n int, key string")

    def good(r):
        return r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    links, comp = defaultdict(set), {i: i for i in range(len(rows))}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
                    p, q = find(i), find(j)
                    comp[max(p, q)] = min(p, q)
    want = sorted((str(rows[i][0]), len(links[i]), str(min((rows[j][0] for j in range(len(rows)) if find(j) == find(i)), default=None))) for i in range(len(rows)))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in lattice.link_embeddings(df).collect())
    assert len(got) == len(want)
    assert sum(n for _, n, _ in got) >= 0.97 * sum(n for _, n, _ in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    monkeypatch.setattr(lattice, "BLOCK", 3)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in lattice.link_embeddings(df).collect()) == got
    assert lattice.link_embeddings(df.limit(0)).count() == 0


def test_lattice_of_doubles(spark):
    """Components that no float holds, tiny ones whose squares vanish, and a cosine that floats would round up to the limit."""
    edge = lambda c: [c, (1 - c * c) ** 0.5, *[0.0] * 14]
    rows = [(1, [1e300] * 16), (2, [1e300] * 16), (3, [1e-200] * 16), (4, [1.0, *[0.0] * 15]), (5, edge(0.93 + 1e-12)), (6, [-1.0, *[0.0] * 15]), (7, [-x for x in edge(0.93 - 1e-12)])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.link_embeddings(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), 7: (0, 7, True)}


def test_nearest_lattice_point():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)) * 2
    near = lattice.nearest_e8(x)
    best = ((x - near) ** 2).sum(1)
    for v in lattice.shortest_vectors():
        assert (((x - near - v) ** 2).sum(1) >= best - 1e-9).all()
    assert len(lattice.shortest_vectors()) == 240


# 4


def test_warc_keeps_long_urls(spark):
    urls = ["http://a/" + c * n for c, n in (("x", 8184), ("y", 8185), ("z", 200_000))]
    rows = [(i, u, f"page {i % 2} WARC/1.1\r\nno head") for i, u in enumerate(urls)]
    path = warc.archive_path(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    told = [line.split(b": ", 1)[1].decode() for f in files for line in f.split(b"\r\n") if line.startswith(b"WARC-Target-URI: ")]
    assert sorted(told) == sorted(urls)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, path).collect()}
    assert got == {0: ("response", None, 24), 1: ("response", None, 24), 2: ("revisit", 0, 24)}


def test_warc_rolls_files_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 16_000)
    monkeypatch.setattr(warc, "LARGEST", [2_000, 4_000, 8_000])
    rows = [(i, "u", "x" * n) for i, n in enumerate([*range(0, 900, 30), 1_500, 1_500, 2_500, 3_500, 6_000, 6_500, 7_000, 30_000, 31_000])]
    path = warc.archive_path(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    sizes = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()]
    assert max(sorted(sizes)[:-2]) <= 16_000 and sorted(sizes)[-2] > 30_000
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.read_archives(spark, path).collect()}
    assert got == {i: (len(h), "revisit" if i == 31 else "response") for i, _, h in rows}


def test_warc_of_nothing(spark):
    path = warc.archive_path(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string, k int"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_warc(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    htmls = ["a", "", None, "a", "x" * 5000, fake * 200, "é\r\n\r\n", "é\r\n\r\n", "WARC/1.1\r\n", f"{fake}tail", "\0\n"] * 12
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 5 else None, h, 1) for i, h in enumerate(htmls)]
    path = warc.archive_path(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, bytes int").repartition(3), path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path, block=3000).collect()}
    first, want = {}, {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        f = first.setdefault(b, i)
        want[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    assert got == want
    path = warc.archive_path(spark)
    warc.write_archives(spark.createDataFrame([(None, None, None), (None, "u", "x"), (2, "u", "x"), (2, "u", "x")], "page_id long, url string, html string"), path)
    assert sorted((r.page_id is None, r.record_type) for r in warc.read_archives(spark, path).collect()) == [(False, "response"), (False, "response"), (True, "response"), (True, "response")]


# 5


def test_packing(spark, strange):
    path = public.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = [*enumerate(strange), (9990, "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>"), (9998, None), (9999, "word " * 9000), (9997, "ab " * 4095)]
    got = packing.pack_documents(docs(spark, rows).repartition(2), path).collect()
    want = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        # Whole windows, powers of two, and those that are nearly full.
        assert at <= 4096 and (at & (at - 1) == 0 or at >= 0.95 * 4096)


def test_packing_by_the_choice_alone():
    """Every window is as a plain loop over the sum of squares leaves it; only those far from full at the end are cut anew."""
    rng = np.random.default_rng(8)
    for sizes in ([3000] * 300, rng.integers(1, 6000, 900).tolist(), [2049] * 300, rng.integers(1, 400, 4000).tolist(), [70_000, 1, 4095, 4096]):
        report, filled, pieces, every = {}, defaultdict(int), defaultdict(list), 0

        def stream(sizes=sizes):
            for i, n in enumerate(sizes):
                yield i, (np.arange(n, dtype="<u4") * 3 + (i % 2) * 70_000).tobytes()

        for doc, start, length, crc, total, sequence, offset in packing.pack_stream(stream(), report=report):
            assert offset == filled[sequence] and total == sizes[doc]
            assert crc == zlib.crc32((np.arange(start, start + length, dtype="<u4") * 3 + (doc % 2) * 70_000).tobytes())
            every += length
            filled[sequence] += length
            pieces[sequence].append((doc, start))
        assert every == sum(sizes) == report["tokens"]
        # The loop: windows as lists of remainders, the smallest sum of squares, the fullest window on ties.
        open_, count, done = [], Counter(), []
        for doc, n in enumerate(sizes):
            r = n % 4096
            if not r:
                continue
            best = None
            for level in sorted({0, *(w[0] for w in open_)}, reverse=True):
                if level + r <= 4096:
                    change = (0 if level == 0 else 1 - 2 * count[level]) + (0 if level + r == 4096 else 1 + 2 * count[level + r])
                    if best is None or change < best[0]:
                        best = (change, level)
            level = best[1]
            window = [0, []] if level == 0 else next(w for w in reversed(open_) if w[0] == level)
            if level:
                open_.remove(window)
                count[level] -= 1
            window = [level + r, [*window[1], (doc, n - r)]]
            if window[0] == 4096:
                done.append(window[1])
            else:
                open_.append(window)
                count[window[0]] += 1
        stay = [w for w in open_ if w[0] >= 0.95 * 4096]
        got = sorted(map(sorted, pieces.values()))
        for window in [*done, *(w[1] for w in stay)]:
            assert sorted(window) in got
        assert report["cut"] == sum(w[0] for w in open_ if w[0] < 0.95 * 4096)
        assert report["padding"] == sum(4096 - w[0] for w in stay if w[0] & (w[0] - 1))


def test_packing_of_nothing(spark):
    path = public.path("word_bpe_49k.json")
    assert packing.pack_documents(docs(spark, EMPTY), path).count() == 0
    got = packing.pack_documents(docs(spark, [(1, None), (1, None), (None, "")]).coalesce(1), path).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in got) == [("1", 0, 1, 1), ("1", 0, 1, 1), ("None", 0, 1, 1)]


def test_sum_of_squares_choice():
    rng = np.random.default_rng(7)
    for _ in range(300):
        levels = packing.Levels(16)
        levels.count[1:16] = rng.integers(0, 3, 15)
        size = int(rng.integers(1, 16))

        def after(h, levels=levels, size=size):
            n = levels.count.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return int((n[1:16] ** 2).sum())

        able = [0, *(h for h in range(1, 17 - size) if levels.count[h])]
        assert after(levels.choose(size)) == min(map(after, able))


# 6 and 10


def planted(seed=8, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["scumbag", "vermin", "scumlord"])
        if bad:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return rows + [(n, None), (n + 1, ""), (1, rows[1][1])], labels


def test_quality(spark):
    rows, labels = planted()
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, rows), lab)
    got = quality.score_documents(docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    y = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert held and sum(r.predicted == y[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    kept = quality.keep_good(docs(spark, rows), model)
    assert kept.columns == docs(spark, rows).columns
    none = quality.fit(docs(spark, rows), lab.limit(0))
    assert {r.score for r in quality.score_documents(docs(spark, rows), none).collect()} == {0.5}
    assert quality.score_documents(docs(spark, EMPTY), model).count() == 0


def brute_isotonic(scores, y):
    """Least squares over non-decreasing steps by the max-min formula, at each distinct score."""
    at = sorted(set(scores))
    sums = [(sum(v for x, v in zip(scores, y, strict=True) if x == a), sum(1 for x in scores if x == a)) for a in at]
    mean = lambda i, j: (sum(s for s, _ in sums[i : j + 1]) / sum(n for _, n in sums[i : j + 1]))
    return {at[k]: max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))}


def test_quality_against_numpy(spark):
    """The same model from one table in memory: no partitions, no sums of sums; one id is repeated, of whose rows the least statistics count."""
    rows, labels = planted(12, 240)
    rows = [*rows, (2, "x " * 40), (2, "A!")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, rows).repartition(3), lab)
    y = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    stat = lambda t: quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    by_id = defaultdict(list)
    for i, t in rows:
        if i in y:
            by_id[i].append(tuple(stat(t)))
    ids = sorted(by_id)
    x, q = np.array([min(by_id[i]) for i in ids]), np.array([float(y[i]) for i in ids])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = quality.fourier(x, mean, scale)
    ridge = quality.RIDGE * np.diag([1.0] * quality.FEATURES + [1e-6]) / 10
    solve = lambda own: np.linalg.solve(z[own].T @ z[own] + ridge, z[own].T @ q[own])
    half = np.array([int(quality.mix64(np.array([i], np.int64).astype(np.uint64))[0]) & 1 for i in ids])
    crossed = np.where(half == 0, z @ solve(half == 1), z @ solve(half == 0))
    whole = solve(np.ones(len(ids), bool))
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale) and np.allclose(model.weights, whole, atol=1e-6)
    knots, values = quality.isotonic(crossed, q)
    assert np.allclose(model.knots, knots, atol=1e-6) and np.allclose(model.values, values, atol=1e-6)
    for r in quality.score_documents(docs(spark, rows[:40]), model).collect():
        one = quality.fourier(stat(dict(rows[:40])[r.doc_id])[None, :], mean, scale) @ whole
        assert abs(r.score - float(np.clip(np.interp(one, knots, values), 0, 1)[0])) < 1e-4


def test_isotonic_against_the_formula():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randrange(1, 14)
        s, y = [rng.randrange(6) / 6 for _ in range(n)], [float(rng.randrange(2)) for _ in range(n)]
        want = brute_isotonic(s, y)
        x, v = quality.isotonic(np.array(s), np.array(y))
        steps = [k for k in sorted(want)]
        got = np.interp(steps, x, v)
        # Half a count of either label is added to each step of the fit, and the curve never falls.
        lots = {k: [v for x, v in zip(s, y, strict=True) if want[x] == want[k]] for k in steps}
        smooth = np.maximum.accumulate([(sum(lots[k]) + 0.5) / (len(lots[k]) + 1) for k in steps])
        assert np.allclose(got, smooth, atol=1e-5)


def test_isotonic():
    x, v = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(v) >= 0).all() and (np.diff(x) >= 0).all()


def test_statistics_ignore_neighbours():
    texts = [b"One two, TWO 3!", b"", "é é".encode(), b"a a a"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = quality.statistics(data, offsets)
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_toxicity(spark):
    rows, labels = planted(9)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), lab)
    got = toxicity.score_documents(docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    y = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert held and sum(r.predicted == y[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    empty = toxicity.fit(docs(spark, rows), lab.limit(0))
    assert max(r.score for r in toxicity.score_documents(docs(spark, rows), empty).collect()) < 0.01


def test_toxicity_against_a_loop(spark):
    """Counts, log-odds, which tokens count, the extreme-value fit and the scores, from loops over the texts."""
    rows, labels = planted(10, 300)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows).repartition(3), lab)
    y = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 != 0}
    first = {}
    for i, t in rows:
        if i in y:
            data = np.frombuffer((t or "").encode(), np.uint8)
            sets = ngram_join.shingle_sets(data, np.array([0, len(data)]))[0]
            lot = (int(sets[0].astype(np.int64)) if len(sets) else 0, y[i])
            if lot not in first or i < first[lot][0]:
                first[lot] = (i, t or "")
    own = [(kind, t) for (_, kind), (_, t) in first.items()]
    n = [sum(k == kind for k, _ in own) for kind in (0, 1)]
    seen = defaultdict(lambda: [0, 0])
    for kind, t in own:
        for token in {x for w in re.findall(r"[^\W\d_]+", t.lower()) for x in [w, *(w[:k] + "-" for k in (4, 5, 6) if len(w) >= k)]}:
            seen[token][kind] += 1
    weights = {}
    for token, (clean, toxic) in seen.items():
        prior = toxicity.PRIOR * (clean + toxic) / sum(n)
        odds = lambda k, m, prior=prior: math.log((k + prior) / (m + toxicity.PRIOR - k - prior))
        weight = odds(toxic, n[1]) - odds(clean, n[0])
        z = weight / math.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
        if abs(z) >= toxicity.EVIDENCE and abs(weight) >= toxicity.LEAST_ODDS and (toxic > clean and toxic >= toxicity.FEWEST if weight > 0 else clean >= toxicity.FEWEST):
            weights[token] = weight
    assert set(model.weights) == set(weights) and all(abs(model.weights[k] - v) < 1e-9 for k, v in weights.items())
    assert any(v < 0 for v in weights.values()) or len(weights) > 0
    best = lambda t: max((x[2] for x in model.passages(t)[1]), default=0.0)
    words = lambda t: len(re.findall(r"[^\W\d_]+", t.lower()))
    x, m = np.log1p([words(t) for kind, t in own if not kind]), np.array([best(t) for kind, t in own if not kind])
    slope = max(0.0, float(np.cov(x, m)[0, 1] / x.var()))
    rest = m - slope * x
    spread = max(1.0, float(rest.std()) * math.sqrt(6) / math.pi)
    assert (model.slope, model.spread) == (pytest.approx(slope), pytest.approx(spread)) and model.place == pytest.approx(rest.mean() - 0.5772156649 * spread)
    for r in toxicity.score_documents(docs(spark, rows[:60]), model).collect():
        t = dict(rows[:60])[r.doc_id]
        assert r.score == pytest.approx(model.score(model.evidence(*model.passages(t or ""))))


def test_segments_are_maximal():
    rng = random.Random(10)
    for _ in range(300):
        s = [rng.uniform(-2, 2) for _ in range(12)]

        def split(lo, hi, s=s):
            """The best segment first, then what is left on either side."""
            best = max(((sum(s[i : j + 1]), -(j - i), -i) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return split(lo, i) + [(i, j, best[0])] + split(j + 1, hi)

        got = toxicity.segments(list(enumerate(s)), 0.0)
        want = split(0, 12)
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))


# 7


def brute_kept(rows):
    """(id as text, bytes that stay) of each row."""
    return [(i, kept) for i, _, _, _, kept in brute_cuts(rows)]


def brute_cut(rows):
    return sorted((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute_cuts(rows))


def brute_cuts(rows):
    seen, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - 49):
            if i is not None:
                seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if i is not None and seen[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]][: len(b)]).sum()), kept))
    return out


def test_suffix(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randrange(30, 120))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(10) : rng.randrange(40, 120)] for _ in range(rng.randrange(0, 8)))) for i in range(300)]
    rows += [(1000 + i, "a" * (40 + i)) for i in range(30)] + [(2000, None), (2001, ""), (2002, "xy" * 300), (2003, "xy" * 200), (2004, "z" + "xy" * 100), (None, base[0] * 3), (2005, base[0] * 3), (2006, base[0] * 3), (2006, base[0] * 3)]
    rng.shuffle(rows)
    cut = suffix.cut_documents(docs(spark, rows).repartition(5))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in cut.collect())
    assert got == brute_cut(rows)
    out = suffix.without_repeats(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns and out.count() == len(rows)
    assert suffix.cut_documents(docs(spark, EMPTY)).count() == 0


def cuts(spark, rows):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.cut_documents(docs(spark, rows)).collect())


def test_suffix_of_repeated_ids(spark, monkeypatch):
    rng = random.Random(6)
    p, q = ("".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(2))
    for rows in ([(1, p), (5, "zz" + p), (5, q)], [(1, p), (5, "zz" + p), (5, "short")], [(5, p), (5, "zz" + p), (6, q + p), (6, p), (6, p)]):
        assert cuts(spark, rows) == brute_cut(rows)
    # A passage that many blocks of a task have, in falling order of ids too.
    monkeypatch.setattr(suffix, "BLOCK", 2000)
    for sign in (1, -1):
        rows = [(sign * i, f"{i} {q[: 40 + i % 9]} {p} {i * 7}") for i in range(120)]
        assert cuts(spark, rows) == brute_cut(rows)


def test_suffix_of_hot_anchors(spark, monkeypatch):
    """A line that every document has, each time in other surroundings; its windows meet one by one."""
    rng = random.Random(7)
    line = "".join(rng.choice("abcdefgh ") for _ in range(60))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    rows = [(i, " ".join(word() for _ in range(12)) + line + " ".join(word() for _ in range(rng.randrange(12)))) for i in range(150)] + [(200, line), (7, line * 2), (201, line[:49])]
    want = brute_cut(rows)
    for hot in (10**9, 3, -1):
        monkeypatch.setattr(suffix, "HOT", hot)
        assert cuts(spark, rows) == want
    count, contexts = np.array([2, 1, 3], np.int32), np.arange(3 * suffix.CONTEXT, dtype=np.uint8).reshape(3, -1)
    entry, within, out = suffix.windows_of(count, contexts)
    assert entry.tolist() == [0, 0, 1, 2, 2, 2] and within.tolist() == [0, 1, 0, 0, 1, 2]
    assert all((out[k, : suffix.LEAST] == contexts[e, w : w + suffix.LEAST]).all() and not out[k, suffix.LEAST :].any() for k, (e, w) in enumerate(zip(entry, within, strict=True)))


def test_surroundings_are_packed_over_blocks(monkeypatch):
    """Entries of many blocks share the rows of their ranges, the filter lets every shared anchor through, and few others pass."""
    rng = np.random.default_rng(3)
    token = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    bits = np.zeros(1 << 17, np.uint8)
    for h in suffix.filter_hashes(token[:20_000]):
        np.bitwise_or.at(bits, (h >> np.uint64(15)).astype(np.int64), np.uint8(1) << ((h >> np.uint64(12)) & np.uint64(7)).astype(np.uint8))
    assert suffix.passes(bits, token[:20_000]).all() and suffix.passes(bits, token[20_000:]).mean() < 0.02
    monkeypatch.setattr(suffix, "BLOCK", 2000)
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 26, 1000)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts), pa.array([0] * 200, pa.int64())], names=["doc_id", "text", "row"])

    class Known:
        value = np.full(1 << 13, 255, np.uint8)

    out = pa.Table.from_batches(suffix._surroundings(500, np.zeros(1 << suffix.BUCKET_BITS, bool), Known)([batch]))
    assert len(out) <= 500 and len(b"".join(out.column("counts").to_pylist())) > 40_000


def test_surroundings_go_in_rounds(spark, monkeypatch):
    """Where every anchor is shared, no round sends much more than its share of the texts; all rounds together send each entry once, and the cuts are the same."""
    rng = np.random.default_rng(8)
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 26, 1000)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts), pa.array([0] * 200, pa.int64())], names=["doc_id", "text", "row"])
    cold = np.zeros(1 << suffix.BUCKET_BITS, bool)

    class Known:
        value = np.full(1 << 13, 255, np.uint8)

    def sent(*args):
        out = pa.Table.from_batches(suffix._surroundings(20, cold, Known, *args)([batch]))
        held = {c: b"".join(out.column(c).to_pylist()) for c in ("tokens", "docs", "rows", "starts", "counts", "contexts")}
        return sum(map(len, held.values())), sorted(zip(np.frombuffer(held["docs"], np.int64).tolist(), np.frombuffer(held["starts"], np.int32).tolist(), strict=True))

    size, whole = sent()
    rounds = suffix.rounds_for(len(whole), 200_000)
    parts = [sent(k, rounds) for k in range(rounds)]
    assert size > 5 * 200_000 and max(p[0] for p in parts) < 1.2 * suffix.ROUND_SHARE * 200_000
    assert sorted(x for p in parts for x in p[1]) == whole
    p, q = ("".join(chr(97 + k) for k in rng.integers(0, 26, 400)) for _ in range(2))
    rows = [(i, p[i : 200 + 7 * i] + str(i) + q[3 * i : 90 + 5 * i]) for i in range(40)] + [(50, p + q), (None, p), (51, q + p), (51, p)]
    monkeypatch.setattr(suffix, "rounds_for", lambda entries, size: 3)
    assert cuts(spark, rows) == brute_cut(rows)
    assert suffix.cut_documents(docs(spark, EMPTY)).count() == 0


def test_frequent_passages_are_settled_early():
    """Of a class that a task has met often, only what can be the smallest id is sent again."""
    contexts, frequent = np.zeros((6, suffix.CONTEXT), np.uint8), {}
    token, count = np.full(6, 9, np.uint64), np.full(6, 3, np.int32)
    for ids, want in (([7, 8, 9, 7, 8, 9], [7]), ([8, 9, 10, 8, 9, 10], [7]), ([5, 6, 9, 9, 9, 9], [5]), ([6, 7, 9, 9, 9, 9], [5])):
        cls, lowest = suffix.classes(token, count, contexts, np.array(ids))
        assert suffix.settle(cls, lowest, token, count, contexts, frequent).tolist() == want
    few = suffix.classes(token[:2], count[:2], contexts[:2], np.array([20, 21]))
    assert suffix.settle(*few, token[:2], count[:2], contexts[:2], frequent).tolist() == [20]


def test_suffix_order():
    rng = np.random.default_rng(11)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1200] = data[:200]
    prefix = suffix.prefix_hashes(np.r_[data, np.zeros(suffix.LEAST, np.uint8)])
    padded = np.r_[data, np.zeros(suffix.LEAST, np.uint8)]
    at = rng.permutation(2900)
    group = np.sort(rng.integers(0, 5, 2900))
    order = suffix.sort_suffixes(padded, prefix, at, group)
    for g in range(5):
        mine = np.flatnonzero(group == g)
        got = [padded[at[i] : at[i] + 50].tobytes() for i in order[mine]]
        assert got == sorted(got) and sorted(order[mine]) == mine.tolist()


# 8


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. CC BY-NC cc by nc"), (3, "GNU General Public License, version 3"), (4, None), (5, ""), (6, "undér the mit license İ K"), (7, "CC BY-NC-SA 4.0 license"), (8, "under the mit license " * 400), (9, "SPDX-License-Identifier: BSD-3-Clause"), (1, "Released under the MIT License.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = re.findall(licenses.WORD, (t or "").translate(lower))
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[3].labels == "gpl-3" and got[9].labels == "bsd-3" and got[7].labels == "cc-by-nc,cc-by-nc-sa"
    assert got[2].labels == "apache-2,cc-by-nc"
    assert len(licenses.rules()) > 200
    assert licenses.scan_licenses(docs(spark, EMPTY)).count() == 0


BARE_NOTICES = [
    ("mit-0", "MIT-0"), ("mit-0", "MIT No Attribution"), ("apache-2", "Apache 2.0"), ("apache-2", "Apache Software, Version 2"), ("apache-1.1", "Apache 1.1"), ("gpl-3", "GNU General Public, v. 3"), ("gpl-3", "GPLv3."),
    ("gpl-2", "General\nPublic Version 2.0"), ("gpl-2", "GNU GPL-2"), ("lgpl-3", "LGPL 3"), ("lgpl-2.1", "GNU LGPL v2.1"), ("agpl-3", "AGPLv3"), ("bsd-2", "Simplified BSD"), ("bsd-3", "BSD 3-Clause"), ("bsd-4", "4-clause BSD"),
    ("mpl-2", "Mozilla Public 2.0"), ("mpl-1.1", "Mozilla-Public v. 1.1"), ("epl-2", "Eclipse Public 2.0"), ("epl-1", "Eclipse Public v. 1.0"), ("artistic-2", "Artistic 2.0"), ("boost-1", "Boost Software 1.0"),
    ("cc-by", "Creative Commons Attribution"), ("cc-by-sa", "Creative Commons Attribution ShareAlike"), ("cc-by-nc", "Creative Commons Attribution-NonCommercial"), ("cc-by-nd", "Creative Commons Attribution NoDerivatives"),
]


def test_bare_names_need_no_other_word(spark):
    """A bare name is found in a text with nothing else about licenses, as it is beside such a word."""
    texts = [f"Copyright 2020 ACME. {name} All rights kept." for _, name in BARE_NOTICES]
    assert not any(k in t.lower() for t in texts for k in ("licen", "cc", "under"))
    rows = [(i, t + also) for k, also in enumerate(["", " Under"]) for i, t in enumerate(texts, k * 100)]
    rows += [(900, "xGPLv3 apachex 2 GPLv30 commons attribution"), (901, "éGPLv3"), (902, "GPL\u00b73")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    for i, (label, name) in enumerate(BARE_NOTICES):
        assert label in got[i][0].split(",") and got[i][1] == 0.4, name
        assert got[i] == got[100 + i], name
    assert [got[i] for i in (900, 901, 902)] == [("", 0.0)] * 3


def brute_labels(text):
    """A loop over all rules, without gate and prefilter: labels that stay, and the score."""
    words = re.findall(licenses.WORD, text.translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    line, found = " " + " ".join(words) + " ", []
    for order, (label, priority, _, pattern) in enumerate(licenses.all_rules()):
        for m in re.finditer(pattern, line):
            first = line.count(" ", 0, m.start()) - 1
            found.append((first, first + m[0].count(" "), priority, order, label))
    kept = [x for x in found if not any(y != x and y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and (y[:2] != x[:2] or y[2] > x[2] or y[3] < x[3]) for y in found)]
    doubt = 1.0
    for x in kept:
        doubt *= 1 - licenses.CONFIDENCE[x[2] - 1]
    return ",".join(sorted({x[4] for x in kept} | {label for p, label in licenses.BASE.items() if f" {p} " in line})), round(1 - doubt, 9)


def test_rules_against_a_loop(spark):
    rng = random.Random(8)
    told = ["This project is GPL v3 software.", "Apache 2.0", "bsd 3 clause", "MIT-0", "mit 0 cc\nby", "Permission is hereby granted, free of charge, to any person obtaining a copy", "\u212aCC BY-NC mit der", "All rights reserved", "x" * 200_000 + " GPL-2.0-or-later"]
    parts = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??|\?|\[(.)[^]]*\]|\.\{.*?\}", r"\1\2", p[len("(?<= )(?:") : -len(")(?= )")]) for *_, p in licenses.all_rules()]
    rows = [(i, t) for i, t in enumerate(told)]
    for i, p in enumerate(parts):
        rows.append((1000 + i, p))
        rows.append((3000 + i, f"{rng.choice(['The', 'licensed under the', 'SPDX-License-Identifier:'])} {p.title()}, {rng.choice(parts)}; {rng.choice(['or later', 'license', '3.0', 'only'])} {rng.choice(parts).upper()}"))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    want = {i: brute_labels(t) for i, t in rows}
    assert {i: (got[i][0], round(got[i][1], 6)) for i in got} == {i: (x, round(y, 6)) for i, (x, y) in want.items()}
    assert [got[i][0] for i in range(6)] == ["gpl-3", "apache-2", "bsd-3", "mit-0", "cc-by,mit-0", "mit"]
    assert sum(bool(got[1000 + i][0]) for i in range(len(parts))) > 0.9 * len(parts)


# 9


def hash64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def shingles_of(text):
    words = [hash64(w.encode()) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = set()
    for k in range(max(1, len(words) - 4)) if words else ():
        h = 42
        for w in words[k : k + 5] if len(words) >= 5 else words:
            h = hash64(w.to_bytes(8, "little"), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def brute_sketch(hashes):
    return sorted(h for h in hashes if h < sketch.threshold(sketch.FRACTION))


def brute_likeness(s, t):
    return len({*s} & {*t}) / len({*s} | {*t}) if s or t else 1.0


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(sketch, "ROWS_PER_RANGE", 20)
    rng = random.Random(3)
    long = [f"word{rng.randrange(20_000)}" for _ in range(60_000)]
    rows = [*odd_texts(12), (1006, "repeated id"), (1006, "repeated id"), *((None, f"no id {k} " + "x " * (k % 7)) for k in range(60)), (3000, " ".join(long)), (2999, " ".join(long[:30_000]) + " end"), (None, None)]
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in sketch.fingerprint_documents(docs(spark, rows)).collect())
    # Descending ids, texts in order within an id; then those without id, by a hash of their text.
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hash64(x[1].encode()) >> 1 if x[0] is None else 0, x[1]))
    text = lambda s: "".join(f"{h & (1 << 64) - 1:016X}" for h in s)
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (brute_sketch(shingles_of(x)) for x in (t, edited, after))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    assert got == sorted(want)
    assert sketch.fingerprint_documents(docs(spark, EMPTY)).count() == 0
    assert sketch.fingerprint_documents(docs(spark, [(1, "a b c")])).count() == 1


def test_containment_of_unequal_documents(spark):
    """Within four standard errors at every size, and exact where one text holds the other."""
    words = [f"w{i}" for i in range(40_000)]
    rows = [(n, " ".join(words), " ".join([*words[: n // 2], *(f"v{i}" for i in range(n - n // 2))])) for n in (40, 232, 2500, 20_000)]
    df = sketch.with_sketch(spark.createDataFrame([*rows, (4, " ".join(words), " ".join(words[100:150]))], "n int, a string, b string"), "a", "sa")
    df = sketch.with_sketch(df, "b", "sb")
    for r in df.select("n", sketch.containment(F.col("sb"), F.col("sa")).alias("c"), sketch.containment(F.col("sa"), F.col("sb")).alias("d"), F.size("sa").alias("size")).collect():
        assert abs(r.size - 10_000) < 400
        if r.n == 4:
            assert r.c == 1.0
            continue
        assert abs(r.c - 0.5) < 4 * (0.25 / (r.n / 4)) ** 0.5 and abs(r.d - r.n / 80_000) < 0.02


def test_sketches_merge(spark):
    rng = random.Random(4)
    sets = [{rng.getrandbits(64) - (1 << 63) for _ in range(n)} for n in (0, 1, 3, 20, 31, 32, 33, 300, 5000)]
    pairs = [(a, b) for a in sets for b in sets]
    df = spark.createDataFrame([(k, brute_sketch(a), brute_sketch(b)) for k, (a, b) in enumerate(pairs)], "k int, a array<bigint>, b array<bigint>")
    got = {r.k: list(r.m) for r in df.select("k", sketch.merge(F.array("a", "b")).alias("m")).collect()}
    assert got == {k: brute_sketch(a | b) for k, (a, b) in enumerate(pairs)}


def test_every_contract_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, small, name):
    assert compare.differences(compare.connect(small), queries.ORACLE_SQL[name], queries.QUERIES[name](spark, small)) == []


def test_pipeline(spark, small):
    import corpus_pipeline

    ids = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "start", "length", "sequence_id"} <= set(out.columns)
    assert {r.doc_id for r in out.select("doc_id").collect()} <= ids


def test_pipeline_stages_against_brute_force(spark, small):
    """Each stage on its own input: nulls, empties, repeats, very long texts and extra columns among the rows."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    long = " ".join(f"w{i % 997}x{i % 1009}" for i in range(60_000))
    rows = [*own, (900_001, None), (900_002, ""), (900_003, own[0][1]), (900_003, own[0][1]), (900_004, long), (900_005, long + " end"), (None, own[1][1]), (900_006, own[2][1]), (900_006, own[3][1])]
    lab = spark.read.parquet(f"{small}/labels.parquet")
    key = lambda out: sorted((str(r.doc_id), r.text or "") for r in out)
    table = docs(spark, rows)

    accepted = stage["quality"](spark, table, small)
    score = quality.score_documents(table, quality.fit(table, lab)).select("score").collect()
    assert accepted.columns == table.columns and key(accepted.collect()) == sorted((str(i), t or "") for (i, t), s in zip(rows, score, strict=True) if s.score >= 0.5)
    calm = stage["toxicity"](spark, table, small)
    score = toxicity.score_documents(table, toxicity.fit(table, lab)).select("score").collect()
    assert calm.columns == table.columns and key(calm.collect()) == sorted((str(i), t or "") for (i, t), s in zip(rows, score, strict=True) if s.score < 0.5)
    single = stage["ngram_join"](spark, table, small)
    component = {i: c for i, _, c in brute_links(rows)}
    assert single.columns == table.columns and key(single.collect()) == sorted((str(i), t or "") for i, t in rows if component[str(i)] == str(i))
    few = [*own[:150], (900_001, None), (900_002, ""), (900_003, own[0][1]), (900_003, own[0][1]), (None, own[1][1]), (900_006, own[2][1]), (900_006, "z" + own[3][1])]
    cut = stage["suffix"](spark, docs(spark, few), small)
    want = brute_cut(few)
    assert cut.columns == table.columns
    got = sorted((str(r.doc_id), len(r.text), r.n_chars) for r in cut.collect())
    kept = sorted((i, len(b.decode("utf-8", "ignore"))) for i, b in brute_kept(few))
    assert [(i, n) for i, n, _ in got] == kept and all(n == c for _, n, c in got) and len(got) == len(want)
    ids = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    pieces = stage["packing"](spark, table, small).collect()
    assert sum(r.length for r in pieces) == sum(len(ids.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for f in stage.values():
        assert f(spark, docs(spark, EMPTY), small).count() == 0
