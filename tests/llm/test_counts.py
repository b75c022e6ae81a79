"""Counting operators against brute force, with nulls, empties, very long texts, ties, repeats, empty tables and clashing columns."""

import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import collocations, divergence, tokens, words

ROWS = "doc_id long, text string, lang string, source string, n_chars long, n long, docs long, term string, phrase string, id long"


def table(spark, rows):
    """(doc_id, text, lang, source) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(*r, 5, 7, 8, "t", "p", 9) for r in rows], ROWS)


# 13


def odd_texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    anything = "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0x600), rng.randrange(0x4E00, 0x4F00), 0x20, 0x1F600])) for _ in range(4000))
    return [
        None, "", " \t\n", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> <|endof", "ΑΣ ΣΑΣ. é ́x İstanbul ﬁ ǅ", "x" * 5000, "ab" * 4000,
        "".join(rng.choice(letters) for _ in range(9000)), "日本語テキスト🙂🙂 don't we'll I'M", "a b　c\x1cd\x85e", "aaa aaaa aaaaa aaaaaa", "１２３ ½ ٣٤ 2024", anything,
        *("".join(rng.choice(letters + "'!-.éü \n") for _ in range(rng.randrange(1, 60))) for _ in range(300)), "the same", "the same", "word " * 30_000,
    ]


def test_token_counts(spark):
    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts()
    rows = [(i if i % 7 else None, t, None, "s") for i, t in enumerate(texts)]
    got = tokens.count_tokens(table(spark, rows), path).collect()
    want = []
    for (i, *_), text in zip(rows, texts, strict=True):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.count_tokens(table(spark, []), path).count() == 0


def test_merging_of_long_sequences_is_the_same(monkeypatch):
    counter = tokens.Counter(public.path("word_bpe_49k.json"))
    rng = random.Random(2)
    for text in ["a", "aaaaaaa", "x" * 300, "ab" * 200, *("".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 400))) for _ in range(40))]:
        data = np.frombuffer(text.encode(), np.uint8)
        symbols = counter.merges.symbols(data, np.array([0, len(data)]))
        assert counter.merges.count(symbols.copy(), np.array([0, len(data)]))[0] == counter.merges.count_long(symbols.copy())
    texts = [t.encode() for t in ("don't", "straße", "été's", "a" * 70)]
    want = counter.units(texts).tolist()
    monkeypatch.setattr(tokens, "UNITS", 1)
    monkeypatch.setattr(tokens, "PARTS", 1)
    monkeypatch.setattr(tokens, "TOGETHER", 3)
    again = tokens.Counter(public.path("word_bpe_49k.json"))
    assert [again.units([t]).tolist()[0] for t in texts] == want


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="white space"):
        tokens.Counter(public.path("byte_bpe_50k.json"))
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError, match="merges"):
        tokens.Merges(spec["model"]["vocab"], spec["model"]["merges"], "</w>")


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sources(seed):
    """Texts of a few languages and sources, one of which has a third of all; null and empty fields, copies, a group without terms."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéÉÀß") for _ in range(rng.randrange(1, 5))) for _ in range(90)] + ["日本", "x" * 500]
    rows = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "", "ç", "Z"])
        rows.append((i // 2, rng.choice([" ", "-", "3", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))), lang, source))
    return [*rows, (None, None, "fr", "none"), (9, "", "en", "none"), (9, " 12 ", "de", "only"), (9, "word", "nl", "one"), (8, "word", "nl", "two"), (7, "word " * 4000, "en", "hot")]


# 11


def brute_audit(rows, least=3, parts=10**9, top=200):
    of_lang, of_group, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        of_lang[lang or ""] += terms
        of_group[lang or "", source or ""] += terms
        docs[lang or ""].update(terms.keys())
    out = []
    for lang, source in of_group:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def share(counts, term, kept=kept):
            return 1 + parts * (counts[term] + 1) // (sum(counts[t] for t in kept) + len(kept))

        own, all_of = of_group[lang, source], of_lang[lang]
        p = {t: share(own, t) for t in kept}
        pairs = []
        for other_lang, other in of_group:
            if other_lang == lang and other != source:
                q = {t: share(of_group[lang, other], t) for t in kept}
                pairs.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        q = {t: share(all_of, t) for t in kept}
        telling = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if own[t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", telling)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def test_source_audit(spark, monkeypatch):
    rows = sources(4)
    want = brute_audit(rows)
    assert len({r[2] for r in want}) == 2
    columns = ["lang", "source", "part", "item", "value", "rank"]
    got = divergence.audit_sources(table(spark, rows))
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == want
    # Few held rows and few pairs at once give the same.
    monkeypatch.setattr(divergence, "PAIRS", 7)
    assert sorted(map(tuple, divergence.audit_sources(table(spark, rows), least_docs=5, parts=1000, top=3).collect())) == brute_audit(rows, 5, 1000, 3)
    assert divergence.audit_sources(table(spark, [])).count() == 0


def test_sums_are_handed_on_in_time():
    import pyarrow as pa

    schema = pa.schema([("k", pa.int64()), ("n", pa.int64())])
    sums, rng, want, got = words.Sums(["k"], ["n"], schema, 50), np.random.default_rng(1), Counter(), Counter()
    handed = []
    for _ in range(40):
        k = rng.integers(0, 200, 30)
        want.update(k.tolist())
        handed += sums.add([pa.array(k), pa.array(np.ones(30, np.int64))])
        assert sums.rows < 50 + 30
    for batch in [*handed, *sums.rest()]:
        for k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[k] += n
    assert got == want and sums.rest() == []


# 12


def brute_phrases(rows, longest=5, least=100, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(w)
            counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            value, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((" ".join(p), a, left, right, total[lang], value))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, rank, *x) for rank, x in enumerate(found[:top], 1)]
    return sorted(out)


def speech(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "é", "a-b", "\x1f", "日本", *(f"w{i}" for i in range(12))]
    fixed = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 9))) for _ in range(12)]
    rows = []
    for i in range(200):
        parts = [rng.choice(fixed) if rng.random() < 0.6 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ", ", "\n", ". "]) for p in parts)
        rows.append((i % 50, text, rng.choice(["en", "en", "fr", None, "und", ""]), "hot"))
    return [*rows, rows[3], (None, None, None, None), (1, "", "xx", None), (2, " .,; ", "xx", None), (3, "a a a a a a a a " * 2000, "yy", "s")]


@pytest.mark.parametrize("least", [3, 12])
def test_collocations(spark, monkeypatch, least):
    rows = speech(least)
    got = collocations.mine_phrases(table(spark, rows), least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least=least)
    # A filter that lets nearly everything through, small slices and early hand-overs give the same rows.
    monkeypatch.setattr(collocations, "BITS", 18)
    monkeypatch.setattr(collocations, "HASHED_BYTES", 500)
    monkeypatch.setattr(collocations, "HELD_HASHES", 40)
    assert sorted(map(tuple, collocations.mine_phrases(table(spark, rows), longest=3, least=least, top=5).collect())) == brute_phrases(rows, 3, least, 5)


def test_collocations_of_little(spark):
    assert collocations.mine_phrases(table(spark, [])).count() == 0
    assert collocations.mine_phrases(table(spark, [(1, "one two three", "en", "s"), (2, None, None, None)])).count() == 0


def test_stage_tables_have_an_owner(spark, small):
    from fieldloom.llm import common, queries

    common.clean(spark)
    rows = queries.QUERIES["op12_collocations"](spark, small)
    assert rows.count() >= 0
    left = [*common._STAGED]
    assert left and common.clean(spark) == len(left) and not common._STAGED
    path = spark._jvm.org.apache.hadoop.fs.Path(left[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 3 * 10**15 + 1, 9 * 10**16 + 7, 4 * 10**15 + 3, 5 * 10**15 + 9
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(collocations.score(*[F.col(c) for c in "anlr"])).first()
    assert row[0] == 1000 * a * n // (left * right)
