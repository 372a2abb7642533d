"""op1, op2, op3, op7, op9 and op10 against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from precis.llm import decontaminate, divergence, near_dup, secrets, suffix_dedup, token_count
from precis.llm.common import text_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_removal(texts):
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - 399):
            seen.setdefault(t[s:s + 400], []).append((i, s))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s:s + 400] = b"\1" * 400
    out = []
    for t, g in zip(texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((len(t), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    r = random.Random(seed)
    shared = [bytes(r.choices(b"abcdef gh", k=r.randint(380, 1500))) for _ in range(5)]
    texts = []
    for _ in range(40):
        t = b""
        for _ in range(r.randint(0, 4)):
            t += bytes(r.choices(b"xyz klm", k=r.randint(0, 600)))
            t += r.choice([r.choice(shared), r.choice(shared)[r.randint(0, 300):], b"", b"q" * r.randint(300, 900)])
        texts.append(t)
    return texts + texts[:3] + [b"", b"ab" * 500]


@pytest.mark.parametrize("limit", [50_000, 3])  # 3: every shared passage is split as an overfull group
def test_repeats_equal_brute_force(spark, limit):
    texts = passages(1)
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts)


def test_repeats_of_documents_and_odd_rows(tables, odd_docs):
    docs = tables["documents"]
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute_removal([r.text.encode() for r in rows])))
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()} == want
    df, odd = odd_docs
    got = suffix_dedup.remove_repeats(df, with_kept=True).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[2].n_bytes, by[3].n_bytes, by[6].n_removed) == (0, 0, 0)
    assert by[4].n_removed == by[4].n_bytes == 540_000 and by[4].n_spans == 1 and by[5].n_removed == 50_000
    assert by[7].n_removed == by[7].n_bytes == by[8].n_removed and bytes(by[1].kept).decode() == odd[0][1]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_secrets_equal_the_patterns(spark, tables, odd_docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    r = random.Random(3)
    parts = ["token=", "secret: ", "AKIA", "Api_Key='", "abcdefgh", "0123456789abcdef", "é ", "\n", "PASSWD = ", "XYZ0", "deadbeef", "\U0001F600"]
    made = ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(300)]
    rows = list(enumerate(made)) + [(10_000 + x.doc_id, x.text) for x in tables["documents"].select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for x in secrets.scan(df).collect():
        t = texts[x.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert ",".join(s for s in x.spans.split(",") if not s.startswith("entropy")) == want
    df, odd = odd_docs
    got = secrets.scan(df).collect()
    assert len(got) == len(odd) and all(x.spans == "" for x in got)
    assert secrets.scan(df.limit(0)).count() == 0
    assert secrets.redact(df).columns == df.columns
    assert sorted(map(str, secrets.redact(df).select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))


def test_entropy_adds_spans_and_allows(spark):
    texts = ["key AB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1 end", "sha256: AB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1", "thisisaverylongwordwithoutdigitsatall",
             "1234567890123456789012345678", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1", "example_AB3dE5fG7hI9jK1lM3nO5pQ7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secrets.scan(df).collect()}
    assert got == {0: "entropy:4:34", 1: "", 2: "", 3: "", 4: "", 5: ""}
    assert {r.text for r in secrets.redact(df).where("doc_id = 0").collect()} == {"key [secret] end"}


def test_entropy_finds_random_keys_of_each_class(spark):
    r = random.Random(11)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"base32": low.upper() + "234567", "low32": low + "234567", "low36": low + digits, "up36": low.upper() + digits,
                 "base62": low + low.upper() + digits, "base64": low + low.upper() + digits + "+/"}
    keys = [(name, n, "".join(r.choices(a, k=n))) for name, a in alphabets.items() for n in (20, 23, 24, 32, 40) for _ in range(300)]
    keys = [k for k in keys if set(k[2]) & set(digits)]
    df = spark.createDataFrame([(i, f"the \u5bc6{k[2]} end") for i, k in enumerate(keys)], "doc_id long, text string")
    found, asked = Counter(), Counter((name, n) for name, n, _ in keys)
    for x in secrets.scan(df).where("n_entropy > 0").collect():
        found[keys[x.doc_id][:2]] += 1
    assert {k: found[k] / n for k, n in asked.items() if found[k] < (0.94 if k[0] == "base64" else 0.97) * n} == {}
    plain = ["src/main/docs/readme2", "some_long_identifier_name_2", "aaaaaaaaaabbbbbbbbbb1", "example_ab3de5fg7hi9jk1lm3no5pq"]
    assert secrets.scan(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")).where("n_entropy > 0").count() == 0


def test_token_counts_equal_the_library(spark, tables, odd_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["a\x0bb c<|endoftext|>d\x85e f  ʼs it's I'LL x́ ́y <|startoftext|> İI ΑΣ Σ   q　r \x1cz  naïve é ½ ﬁ", "", " \n", "<|endof text|>",
           "\x00 a", "don't\tstop", "e ́", " ̸= ≠", "'s 't"]
    df, rows = odd_docs
    texts = odd + [r[1] for r in rows] + [r.text for r in tables["documents"].limit(60).collect()]
    src = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    for size in (64, 4 << 20):  # 64: texts are cut at nearly every space
        got = token_count.count_tokens(src, path, batch_bytes=size).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_count.count_tokens(df, path).count() == len(rows) and token_count.count_tokens(df.limit(0), path).count() == 0


def test_quality_rules_equal_their_definition(tables, odd_docs):
    df, odd = odd_docs
    docs = tables["documents"].select("doc_id", "text", "lang").unionByName(df.select("doc_id", "text", "lang"))
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter()
    for (i, t), n in texts.items():
        t = t or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        places = {}
        for k in range(len(w) - 4):
            places.setdefault(tuple(w[k:k + 5]), []).append(k)
        inside = {j for p in places.values() if len(p) > 1 for k in p for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside),
             len(w) < 10 or 100 * len(inside) > 20 * len(w)] += n
    got = divergence.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    good = {r.doc_id for r in tables["labels"].where("quality = 1").collect()}
    clean = [r for r in got if r.doc_id in good and r.n_words >= 10 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)
    assert divergence.judge(df).count() == len(odd) and divergence.judge(df.limit(0)).count() == 0


def test_js_distance():
    import math

    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum(a * math.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(b * math.log2(b / c) for b, c in zip(q, m) if b) / 2)
    from pyspark.sql import SparkSession

    got = SparkSession.active().range(1).select(divergence.js_distance(
        F.array(F.lit(1), F.lit(1), F.lit(0)), F.lit(2.0), F.array(*map(F.lit, q)))).first()[0]
    assert got == pytest.approx(want)


def brute_contamination(texts, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, its = WORD.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in windows:
                    hit |= set(range(s, s + n))
                    its |= windows[k]
        its.discard(None)
        out.append((len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(map(str, its))).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_equals_brute_force(spark, tables, odd_docs):
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    items += [(900, "Quick brown"), (901, "quick, BROWN fox"), (902, "é"), (903, None), (904, " ."), (None, "some words"), (900, "lorem ipsum dolor " * 5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df, odd = odd_docs
    docs = tables["documents"].select("doc_id", "text").unionByName(df.select("doc_id", "text"))
    rows = docs.collect()
    want = Counter(zip([r.doc_id for r in rows], brute_contamination([r.text for r in rows], items)))
    got = Counter((r.doc_id, tuple(r)[1:]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == want
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not x[4] for x in brute_contamination([r[1] for r in odd], items))
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[s:s + 5]) for s in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_links_equal_brute_force(spark, tables, odd_docs):
    r = random.Random(7)
    vocab = ["w%d" % k for k in range(400)]
    base = r.choices(vocab, k=120)
    near = []
    for _ in range(60):  # a group of near copies, each of its own
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(vocab)
        near.append(" ".join(t))
    texts = near + near[:5] + [x.text for x in tables["documents"].select("text").collect()] + ["one two", "One, two!", "", None, "a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [shingles(t) for t in texts]
    links, parent = Counter(), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s or i, i)
    got = {x.doc_id: (x.class_id, x.n_links, x.group_id, x.n_shingles) for x in near_dup.jaccard_join(df).collect()}
    assert got == {i: (first[s or i], links[i], find(i), len(s)) for i, s in enumerate(sets)}
    kept = near_dup.keep_one(df)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({find(i) for i in range(len(texts))})


def test_jaccard_blocks_lose_no_pair(spark, monkeypatch):
    """Buckets and components far over the block size give the same counts."""
    monkeypatch.setattr(near_dup, "_BLOCK", 7)
    monkeypatch.setattr(near_dup, "_BUCKET", 9)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1:]]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(x.n_links, x.group_id) for x in near_dup.jaccard_join(df).collect()} == {(39, 0)}


def test_jaccard_odd_rows(odd_docs):
    df, odd = odd_docs
    got = near_dup.jaccard_join(df).collect()
    assert len(got) == len(odd)
    assert sorted(r.n_links for r in got) == [0] * 9 + [2] * 3
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(odd) - 2
    assert near_dup.jaccard_join(df.limit(0)).count() == 0 and near_dup.keep_one(df.limit(0)).count() == 0


def test_banding_reaches_the_recall():
    bands, rows = near_dup.banding()
    assert bands * rows <= near_dup.HASHES and 1 - (1 - 0.8 ** rows) ** bands >= near_dup.RECALL
    assert 1 - (1 - 0.8 ** (rows + 1)) ** (near_dup.HASHES // (rows + 1)) < near_dup.RECALL


def test_intersections_by_ranges_of_hashes(monkeypatch):
    monkeypatch.setattr(near_dup, "_RANGE_GRAMS", 50)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, k)) for k in (1, 40, 150, 199, 60)]
    got = near_dup._common(sets)
    for i, j in itertools.permutations(range(len(sets)), 2):
        assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_texts_are_cut_by_bytes_and_lose_no_row():
    texts = ["a" * 5, None, "", "ä" * 40, "b", "c" * 9, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    for limit in (1, 10, 1000):
        got = [(i, t) for b, part in text_rows(iter([batch, batch.slice(7)]), "text", limit)
               for i, t in zip(b.column("id").to_pylist(), part, strict=True)]
        assert got == [(i, (t or "").encode()) for i, t in enumerate(texts)]
