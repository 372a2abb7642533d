"""op11, op12 and op13 against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.llm import filter_audit, line_dedup, repair, suffix_dedup
from precis.llm.line_dedup import Cuckoo, LineIndex

SPACE = " \t\n\x0b\x0c\r"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# ------------------------------------------------------------------ op11

def key_of(line):
    return lower(line.strip(SPACE))


def brute_lines(rows, index=None, least=3):
    """(id, n_lines, n_dropped, kept text) of each row, judged by the rows of ``index``."""
    holders = defaultdict(set)
    for i, t in (rows if index is None else index):
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 20:
                holders[key_of(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders.get(key_of(x), ())) < least or max(holders[key_of(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_texts(seed, n=60):
    r = random.Random(seed)
    pool = ["the same line of many words " + str(k) for k in range(8)] + ["short", "", "  The SAME line of many words 1\t", "é" * 20, "é" * 19, "É" * 20]
    return ["\n".join(r.choice(pool) for _ in range(r.randint(0, 6))) for _ in range(n)]


def sha(rows):
    return sorted(((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in rows), key=str)


def test_lines_equal_brute_force(spark, tables, odd_docs):
    rows = list(enumerate(line_texts(1))) + [(7, "a line of the same id twice over"), (7, "a line of the same id twice over"),
                                             (8, "a line of the same id twice over"), (None, "a line of the same id twice over"),
                                             (None, "é" * 20), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sha(brute_lines(rows)) and any(r[2] for r in got)
    docs = [tuple(r) for r in tables["documents"].select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in line_dedup.dedup_lines(tables["documents"]).collect()), key=str) == sha(brute_lines(docs))
    df, odd = odd_docs
    got = [tuple(r) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sha(brute_lines([r[:2] for r in odd]))
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def state(index):
    return sorted(map(tuple, index.refs.collect())), sorted((tuple(r) for r in index.postings.collect()), key=str)


@pytest.mark.parametrize("shard_keys", [1 << 14, 1])  # 1: filters are outgrown and dealt out again
def test_lines_insert_and_delete_undo_each_other(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    texts = [(i, t + "\na line that only the later ones hold" * (i >= 45)) for i, t in enumerate(line_texts(2, 90))]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second = texts[:45], texts[45:]
    one = LineIndex.build(frame(first))
    both = one.insert(frame(second))
    assert state(both) == state(LineIndex.build(frame(texts)))
    assert state(both.insert(frame(second[:5]))) == state(both)  # a document counts once
    got = [tuple(r) for r in both.apply(frame(texts)).collect()]
    assert sorted(got, key=str) == brute_lines(texts)
    back = both.delete(frame(second).select("doc_id"))
    assert state(back) == state(one)
    assert sorted((tuple(r) for r in back.apply(frame(first)).collect()), key=str) == brute_lines(first)
    # keys that fell below the limit have left the filters
    held = {(r.k1, r.k2) for r in one.refs.where("docs >= 3").collect()}
    every = both.refs.select("k1", "k2")
    assert {(r.k1, r.k2) for r in back._may_be_held(every).collect()} >= held
    assert len(held) <= back._may_be_held(every).count() < both._may_be_held(every).count()


def test_cuckoo_filter_holds_inserts_and_forgets():
    keys = np.random.default_rng(1).integers(-2**63, 2**63, 30_000)
    c = Cuckoo.empty(1 << 13)
    assert c.insert(keys) and Cuckoo.load(c.dump()).may_hold(keys).all()
    others = np.random.default_rng(2).integers(-2**63, 2**63, 50_000)
    assert c.may_hold(others).mean() < 1e-3
    c.delete(keys[:15_000])
    assert c.may_hold(keys[15_000:]).all() and c.may_hold(keys[:15_000]).mean() < 1e-3
    c.delete(keys[15_000:])
    assert not c.table.any()
    assert not Cuckoo.empty(16).insert(keys)  # no room


def test_lines_without_filters_are_the_same(spark, monkeypatch):
    rows = list(enumerate(line_texts(3)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex.build(df)
    want = brute_lines(rows)
    full = LineIndex(index.postings, index.refs, index.filters.withColumn("data", F.lit(None).cast("binary")), index.bits)
    assert sorted((tuple(r) for r in full.apply(df).collect()), key=str) == want  # filters that overflowed
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)  # too large for every task
    monkeypatch.setattr(line_dedup, "DROPS_BROADCAST", 0)
    assert sorted((tuple(r) for r in index.apply(df).collect()), key=str) == want


# ------------------------------------------------------------------ words of shared passages (op1)

def brute_shared(rows, n=51):
    words = {k: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(k[1] or "")) for k in set(rows)}
    holders = defaultdict(set)
    for k, w in words.items():
        for s in range(len(w) - n + 1):
            holders[tuple(w[s:s + n])].add(k)
    out = {}
    for k, w in words.items():
        hit = {j for s in range(len(w) - n + 1) if len(holders[tuple(w[s:s + n])]) > 1 for j in range(s, s + n)}
        out[k] = len(hit)
    return sorted(((k[0], out[k]) for k in rows), key=str)


def test_shared_words_equal_brute_force(spark, tables, odd_docs):
    r = random.Random(8)
    passages = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(45, 130))] for _ in range(5)]
    rows = []
    for i in range(50):
        w = []
        for _ in range(r.randint(0, 3)):
            w += [f"{r.choice('klmnop')}{r.randint(0, 99)}" for _ in range(r.randint(0, 30))]
            p = r.choice(passages)
            w += p[r.randint(0, 20):len(p) - r.randint(0, 20)] * r.choice([1, 1, 2])
        rows.append((i, r.choice([" ", "\n", ", "]).join(w).title()))
    rows += [rows[3], (70, rows[4][1])]
    got = lambda df: sorted(((x.doc_id, x.n_shared_words) for x in suffix_dedup.remove_repeats(df, with_shared=True).collect()), key=str)
    want = brute_shared(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want and sum(x[1] > 0 for x in want) > 10
    assert got(tables["documents"]) == brute_shared([tuple(x) for x in tables["documents"].select("doc_id", "text").collect()])
    df, odd = odd_docs
    assert got(df) == brute_shared([x[:2] for x in odd])


# ------------------------------------------------------------------ op12

def brute_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marks = {k: {i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1)}
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first.get(t, i)}
        parts[lang or ""].append(({x for x in fails if fails[x]}, i in marks[0], i in marks[1]))
    rows = {}
    for part, ds in parts.items():
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            left = ds
            for k, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                share[x] += len(gone)
                rows[part, "".join(order), k] = [len(left), len(gone), sum(x in d[0] for d in ds) - len(gone), sum(d[0] == {x} for d in ds),
                                                 sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order, 1):
                rows[part, "".join(order), k].append(share[x])
    return rows


def audited(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_brute_force(spark, tables, odd_docs):
    docs, labels = tables["documents"], tables["labels"]
    want = brute_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()],
                       [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert audited(filter_audit.audit_filters(docs, labels)) == want
    df, odd = odd_docs
    marks = [(1, 1, 0), (1, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    lab = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1)).withColumn("mask", F.lit(2))
    assert audited(filter_audit.audit_filters(df, lab)) == brute_audit([r[:3] for r in odd], marks)
    assert filter_audit.audit_filters(df.limit(0), lab).count() == 0
    assert audited(filter_audit.audit_filters(df, lab.limit(0))) == brute_audit([r[:3] for r in odd], [])


def test_diagram_swaps_visit_every_order_and_keep_the_counts():
    r = random.Random(4)
    for n in (1, 2, 3, 4, 5):
        counts = {m: (r.randint(1, 9), r.randint(0, 3), 0) for m in range(1 << n) if r.random() < 0.6} or {0: (1, 0, 0)}
        d, seen = filter_audit.Diagram(counts, n), set()
        for at in [None, *filter_audit.adjacent_swaps(n)]:
            if at is not None:
                d.swap(at)
            seen.add(tuple(d.order))
            for mask in range(1 << n):
                node = d.root
                for level, x in enumerate(d.order):
                    node = d.branches(node, level)[mask >> x & 1]
                assert d.all_pass(node) == counts.get(mask, (0, 0, 0))
        assert len(seen) == math.factorial(n)


def test_audit_of_three_filters(spark):
    rows = [("p", m, 1, 0) for m in (0, 1, 1, 3, 4, 7)]
    got = filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, good int, toxic int"), "xyz")
    by = {(r.filter_order, r.step): r for r in got.collect()}
    assert len(by) == 18 and (by["xyz", 1].removed, by["xyz", 2].removed, by["xyz", 3].removed) == (4, 0, 1)
    assert by["zyx", 3].kept == 1 and by["zyx", 3].removed == 2 and by["zyx", 3].unique_fails == 2 and by["zyx", 3].redundant == 2


# ------------------------------------------------------------------ op13

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda c: " " if c is None else str(c)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        t = text.rstrip(SPACE)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """By trying all edits with up to two insertions at each place."""
    faults, best = faults_of(turns), None
    for ins in itertools.product(("", "I", "II"), repeat=len(turns) + 1):
        for edits in itertools.product("KRD", repeat=len(turns)):
            if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
                continue
            audit = "".join(i + e for i, e in zip(ins, edits)) + ins[-1]
            text = replay(turns, audit)
            if text is None:
                continue
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[c] for c in audit) + sum(
                3 for f, e in zip(faults, edits) if f == "truncated" and e != "D")
            best = min(best or (cost, audit), (cost, audit))
    return best


def replay(turns, audit):
    """The repaired text, or None if its roles do not alternate."""
    out, rest = [], iter(turns)
    last = lambda: out[-1][0][:1] if out else ""
    for e in audit:
        want = "assistant" if last() == "u" else "user"
        if e == "I":
            out.append((want, ""))
        else:
            role, text = next(rest)
            if e != "D":
                out.append((want if e == "R" else role, text))
    if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
        return None
    return "\n".join(f"{r}:{t}" for r, t in out)


def walked(turns):
    """The same by a walk over the turns, for long conversations."""
    faults, best = faults_of(turns), {"": (0, "")}
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

    def put_in(best):
        for _ in range(2):
            for s, (c, a) in list(best.items()):
                new = (c + 3, a + "I")
                best[nxt[s]] = min(best.get(nxt[s], new), new)
        return best

    for (role, _), fault in zip(turns, faults):
        now = {}
        for s, (c, a) in put_in(dict(best)).items():
            moves = [(s, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                moves.append((nxt[s], 3 + more, "R"))
                if role[:1] == nxt[s] or (s == "" and role[:1] == "s"):
                    moves.append((role[:1], more, "K"))
            for to, cost, e in moves:
                new = (c + cost, a + e)
                now[to] = min(now.get(to, new), new)
        best = now
    best = put_in(dict(best))
    return min(best[s] for s in ("", "a") if s in best)


def check(df, rows, damage=True, brute=cheapest):
    convs = defaultdict(list)
    for r in damaged(rows) if damage else [(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows]:
        convs[r[0]].append(r[1:])
    got = repair.repair(df, damaged=damage).collect()
    assert Counter(r.conv_id for r in got) == Counter({r[0] for r in rows})
    for r in got:
        # equal turn numbers: the order that the operator defines is by role first; texts here do not tie
        turns = sorted(convs[r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        numbers = {x[0] for x in turns} - {None}
        said = [x[1:] for x in turns]
        faults = faults_of(said)
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit = brute(said)
        want = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                pairs, cost, audit, hashlib.sha256(replay(said, audit).encode()).hexdigest())
        assert tuple(r)[1:] == want, (r.conv_id, said)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_equals_brute_force(spark):
    r = random.Random(5)
    texts = ["Hello.", "What?", "no end", "", " \t\n", "Yes! ", "other."]
    rows = []
    for conv in range(120):
        for turn in range(r.randint(0, 4)):
            rows.append((conv, turn + r.randint(0, 1) * 7, r.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), r.choice(texts)))
    rows = list({(c, t): (c, t, a, x) for c, t, a, x in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(df, rows, damage=False)
    check(df.withColumns({k: F.lit(1) for k in ("own", "ck", "pos", "piece", "conv", "letter", "h1")}), rows)


def test_repair_of_given_and_long_conversations(spark, tables):
    given = [tuple(r) for r in tables["conversations"].select("conv_id", "turn", "role", "text").collect()]
    check(tables["conversations"], given, brute=walked)
    r = random.Random(6)
    long = [(c, t, r.choice(["system", "user", "assistant"]), f"{r.choice(['a', 'b'])} {r.randint(0, 500)}{r.choice(['.', ''])}")
            for c, n in ((1, 1500), (2, 256), (3, 257)) for t in range(n)]
    check(spark.createDataFrame(long, SCHEMA).repartition(4), long, brute=walked)


def test_repair_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", None), (1, None, "user", "x."), (1, 1, None, "y."),
            (2, 5, "user", "same."), (2, 5, "user", "same."), (2, 5, "assistant", "same."), (3, 1, "", "b."), (4, 3, "system", "only."),
            (5, -2, "user", "w" * 100_000), (5, 9, "assistant", "ok.")]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df, rows)
    check(df, rows, damage=False)
    assert repair.repair(df.limit(0)).count() == 0
    dropped = [(c, 0, "user", "a.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repair.repair(spark.createDataFrame(dropped, SCHEMA)).collect()
    assert len(got) == len(dropped) and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_rules_change_nothing_and_pairs_are_replaced_from_the_left():
    s = np.array([1, 1, 1, 2, 1, 1, 2, 2], np.uint16)
    assert repair._replace(s, 1, 1, 9).tolist() == [9, 1, 2, 9, 2, 2]
    assert repair._replace(s, 1, 2, 9).tolist() == [1, 1, 9, 1, 9, 2]
    m = repair.rule_matrices([(3, 5), (9, 9)])
    direct = repair.product(repair.product(repair.product(m[3], m[5]), m[3]), m[5])
    plain = lambda x: [[e and (e[0], str(e[1])) for e in row] for row in x]
    assert plain(m[10]) == plain(direct)


# ------------------------------------------------------------------ pipeline and helpers

CLASHING = ("_copy_id", "_copy_th", "_copy_stays", "_copy_rows", "_contaminated_id", "_contaminated_th", "mix_domain", "mix_epoch",
            "mix_tokens", "mix_budget", "_own0", "_own1", "domain", "n_tokens", "id", "th", "rid", "score", "key", "bin")


def words_of_text(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def brute_kept(rows):
    """Rows left by the near-duplicate stage: all pairs of 5-word sets, linked at 0.8."""
    sets = []
    for _, t in rows:
        w = words_of_text(t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append((r[0] is None, r[0] or 0))
    return sorted(min(g) for g in groups.values())


def brute_clean(rows, items):
    """Rows left by decontamination: no window of ten words of an item."""
    windows = set()
    for t in items:
        w = words_of_text(t)
        windows |= {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(x) for x in windows}
    clean = []
    for i, t in rows:
        w = words_of_text(t)
        if not any(tuple(w[s:s + n]) in windows for n in sizes for s in range(len(w) - n + 1)):
            clean.append((i is None, i or 0))
    return sorted(clean)


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_stages_equal_brute_force_and_keep_clashing_columns(spark, tables, odd_docs):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    items = [r.text for r in tables["benchmark"].select("text").collect()]
    for docs in (tables["documents"].withColumns({c: F.lit(f"own {c}") for c in CLASHING}),
                 odd_docs[0].select("doc_id", "text", "lang", "source").withColumns({c: F.lit(f"own {c}") for c in CLASHING})):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        one = cp.quality_classifier(spark, docs, sf)
        assert one.columns == docs.columns and set(ids(one)) <= set(ids(docs))
        two = cp.ngram_jaccard_join(spark, docs, sf)
        three = cp.benchmark_decontamination(spark, docs, sf)
        four = cp.secret_scan(spark, docs, sf)
        five = cp.source_mixing(spark, docs, sf)
        assert ids(two) == brute_kept(rows) and ids(three) == brute_clean(rows, items) and ids(four) == ids(docs)
        assert five.columns == [*docs.columns, "mix_domain_", "mix_epoch_", "mix_tokens_", "mix_budget_"]
        for out in (one, two, three, four, five):
            assert out.select(*CLASHING).distinct().collect() in ([], [tuple(f"own {c}" for c in CLASHING)])


def test_mixing_stage_equals_sql(spark, tables, tmp_path):
    import duckdb

    import corpus_pipeline as cp
    from precis.llm import oracle

    docs = tables["documents"].where("doc_id % 3 <> 1")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.sql(oracle.MIXING).fetchall()
    names = con.sql(oracle.MIXING).columns
    got = cp.source_mixing(spark, docs, "").select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source",
                                                   F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"),
                                                   F.col("mix_budget").alias("budget"))
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want))


def test_bit_filter_is_that_of_all_values(spark):
    from precis.llm.common import bit_filter, in_filter

    v = np.random.default_rng(7).integers(-2**63, 2**63, 5000)
    bits = bit_filter(spark.createDataFrame([(int(x),) for x in v], "h long").repartition(5), "h")
    assert len(bits) == 1 << 21 and in_filter(bits, v.view(np.uint64)).all()
    assert in_filter(bits, np.random.default_rng(8).integers(-2**63, 2**63, 50_000).view(np.uint64)).mean() < 0.001
    assert not bit_filter(spark.createDataFrame([], "h long"), "h").any()


def test_tokenizers_that_keep_spaces_are_refused(tables):
    import public_tokenizers

    from precis.llm import token_count

    with pytest.raises(ValueError, match="white space"):
        token_count.count_tokens(tables["documents"], public_tokenizers.path("byte_bpe_50k.json"))
