"""op4, op5, op6, op8 and the pipeline, against brute force, held-out labels and round trips."""

import binascii
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from precis.llm import chat, mixing, quality, warc

from .conftest import SF


def split_budget(total, children, weights):
    """Water filling in whole numbers, straight from the definition."""
    open_, given, left = {c: weights.get(c, 1) for c in children if children[c] > 0 and weights.get(c, 1)}, {}, total
    while open_:
        w = sum(open_.values())
        full = [c for c in open_ if children[c] * w <= left * open_[c]]
        if not full:
            given |= {c: left * x // w for c, x in open_.items()}
            break
        for c in full:
            given[c] = children[c]
        left -= sum(children[c] for c in full)
        for c in full:
            del open_[c]
    return given


def test_budgets_go_to_siblings_before_ancestors(spark):
    tokens = {("web", "en", "src1"): 50, ("web", "en", "src2"): 400, ("web", "fr", "src1"): 1000, ("books", "en", "src11"): 100,
              ("books", None, "src12"): 7, ("other", "de", None): 0}
    leaves = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "domain string, lang string, source string, tokens long")
    weights = {"domain": {"web": 3, "books": 1}, "lang": {"en": 4, "fr": 1}}
    for total in (0, 90, 700, 1200, 10_000):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, F.lit(total), weights, 1).collect() if r.budget}
        want = {}
        supply = lambda pre: sum(v for k, v in tokens.items() if k[:len(pre)] == pre)
        below = lambda pre: {k[len(pre)]: supply((*pre, k[len(pre)])) for k in tokens if k[:len(pre)] == pre}
        for d, b in split_budget(min(total, supply(())), below(()), weights["domain"]).items():
            for la, b2 in split_budget(b, below((d,)), weights["lang"]).items():
                for s, b3 in split_budget(b2, below((d, la)), {}).items():
                    want[d, la, s] = b3
        assert got == {k: v for k, v in want.items() if v}


def test_mix_takes_prefixes_of_seeded_epochs(tables, odd_docs):
    docs = tables["documents"]
    got = mixing.mix(docs, mixing.WEIGHTS, 1.2, 3).collect()
    size = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    leaves = defaultdict(list)
    for r in got:
        leaves[r.domain, r.lang, r.source].append(r)
    own = Counter((r.lang, r.source) for r in docs.collect())
    for (_, lang, source), rows in leaves.items():
        times = Counter(r.doc_id for r in rows)
        assert sum(size[i] * n for i, n in times.items()) <= rows[0].budget
        whole = min(times.values()) if len(times) == own[lang, source] else 0
        assert set(times.values()) <= {whole, whole + 1} or whole == 0 and set(times.values()) == {1}
    assert sum(r.n_tokens for r in got) >= 0.8 * sum({k: v[0].budget for k, v in leaves.items()}.values())
    df, odd = odd_docs
    both = mixing.mix(df, {}, 1.0, 1).collect()  # the whole corpus once
    assert len(both) == sum(1 for r in odd if r[1] and r[1].strip()) and all(r.epoch == 1 for r in both)
    assert mixing.mix(df.limit(0), {}).count() == 0
    assert mixing.mix(df, {}, 1.0, 1, with_columns=True).count() == len(both)


def test_quality_learns_from_training_rows_only(spark, tables, odd_docs):
    from precis.llm.common import read

    docs, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert quality.train(docs, labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality"))
                                                 .otherwise(F.col("quality")))) == model
    rows = quality.score(docs, model).collect()
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) >= 0.95 * len(test)
    keep = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert keep == {r.doc_id for r in rows if r.predicted}
    df, odd = odd_docs
    assert quality.score(df, model).count() == len(odd) and quality.keep_good(df, model).columns == df.columns
    assert quality.score(df.limit(0), model).count() == 0
    none = quality.train(df, labels.limit(0))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}


def test_chat_keeps_maximal_conversations(spark, tables):
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes?"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes?"), (2, 2, "user", "go"),
         (3, 0, "user", "hi"), (3, 1, "assistant", "no?"), (4, 5, "user", "hi"), (4, 9, "assistant", "no?"), (5, None, "user", None),
         (5, 0, None, "x<|im_end|>"), (None, 0, "user", "alone"), (6, 0, "user", "hi"), (7, 0, "user", "twice"), (7, 0, "user", "twice"),
         (8, 0, "user", "twice")]
    r += [(9, k, "user", f"t{k}") for k in range(600)] + [(10, k, "user", f"t{k}") for k in range(599)] + [(11, k + 1, "user", f"t{k}") for k in range(600)]
    df = spark.createDataFrame(r, "conv_id long, turn long, role string, text string").withColumns({"ck": F.lit(1), "pos": F.lit(2)})
    got = chat.render(df).collect()
    assert sorted({str(x.conv_id) for x in got}) == ["2", "3", "5", "7", "9", "None"]
    by = defaultdict(str)
    for x in sorted(got, key=lambda x: x.part):
        by[x.conv_id] += x.text
    turn = "<|im_start|>{}\n{}<|im_end|>\n".format
    assert by[2] == turn("user", "hi") + turn("assistant", "yes?") + turn("user", "go")
    assert by[5] == turn("user", "") + turn("", "x<|im_end |>") and by[None] == turn("user", "alone")
    assert by[9] == "".join(turn("user", f"t{k}") for k in range(600)) and {x.part for x in got if x.conv_id == 9} == {0, 1, 2}
    assert {x.conv_id: (x.n_turns, x.n_same) for x in got if x.conv_id in (3, 7, 9)} == {3: (2, 2), 7: (2, 1), 9: (600, 2)}
    assert chat.render(df.limit(0)).count() == 0
    convs = defaultdict(list)
    for x in tables["conversations"].orderBy("conv_id", "turn").collect():
        convs[x.conv_id].append((x.role, x.text))
    inner = {tuple(v[:k]) for v in convs.values() for k in range(1, len(v))}
    want = {}
    for k in sorted(convs):
        if tuple(convs[k]) not in inner:
            want.setdefault(tuple(convs[k]), k)
    got = {x.conv_id: x.text for x in chat.render(tables["conversations"]).collect()}
    assert got == {k: "".join(turn(*t) for t in v) for v, k in want.items()}


def test_chat_cuts_null_ids_and_equal_turns_by_position(spark):
    rows = [(None, k % 3, "user", f"n{k}") for k in range(1500)] + [(1, None, "user", f"z{k}") for k in range(700)]
    rows += [(2, 4, "user", f"e{k}") for k in range(600)] + [(3, 4, "user", "same")] * 600 + [(4, 0, "user", "one")]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    texts, size = defaultdict(str), Counter()
    for x in sorted(got, key=lambda x: x.part):
        n = x.text.count("<|im_start|>")
        assert n <= 256 and x.n_turns == {None: 1500, 1: 700, 2: 600, 3: 600, 4: 1}[x.conv_id]
        texts[x.conv_id] += x.text
        size[x.conv_id] += 1
    assert size == {None: 6, 1: 3, 2: 3, 3: 3, 4: 1}
    line = lambda t: f"<|im_start|>user\n{t}<|im_end|>\n"
    for conv in texts:
        assert Counter(texts[conv].splitlines(True)) == Counter("".join(line(t) for c, _, _, t in rows if c == conv).splitlines(True))
    turns = [int(t[1:].split("<")[0]) % 3 for t in texts[None].splitlines() if t.startswith("n")]
    assert turns == sorted(turns)


def test_warc_round_trip(spark, tables):
    evil = ("x" * 3000 + "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
            "WARC/1.0\r\njunk" + "y" * 4000 + "WARC/1.0\r\n")
    rows = [(1, "u 1", "same"), (2, None, "same"), (3, "u", "same"), (4, "u", ""), (5, "u", None), (None, "u", "same"), (None, "u", "solo")]
    rows += [(10 + i, "u", evil + f"{i}é\r\n\r\nWARC/1.0\r\n") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(2).withColumns({"n": F.lit(1), "kind": F.lit("k")})
    want = Counter()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for i, _, h in rows:
        b = (h or "").encode()
        top = last[h or ""]
        first = top == (-1 if i is None else i)
        want[i, len(b), warc.payload_digest(b), "response" if first else "revisit", None if first else top] += 1
    conf = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}  # records and payloads cross splits
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert Counter(tuple(r) for r in warc.round_trip(df).collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert warc.round_trip(df.limit(0)).count() == 0
    pages = tables["pages"]
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(pages).collect()}
    assert got == {i: (len(b), warc.payload_digest(b)) for i, b in html.items()}


def test_warc_rejects_a_changed_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "payload one"), (2, "u", "payload two")], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    text = spark.read.text(path, wholetext=True).first()[0].replace("payload one", "payload 0ne")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(text.encode())
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, str(tmp_path / "bad")).collect()


def test_pipeline_stages(spark, tables):
    import corpus_pipeline as cp
    from precis.llm import decontaminate, near_dup, secrets
    from precis.llm.common import materialise

    docs = tables["documents"]
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans",
                                               "mixing sources"]
    model = quality.train(docs, tables["labels"])
    one = materialise(cp.quality_classifier(spark, docs, SF), "test")
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    two = materialise(cp.ngram_jaccard_join(spark, one, SF), "test")
    assert sorted(r.doc_id for r in two.collect()) == sorted({r.group_id for r in near_dup.jaccard_join(one).collect()})
    three = materialise(cp.benchmark_decontamination(spark, two, SF), "test")
    bad = {r.doc_id for r in decontaminate.contamination(two, tables["benchmark"]).where("contaminated").collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - bad
    four = materialise(cp.secret_scan(spark, three, SF), "test")
    assert four.count() == three.count() and secrets.scan(four).where("n_assign + n_access + n_hex > 0").count() == 0
    assert four.where("n_chars <> length(text)").count() == 0
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    five = cp.source_mixing(spark, four, SF)
    assert five.columns[:5] == docs.columns and {r.doc_id for r in five.collect()} <= {r.doc_id for r in four.collect()}
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
