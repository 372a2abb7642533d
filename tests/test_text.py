"""Literal fixtures for the text functions and cleaning presets (F-CLEAN,
F-CONTR) and the pipeline contract."""

from pyspark.sql import functions as F

from precis.functions import cleaning as C
from precis.functions import text as T

SMOKE = ("Well, I'm Robin, I ain't late. I'm walking to town. robin.b@mail.org; "
         "walk walks walking walked, 45, 45th")


def one(spark, col, value=SMOKE):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first()["x"]


def test_clean_chain(spark):
    a = T.mask_emails(T.expand_contractions("t"))
    assert one(spark, a) == ("Well, I am Robin, I am not late. I am walking to town. EMAIL; "
                             "walk walks walking walked, 45, 45th")
    b = T.remove_symbols(a)
    assert one(spark, b) == "Well I am Robin I am not late I am walking to town EMAIL walk walks walking walked 45 45th"
    c = T.remove_words(b, ["I", "late"])
    assert one(spark, c) == "Well am Robin am not am walking to town EMAIL walk walks walking walked 45 45th"
    d = T.remove_by_regex(c, [T.DIGIT])
    assert one(spark, d) == "Well am Robin am not am walking to town EMAIL walk walks walking walked  th"


def test_dictionary_step(spark):
    df = spark.createDataFrame([(1, "Well am Robin am not am walking to town EMAIL walk walks walking walked  th")],
                               "doc_id long, text string")
    d = spark.createDataFrame([("walks", "walk")], "word string, norm string")
    out = C.normalize_words(df, ["text"], ["doc_id"], d).first()["text"]
    assert out == "Well am Robin am not am walking to town EMAIL walk walk walking walked th"


def test_equal_ids_stay_apart(spark):
    from precis.operators.encode import build_vocabulary, decode, encode
    rows = [("train", 0, "cats cat sat", "x"), ("test", 0, "dogs dog ran", "y"), ("val", None, None, "z"), ("val", 5, "", "w")]
    df = spark.createDataFrame(rows, "split string, doc_id long, text string, other string")
    for preset in (C.strong(), C.embedding()):
        got = {(r["split"], r["doc_id"], r["other"]): r["text"] for r in preset.transform(df, "text").collect()}
        assert got == {("train", 0, "x"): "cat cat sat", ("test", 0, "y"): "dog dog ran", ("val", None, "z"): None, ("val", 5, "w"): ""}
    stop = spark.createDataFrame([("cat",)], "word string")
    assert sorted(r["text"] for r in C.remove_words_by_table(df.where("split <> 'val'"), "text", ["doc_id"], stop).collect()) == [
        "cats sat", "dogs dog ran"]
    vocab = build_vocabulary(df, "text")
    enc = encode(df, "text", vocab, lower=True)
    assert enc.count() == 4
    back = {(r["split"], r["doc_id"]): r["text"] for r in decode(enc, "text", vocab, ["split", "doc_id"]).collect()}
    assert back == {("train", 0): "cats cat sat", ("test", 0): "dogs dog ran", ("val", None): None, ("val", 5): ""}


def test_load_corpus(spark, tmp_path):
    import pytest
    from precis.sources.corpus import load_corpus, read_split, write_dataset
    df = spark.createDataFrame([("a", "s"), ("b", "t")], "article string, highlights string")
    paths = {s: str(tmp_path / s) for s in ("train", "test")}
    for p in paths.values():
        df.write.parquet(p)
    got = load_corpus(spark, paths, "article", "highlights")
    assert got.columns == ["split", "doc_id", "document", "summary"]
    assert got.select("doc_id").distinct().count() == 4
    with pytest.raises(ValueError):
        load_corpus(spark, paths["train"], "article", "highlights")
    write_dataset(got.where("document = 'a'"), str(tmp_path / "json"), "json")
    assert read_split(spark, str(tmp_path / "json"), "test", fmt="json").first()["summary"] == "s"


def test_email_masking_equals_the_pattern_in_linear_time(spark):
    import random
    import re
    from precis.functions.fixed import EMAIL_PATTERN
    rng = random.Random(5)
    texts = ["".join(rng.choices("aB1.@-/|_ ", weights=[6, 3, 3, 4, 5, 2, 2, 2, 2, 1], k=rng.randint(1, 60))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["m"] for r in df.select("i", T.mask_emails("t").alias("m")).orderBy("i").collect()]
    assert got == [re.sub(EMAIL_PATTERN, "EMAIL", t) for t in texts]
    for long in ("a." * 500_000, "a" * 1_000_000, "a@" * 300_000):
        assert spark.createDataFrame([(long,)], "t string").select(F.length(T.mask_emails("t"))).first()[0] == len(long)


def test_custom_contractions_and_word_counter(spark):
    assert one(spark, T.expand_contractions("t", {"gonna": "going to", "y'all": "you all"}), "y'all gonna go") == "you all going to go"
    p = C.Pipeline("mine").add(T.to_lower).add(lambda c: T.replace_by_regex(c, [("o+", "0")]))
    df = spark.createDataFrame([(1, "Foo bOo")], "doc_id long, text string")
    assert p.transform(df, "text").select("text", F.size(T.whitespace_tokens("text")).alias("n")).first()[:] == ("f0 b0", 2)


def test_contractions_first_listed(spark):
    assert one(spark, T.expand_contractions("t"), "she's") == "she is"
    assert one(spark, T.expand_contractions("t"), "can't've") == "cannot've"
    assert one(spark, T.expand_contractions("t"), "Brit's") == "Brit is"
    assert one(spark, T.expand_contractions("t"), "i'm") == "i'm"
    assert one(spark, T.expand_contractions("t"), "I'm") == "I am"
    assert one(spark, T.expand_contractions("t"), "'cause it") == "because it"


def test_plural_lemma_dictionary(spark):
    words = spark.createDataFrame([(w,) for w in ["cats", "cat", "buses", "bus", "boxes", "box", "women", "ponies", "pony"]],
                                  "word string")
    d = {r["word"]: r["norm"] for r in C.plural_lemma_dictionary(words).collect()}
    assert d == {"cats": "cat", "buses": "bus", "boxes": "box", "ponies": "pony"}


def test_sentences_and_tokens(spark):
    df = spark.createDataFrame([("One. Two!  Three? four",)], "t string")
    r = df.select(T.split_sentences("t").alias("s"), T.whitespace_tokens("t").alias("w"),
                  T.naive_word_count("t").alias("n")).first()
    assert r["s"] == ["One.", "Two!", "Three?", "four"]
    assert r["w"] == ["One.", "Two!", "Three?", "four"]
    assert r["n"] == 4  # spaces, including the double one


def test_empty_and_blank(spark):
    for v in ["", "   "]:
        assert one(spark, T.remove_words("t", ["a"]), v) == ""
        assert one(spark, F.size(T.whitespace_tokens("t")), v) == 0


def test_ngrams_short(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    r = df.select(T.ngrams("t", 2).alias("b"), T.ngrams("t", 4).alias("q")).first()
    assert r["b"] == ["a b", "b c"] and r["q"] == []


def test_pipeline_is_one_projection(spark):
    df = spark.createDataFrame([(1, "A b. C")], "doc_id long, text string")
    out = C.mid().transform(df, "text")
    assert out.first()["text"] == "a b. c"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_anti_join_removal_equals_literal_set(spark):
    rows = [(1, "the cat and the dog"), (2, "the the"), (3, ""), (4, "  a  cat  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame([("the",), ("a",)], "word string")
    got = {r["doc_id"]: r["text"] for r in C.remove_words_by_table(df, ["text"], ["doc_id"], words).collect()}
    want = {r["doc_id"]: r["x"] for r in df.select("doc_id", T.remove_words("text", ["the", "a"]).alias("x")).collect()}
    assert got == want


def test_global_index_is_dense_and_ordered(spark):
    from precis.operators.encode import global_index
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    out = global_index(df, [F.asc("k")], "idx", partitions=5).collect()
    assert sorted((r["idx"], r["k"]) for r in out) == [(i, i) for i in range(1000)]


def test_global_index_without_exchange_reuse(spark):
    from precis.operators.encode import global_index
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        out = global_index(spark.range(0, 300_000).select(F.xxhash64("id").alias("k")), [F.asc("k")], "idx", partitions=7)
        assert out.agg(F.countDistinct("idx"), F.min("idx"), F.max("idx")).first()[:] == (300_000, 0, 299_999)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_checkpoint_folder_and_scan_partitions(spark, tmp_path):
    import pytest
    from precis import session

    class Elsewhere:  # a session on a cluster without the setting
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Elsewhere)
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert session.table(spark, str(tmp_path), "t", spread=0).rdd.getNumPartitions() == 1
    assert session.table(spark, str(tmp_path), "t", spread=3).rdd.getNumPartitions() == 3
    import os
    a = session.cut_lineage(spark.range(3), "test")
    b = session.cut_lineage(a.where("id > 0"), "test", a)
    assert not os.path.exists(a._cut_path.removeprefix("file:")) and b.count() == 2


def test_words_are_replaced_by_blocks(spark):
    from precis.functions.regroup import GOES, STAYS, replace_words
    rows = [(k % 3, None if k % 7 == 0 else " ".join(f"w{(k * j) % 11}" for j in range(k % 9)), k) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    pairs = [("w1", "x"), ("w2", "z"), ("w2", "y"), ("w3", None), (None, "n")]  # several values in order; a null one is none
    table = spark.createDataFrame(pairs, "word string, value string")
    gives = {"w1": ["x"], "w2": ["y", "z"], "w3": []}
    for unknown, other in ((STAYS, lambda w: [w]), (GOES, lambda w: []), ("?", lambda w: ["?"])):
        got = replace_words(df, {"text": T.whitespace_tokens("text")}, table, unknown, block_chars=300)
        want = sorted(((d, None if t is None else " ".join(v for w in t.split() for v in gives.get(w, other(w))), k) for d, t, k in rows), key=lambda r: r[2])
        assert got.columns == df.columns and sorted((tuple(r) for r in got.collect()), key=lambda r: r[2]) == want


def test_dictionary_step_shuffles_no_row_per_word(spark):
    df = spark.createDataFrame([(k, "cats dogs a b " * 500) for k in range(40)], "doc_id long, text string")
    out = C.normalize_words(df, ["text"], ["doc_id"])
    assert {r["text"] for r in out.collect()} == {" ".join(["cats dogs a b"] * 500)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_rid" not in plan and "MapInArrow" in plan and "collect_list" not in plan


def test_stemmer_runs_after_words_are_distinct(spark):
    from precis.functions.porter import porter_dictionary
    words = spark.createDataFrame([("relational",), ("relational",), ("cat",), (None,)], "word string")
    d = porter_dictionary(words)
    assert [tuple(r) for r in d.collect()] == [("relational", "relat")]
    both = words.join(d, "word")
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [word"):] + plan[:plan.index("Aggregate [word")].split("Generate")[0]
    assert "transform(" not in below
