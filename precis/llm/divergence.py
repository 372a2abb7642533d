"""Quality rules with DataFrame functions only: repetition counts, and the
distance of character-class and common-word histograms from the language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import ASCII_SPACE, broadcast_if_small, let, materialise, stage

#: Very common words of each language.
COMMON_WORDS = {
    "en": "the of and to in is it that with for as was on are by be this from or an a at not he".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur plus au avec ce il pas son".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an für wie".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
_WORDS = 24
_ANY_COMMON = sorted({word for words in COMMON_WORDS.values() for word in words})
#: Character classes: upper-case letters, digits, punctuation and symbols of the
#: byte range by pattern; spaces and all other characters (mostly letters) follow.
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "point": r"[!\"'(),.:;?-]", "symbol": r"[#*$%&|<>]"}

#: Largest Jensen-Shannon distances (0 to 1) and least lengths for the verdict.
CLASS_LIMIT, CLASS_MIN_CHARS = 0.27, 200
WORD_LIMIT, WORD_MIN_WORDS = 0.42, 50

_SPACES = "[" + "".join(f"\\x{ord(c):02x}" for c in ASCII_SPACE) + "]+"


def _repeated(words: str) -> Column:
    """Words inside 5-word windows that are found twice or more in the text."""
    w = F.col(words)
    n = F.size(w)
    hashes = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(
        *(F.get(w, i + j) for j in range(5))))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                                   | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        places = lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"]))
        steps = lambda p: F.aggregate(
            p, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct((i + 5).alias("end"), (a["n"] + (i + 5 - F.greatest(a["end"], i))).alias("n")),
            lambda a: a["n"])
        return let(placed, lambda s: let(places(s), steps))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def _word_list(lang: str) -> Column:
    lists = F.lit(None).cast("array<string>")
    for k, words in COMMON_WORDS.items():
        lists = F.when(F.col(lang) == k, F.array(*map(F.lit, words))).otherwise(lists)
    return lists


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    classes, commons): the base counts and the two histograms of every row."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spaces, t = F.lit(ASCII_SPACE), F.col("text")
    df = stage(df, words=let(F.trim(t, spaces), lambda x: F.when(x == "", F.array().cast("array<string>"))
                             .otherwise(F.split(x, _SPACES))),
               lines=F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{_SPACES[1:-2]}]")))
    w = F.col("words")
    counts = {c: F.size(F.split(t, p, -1)) - 1 for c, p in CLASSES.items()}
    # one pass finds the words of any list; the 24 passes of a list go over those alone
    commons = F.when(F.col("lang").isin(*COMMON_WORDS), let(F.filter(w, lambda x: x.isin(_ANY_COMMON)), lambda few: F.transform(
        _word_list("lang"), lambda c: (F.size(few) - F.size(F.array_remove(few, c))).cast("long"))))
    df = stage(
        df, n_chars=F.length(t).cast("long"), n_words=F.size(w).cast("long"),
        word_chars=F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        n_symbols=counts["symbol"].cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=_repeated("words"), upper=counts["upper"], digit=counts["digit"], point=counts["point"], commons=commons)
    classes = [F.col(c).cast("long") for c in ("upper", "digit", "point", "n_symbols")] + [F.col("n_chars") - F.col("word_chars")]
    others = F.col("n_chars") - sum(classes[1:], classes[0])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.select("id", "lang", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     failed.alias("base_failed"), F.array(*classes, others).alias("classes"),
                     F.when(F.col("commons").isNotNull(), F.concat("commons", F.array(
                         F.col("n_words") - F.aggregate("commons", F.lit(0).cast("long"), lambda a, x: a + x))))
                     .alias("commons"))


def references(measured: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_commons): of each language the shares of the bins,
    summed over all its documents that do not fail the base rules."""
    sums = lambda c, n: [F.sum(F.get(c, F.lit(i))).cast("double").alias(f"{c}{i}") for i in range(n)]
    share = lambda c, n: F.transform(F.array(*(F.coalesce(F.col(f"{c}{i}"), F.lit(0.0)) for i in range(n))),
                                     lambda x: x / F.greatest(F.lit(1.0), sum(
                                         (F.coalesce(F.col(f"{c}{i}"), F.lit(0.0)) for i in range(n)), F.lit(0.0))))
    return (measured.where("not base_failed").groupBy("lang").agg(*sums("classes", 6), *sums("commons", _WORDS + 1))
            .select("lang", share("classes", 6).alias("ref_classes"), share("commons", _WORDS + 1).alias("ref_commons")))


def js_distance(counts: Column, total: Column, ref: Column) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) of counts from reference shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    pairs = F.zip_with(counts, ref, lambda c, q: F.struct((c / total).alias("p"), q.alias("q")))
    js = F.aggregate(pairs, F.lit(0.0).cast("double"), lambda a, x: a + part(x["p"], (x["p"] + x["q"]) / 2)
                     + part(x["q"], (x["p"] + x["q"]) / 2)) / 2
    return F.sqrt(F.greatest(js, F.lit(0.0)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance, word_distance) of every row.

    A language's reference is what all its documents (without those that fail
    the base rules) hold together.  A document is kept if it does not fail the
    base rules and neither histogram is further from its language's than the
    limit; texts under the least length are not held against a histogram, nor
    documents of a language without a list of common words against the second.

    Null and empty texts have no words and fail the base rules.  A null
    language is one language of its own.  Null ids stay null; repeated rows give
    repeated results; other columns are not read.
    """
    measured = materialise(measures(docs, id_col, text_col, lang_col), "measures")
    refs = broadcast_if_small(references(measured), 10_000)
    rows = measured.join(refs, "lang", "left")
    chars, words = F.col("n_chars").cast("double"), F.col("n_words").cast("double")
    rows = stage(rows, class_distance=F.when(
        (F.col("n_chars") >= CLASS_MIN_CHARS) & F.col("ref_classes").isNotNull(),
        js_distance(F.col("classes"), chars, F.col("ref_classes"))), word_distance=F.when(
        (F.col("n_words") >= WORD_MIN_WORDS) & F.col("commons").isNotNull() & F.col("ref_commons").isNotNull(),
        js_distance(F.col("commons"), words, F.col("ref_commons"))))
    near = lambda c, limit: F.coalesce(F.round(c, 9) <= limit, F.lit(True))
    kept = ~F.col("base_failed") & near(F.col("class_distance"), CLASS_LIMIT) & near(F.col("word_distance"), WORD_LIMIT)
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", kept.alias("kept"), F.round("class_distance", 6).alias("class_distance"),
                       F.round("word_distance", 6).alias("word_distance"))
