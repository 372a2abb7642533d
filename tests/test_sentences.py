"""Blocks of a text, the trained sentence splitter and the stemmer."""

from pyspark.sql import functions as F

from precis.functions.porter import porter_dictionary, porter_stem
from precis.functions.text import split_sentences
from precis.operators import rank as R
from precis.operators import sentences as S

# Examples of the published algorithm, and of its common implementations.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail
filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun
activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil running run runs run easily easili fairly fairli flies fli
dies di mules mule denied deni died di owned own humbled humbl meeting meet stating state itemization item sensational sensat
traditional tradit reference refer colonizer colon plotted plot university univers universe univers computers comput
computing comput computation comput connected connect connecting connect connection connect connections connect abilities abil
argument argument arguing argu argue argu happiness happi national nation organization organ multiply multipli skies ski
hoping hope string string being be boxes box say sai enjoy enjoi toy toi by by is is as as a a x1ing x1ing don't don't""".split()


def test_stems_of_known_words(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2]))
    assert len(want) > 110
    df = spark.createDataFrame([(w,) for w in want], "word string")
    assert {r.word: r.stem for r in df.select("word", porter_stem(F.col("word")).alias("stem")).collect()} == want
    d = {r.word: r.norm for r in porter_dictionary(df.unionByName(df).unionByName(spark.createDataFrame([(None,)], "word string"))).collect()}
    assert d == {w: s for w, s in want.items() if w != s}


TEXT = """THE FIRST PART
It begins here. It goes
on in a second line! Is it?

And a second paragraph.
NOTES 2
After it.


2019
end"""


def test_headings_and_paragraphs(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "ONLY A HEADING"), (5, "a\r\n\r\nB c. D")], "doc_id long, text string")
    got = [tuple(r) for r in S.block_table(df).orderBy("doc_id", "i").collect()]
    assert got == [(1, 0, 0, True, "THE FIRST PART"), (1, 1, 0, False, "It begins here."), (1, 2, 0, False, "It goes on in a second line!"),
                   (1, 3, 0, False, "Is it?"), (1, 4, 1, False, "And a second paragraph."), (1, 5, 1, True, "NOTES 2"),
                   (1, 6, 1, False, "After it."), (1, 7, 2, False, "2019 end"), (4, 0, 0, True, "ONLY A HEADING"),
                   (5, 0, 0, False, "a"), (5, 1, 1, False, "B c."), (5, 2, 1, False, "D")]
    sents = S.block_table(df).where(~F.col("heading"))
    assert {(r.doc_id, r.i) for r in R.luhn_scores(sents).collect()} == {(d, i) for d, i, _, heading, _ in got if not heading}


def test_splitter_learns_abbreviations(spark):
    """Dr. and U.S. stand before a period wherever they occur; "house" and "ran" do not."""
    rows = []
    for k in range(40):
        rows.append((k, f"We saw Dr. Miller{k} at one house. The U.S. team ran. Now go on with it early and late! The dog ran on. They left early. "
                        f"The U.S. team came from the U.S. The house ran. The men ran too. The dog met J. Smith there! But Dr. Jones ran"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.type: r.score for r in S.abbreviation_counts(df).collect()}
    assert found["dr"] > S.ABBREVIATION and found["u.s"] > S.ABBREVIATION and found["house"] < S.ABBREVIATION and found["ran"] < S.ABBREVIATION
    sp = S.Splitter.train(df)
    assert {"dr", "u.s"} <= {r.type for r in sp.abbreviations.collect()} and "the" in {r.type for r in sp.starters.collect()}
    new = spark.createDataFrame([(1, "A note by Dr. Who. It was J. Smith and the U.S. army. He lives in the U.S. The rest is Dr. Who. Fine! ok"),
                                 (2, None), (3, ""), (4, "one")], "doc_id long, text string")
    got = [(r.doc_id, r.sentence) for r in sp.sentences(new).orderBy("doc_id", "i").collect()]
    assert got == [(1, "A note by Dr. Who."), (1, "It was J. Smith and the U.S. army."), (1, "He lives in the U.S."), (1, "The rest is Dr. Who."),
                   (1, "Fine!"), (1, "ok"), (4, "one")]
    rule = new.select(F.explode(split_sentences("text"))).count()
    assert rule == len(got) + 4
    empty = S.Splitter.train(df.limit(0))
    assert empty.sentences(df).count() == df.select(F.explode(split_sentences("text"))).count() - len(rows)  # J. stays an initial


def test_token_types_are_taken_once_of_distinct_tokens(spark, monkeypatch):
    import precis.operators.sentences as module
    plans, cut = [], module.cut_lineage

    def seen(df, *args, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, *args, **kw)

    monkeypatch.setattr(module, "cut_lineage", seen)
    df = spark.createDataFrame([(1, "Dr. Oak met Mr. Elm. He said no! (Yes.) 3.5 a.b. ?! Dr. Oak"), (2, None)], "doc_id long, text string")
    got = {r["type"]: (r["with_period"], r["without"]) for r in module.abbreviation_counts(df).collect()}
    assert got == {"dr": (2, 0), "mr": (1, 0), "elm": (1, 0), "yes": (1, 0), "a.b": (1, 0)}
    below = plans[0][plans[0].index("Aggregate [t"):]
    assert "regexp_extract" not in below
