"""Fixed values.

These must equal the values the original pipelines used, so they are stated
plainly here, in their natural order, and nowhere else.
"""

# --- fixed values: contraction dictionary (117 entries, in match order) ---
CONTRACTIONS = {
    "ain't": "am not",
    "aren't": "are not",
    "can't": "cannot",
    "can't've": "cannot have",
    "'cause": "because",
    "could've": "could have",
    "couldn't": "could not",
    "couldn't've": "could not have",
    "didn't": "did not",
    "doesn't": "does not",
    "don't": "do not",
    "hadn't": "had not",
    "hadn't've": "had not have",
    "hasn't": "has not",
    "haven't": "have not",
    "he'd": "he would",
    "he'd've": "he would have",
    "he'll": "he will",
    "he'll've": "he will have",
    "he's": "he is",
    "how'd": "how did",
    "how'd'y": "how do you",
    "how'll": "how will",
    "how's": "how is",
    "I'd": "I would",
    "I'd've": "I would have",
    "I'll": "I will",
    "I'll've": "I will have",
    "I'm": "I am",
    "I've": "I have",
    "isn't": "is not",
    "it'd": "it would",
    "it'd've": "it would have",
    "it'll": "it will",
    "it'll've": "it will have",
    "it's": "it is",
    "let's": "let us",
    "ma'am": "madam",
    "mayn't": "may not",
    "might've": "might have",
    "mightn't": "might not",
    "mightn't've": "might not have",
    "must've": "must have",
    "mustn't": "must not",
    "mustn't've": "must not have",
    "needn't": "need not",
    "needn't've": "need not have",
    "o'clock": "of the clock",
    "oughtn't": "ought not",
    "oughtn't've": "ought not have",
    "shan't": "shall not",
    "sha'n't": "shall not",
    "shan't've": "shall not have",
    "she'd": "she would",
    "she'd've": "she would have",
    "she'll": "she will",
    "she'll've": "she will have",
    "she's": "she is",
    "should've": "should have",
    "shouldn't": "should not",
    "shouldn't've": "should not have",
    "so've": "so have",
    "so's": "so is",
    "that'd": "that would",
    "that'd've": "that would have",
    "that's": "that is",
    "there'd": "there would",
    "there'd've": "there would have",
    "there's": "there is",
    "they'd": "they would",
    "they'd've": "they would have",
    "they'll": "they will",
    "they'll've": "they will have",
    "they're": "they are",
    "they've": "they have",
    "to've": "to have",
    "wasn't": "was not",
    "we'd": "we would",
    "we'd've": "we would have",
    "we'll": "we will",
    "we'll've": "we will have",
    "we're": "we are",
    "we've": "we have",
    "weren't": "were not",
    "what'll": "what will",
    "what'll've": "what will have",
    "what're": "what are",
    "what's": "what is",
    "what've": "what have",
    "when's": "when is",
    "when've": "when have",
    "where'd": "where did",
    "where's": "where is",
    "where've": "where have",
    "who'll": "who will",
    "who'll've": "who will have",
    "who's": "who is",
    "who've": "who have",
    "why's": "why is",
    "why've": "why have",
    "will've": "will have",
    "won't": "will not",
    "won't've": "will not have",
    "would've": "would have",
    "wouldn't": "would not",
    "wouldn't've": "would not have",
    "y'all": "you all",
    "y'all'd": "you all would",
    "y'all'd've": "you all would have",
    "y'all're": "you all are",
    "y'all've": "you all have",
    "you'd": "you would",
    "you'd've": "you would have",
    "you'll": "you will",
    "you'll've": "you will have",
    "you're": "you are",
    "you've": "you have",
}

# --- fixed values: English stop words (179 entries, public NLTK list order) ---
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't "
    "didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't "
    "wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# --- fixed values: ASCII punctuation, in code-point order ---
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- fixed values: e-mail pattern ---
# The original class ``[.-_]`` is the code-point range '.'..'_'.  This form
# accepts the same strings without nested quantifiers over overlapping
# classes (which made the original exponential on long runs of capitals).
EMAIL_PATTERN = (
    r"[A-Za-z0-9]+(?:[./:;<=>?@\[\\\]^_][A-Za-z0-9]+)*"
    r"@[A-Za-z0-9-]+(?:\.[A-Z|a-z]{2,})+"
)
# The same matches for a backtracking engine, in linear time and constant
# stack: every repeated group takes one character; an address begins where a
# run of its characters begins, or where the last match ended.
_SEPARATORS = r"./:;<=>?@\[\\\]^_"
EMAIL_PATTERN_LINEAR = (
    rf"(?:\G|(?<=\G[{_SEPARATORS}])|(?<![A-Za-z0-9])(?<![A-Za-z0-9][{_SEPARATORS}]))"
    rf"[A-Za-z0-9](?:[A-Za-z0-9{_SEPARATORS}](?<![{_SEPARATORS}][{_SEPARATORS}]))*(?<=[A-Za-z0-9])"
    r"@[A-Za-z0-9-]+\.[A-Z|a-z]{2}(?:(?!\.(?![A-Z|a-z]{2}))[A-Z|a-z.])*"
)
EMAIL_TOKEN = "EMAIL"

# --- fixed values: noun plural detachment rules (suffix, replacement) ---
NOUN_PLURAL_RULES = (
    ("s", ""),
    ("ses", "s"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)

# --- fixed values: ranker and metric constants ---
TEXTRANK_DAMPING = 0.85
TEXTRANK_EPSILON = 1e-4
ROW_NORM_EPS = 1e-7
LEXRANK_THRESHOLD = 0.1
LEXRANK_EPSILON = 0.1
LSA_SMOOTH = 0.4
LUHN_MAX_GAP = 4
PAGERANK_ALPHA = 0.85
PAGERANK_TOL = 1e-6
PAGERANK_MAX_ITER = 100
VECTOR_DIVISOR_EPS = 0.001

# Model names as reported in result grids.
MODEL_NAMES = ("TextRank", "LexRank", "Lsa", "Luhn", "KL", "MyTextRank")
METRIC_NAMES = (
    "BLEU-1", "BLEU-2", "BLEU-3", "BLEU-4",
    "ROUGE-1-fmeasure", "ROUGE-2-fmeasure", "ROUGE-L-fmeasure",
    "ROUGE-1-recall", "ROUGE-2-recall", "ROUGE-L-recall",
)
