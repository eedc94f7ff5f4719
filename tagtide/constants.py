"""Fixed values that results depend on, and the defaults of the operators."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# They must equal these texts for results to match.
# ---------------------------------------------------------------------------

PUNCTUATION = "!\"$%&'()*,-./:;<=>?@[\\]^_`{|}~‘’–…"

CODE_OPEN = "&lt;code&gt;"
CODE_CLOSE = "&lt;/code&gt;"
# A code snippet is dropped unless it is below both limits.
CODE_MIN_TOKENS = 3
CODE_MIN_CHARS = 20

STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am im
    i'm hes shes is isn't isnt are aren't arent was wasn't wasnt were weren't werent be been being have
    haven't havent has hasn't hasnt had hadn't hadnt having do don't don dont does doesn't doesnt doesn did
    didn't didnt didn doing a an the and but if or because as until while of at by for with without about
    against between into through during before after above below to from up down in out on off over under
    again then once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can cant must should shouldnt mustnt will won't wont won just now
    however though although ve m guy dude
    """.split()
)

ARCHIVE_ROOT = "https://web.archive.org/"
JOB_FEED_URL = "http://stackoverflow.com/jobs/feed"

# n of the n-th question, advert and course in the adoption sequences.
NTH_QUESTION = 5
NTH_AD = 5
NTH_COURSE = 5

# Labels of the full and of the short adoption sequence; equal dates keep this order.
FULL_LABELS = ("SQ1", "SQ5", "A1", "C1", "A5", "C5", "SV", "GT")
SHORT_LABELS = ("SQ", "A", "C", "SV", "GT")

# Delay columns: <from>_<to>.
DELAY_PAIRS = (
    ("SQ1", "SQ5"),
    ("SQ5", "C1"),
    ("SQ5", "A1"),
    ("SQ1", "SV"),
    ("SQ1", "C1"),
    ("SQ1", "A1"),
    ("A1", "A5"),
    ("C1", "C5"),
    ("SV", "A1"),
    ("GT", "A1"),
    ("SV", "C1"),
    ("GT", "C1"),
    ("C1", "A1"),
    ("GT", "SQ1"),
)

COHORT_CUTOFFS = {
    "after_warmup": "2016-10-01",
    "one_year_before": "2015-10-01",
    "two_years_before": "2014-10-01",
    "half_year_after": "2017-04-01",
    "one_year_after": "2017-10-01",
}

TOPIC_RECODES = {
    "db": "database",
    "ll": "lowlevel",
    "generalpurpose": "gp",
    "core": "gp",
}

# ---------------------------------------------------------------------------
# Defaults of this package.
# ---------------------------------------------------------------------------

# Punctuation kept by the word-vector tokens, and by the tokens that are looked up as tags.
VECTOR_PUNCTUATION = PUNCTUATION.replace(".", "")
TAGGING_PUNCTUATION = PUNCTUATION.replace(".", "").replace("-", "")

# English words of the closed classes whose unigrams never stand for a tag.
CLOSED_CLASS_WORDS = {
    "determiner": "the a an this that these those each every either neither some any no all both another".split(),
    "preposition": (
        "of in for on with at by from about as into like through after over between out against during without "
        "before under around among within along across behind beyond towards upon onto off above below near "
        "since until because although though while if unless whether than despite per via"
    ).split(),
    "to": ["to"],
    "pronoun": (
        "i you he she it we they me him her us them myself yourself himself herself itself ourselves themselves "
        "mine yours hers ours theirs"
    ).split(),
    "possessive": "my your his its our their".split(),
}
