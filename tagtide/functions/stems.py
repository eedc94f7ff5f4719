"""Porter stemming (the published five-step suffix algorithm of 1980) as built-in column expressions.

No Python worker: each step is a ``when`` chain over the listed suffixes, longest first, and the measure of a stem
comes from its consonant/vowel mask, folded over its characters with ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffix rules of the published algorithm, as (suffix, replacement).
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]


def mask(s: Column) -> Column:
    """'c' or 'v' per character: a, e, i, o, u are vowels, and y after a consonant is one."""
    return F.aggregate(
        F.split(s, ""),
        F.lit(""),
        lambda acc, ch: F.concat(acc, F.when(ch.isin(*"aeiou"), "v").when((ch == "y") & acc.endswith("c"), "v").otherwise("c")),
    )


def measure(s: Column) -> Column:
    """m of [C](VC){m}[V]."""
    return F.regexp_count(mask(s), F.lit("vc"))


def _has_vowel(s: Column) -> Column:
    return mask(s).contains("v")


def _double_consonant(s: Column) -> Column:
    n = F.length(s)
    return (n >= 2) & (F.substring(s, -1, 1) == F.substring(s, -2, 1)) & mask(s).endswith("c")


def _cvc(s: Column) -> Column:
    return mask(s).endswith("cvc") & ~F.substring(s, -1, 1).isin("w", "x", "y")


def _stem(w: Column, suffix: str) -> Column:
    return w.substr(F.lit(1), F.length(w) - len(suffix))


def _rules(w: Column, rules, condition) -> Column:
    """The longest listed suffix that ends ``w`` is replaced if ``condition(stem, suffix)`` holds; no shorter one is tried."""
    out = None
    for suffix, repl in sorted(rules, key=lambda r: -len(r[0])):
        stem = _stem(w, suffix)
        then = F.when(condition(stem, suffix), F.concat(stem, F.lit(repl))).otherwise(w)
        out = F.when(w.endswith(suffix), then) if out is None else out.when(w.endswith(suffix), then)
    return out.otherwise(w)


def _step1b(w: Column) -> Column:
    ed, ing = _stem(w, "ed"), _stem(w, "ing")
    cut = F.when(w.endswith("ed") & _has_vowel(ed), ed).when(w.endswith("ing") & _has_vowel(ing), ing)
    fixed = (
        F.when(cut.endswith("at") | cut.endswith("bl") | cut.endswith("iz"), F.concat(cut, F.lit("e")))
        .when(_double_consonant(cut) & ~F.substring(cut, -1, 1).isin("l", "s", "z"), _stem(cut, "x"))
        .when((measure(cut) == 1) & _cvc(cut), F.concat(cut, F.lit("e")))
        .otherwise(cut)
    )
    eed = _stem(w, "eed")
    return F.when(w.endswith("eed"), F.when(measure(eed) > 0, F.concat(eed, F.lit("ee"))).otherwise(w)).when(cut.isNotNull(), fixed).otherwise(w)


def _step5(w: Column) -> Column:
    e = _stem(w, "e")
    m_e = measure(e)
    return F.when(w.endswith("e") & ((m_e > 1) | ((m_e == 1) & ~_cvc(e))), e).otherwise(w)


def stem_steps(df: DataFrame, word: str, into: str) -> DataFrame:
    """Add ``into``, the stem of the lower-case ``word``, one select per step so no step's expression is copied into the next.

    Words of one or two characters stay; a null word gives null; an empty word gives the empty string.
    Letters other than a-z are consonants, as the algorithm treats any non-vowel.
    """
    tmp = "__stem"
    steps = [
        lambda w: F.when(w.endswith("sses"), _stem(w, "es")).when(w.endswith("ies"), _stem(w, "es"))
        .when(w.endswith("ss"), w).when(w.endswith("s"), _stem(w, "s")).otherwise(w),
        _step1b,
        lambda w: F.when(w.endswith("y") & _has_vowel(_stem(w, "y")), F.concat(_stem(w, "y"), F.lit("i"))).otherwise(w),
        lambda w: _rules(w, STEP2, lambda s, _: measure(s) > 0),
        lambda w: _rules(w, STEP3, lambda s, _: measure(s) > 0),
        lambda w: _rules(
            w, [(s, "") for s in STEP4],
            lambda s, suf: (measure(s) > 1) & ((F.lit(suf != "ion")) | F.substring(s, -1, 1).isin("s", "t")),
        ),
        _step5,
        lambda w: F.when((measure(w) > 1) & _double_consonant(w) & w.endswith("l"), _stem(w, "l")).otherwise(w),
    ]
    out = df.withColumn(tmp, F.col(word))
    for step in steps:
        w = F.col(tmp)
        out = out.withColumn(tmp, F.when(F.length(w) > 2, step(w)).otherwise(w))
    return out.drop(into).withColumnRenamed(tmp, into)


def stem_words(df: DataFrame, word: str, into: str = "stem") -> DataFrame:
    """``stem_steps`` once per distinct word, joined back on the word: a word that a third of all rows hold is stemmed once.

    The join is on equal words; adaptive execution splits a hot word's rows on the side that carries them.
    Null words get a null stem; every row of ``df`` stays.
    """
    key = "__stem_word"
    distinct = df.select(F.col(word).alias(key)).where(F.col(key).isNotNull()).distinct()
    stems = stem_steps(distinct, key, "__stem_out")
    kept = df.drop(into) if into in df.columns and into != word else df
    return kept.join(stems, kept[word] == stems[key], "left").drop(key).withColumnRenamed("__stem_out", into)
