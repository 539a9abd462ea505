"""Text functions as Column expressions: tokens, n-grams, readability, performance scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the keyword report.
KEYWORD_STOPS = """a an and are as at be by for from in is it of on or that the this to with your i you he she we they me him her us them
my his its our their what which who whom whose where when why how all each every both few more most other some such no nor not only own
same so than too very just because but if then while about against between into through during before after above below up down out off
over under again further once here there also can will would could should may might shall do does did has have had being been am""".split()

#: The stop words of the content clusters.
CLUSTER_STOPS = """a an the and or but in on at to for of with by from is was are were be been being have has had do does did will would
could should may might shall can need dare ought used it its this that these those i you he she we they what which who whom whose where
when why how all each every both few more most other some such no nor not only own same so than too very just because as until while about
against between into through during before after above below up down out off over under again further then once here there also if""".split()


#: The characters of Unicode's category Zs.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without spaces of any kind at both ends; tabs and line ends stay."""
    return F.trim(text, F.lit(SPACES))


def tokens(text: Column, stops: list[str], least_bytes: int) -> Column:
    """Lower-case runs of letters and digits, of ``least_bytes`` or more, without stop words, in order."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(parts, lambda t: (F.octet_length(t) >= least_bytes) & ~t.isin(stops))


def keyword_tokens(text: Column) -> Column:
    return tokens(text, KEYWORD_STOPS, 3)


def cluster_tokens(text: Column) -> Column:
    return tokens(text, CLUSTER_STOPS, 2)


def ngrams(toks: Column, n: int) -> Column:
    """Runs of n tokens joined by a space. A zip of shifted copies: linear in the number of tokens."""
    if n == 1:
        return toks
    shifted = [F.when(F.size(toks) >= n, F.slice(toks, k + 1, F.greatest(F.size(toks) - (n - 1), F.lit(0)))).otherwise(F.array().cast("array<string>")) for k in range(n)]
    out = shifted[0]
    for s in shifted[1:]:
        out = F.zip_with(out, s, lambda a, b: F.concat_ws(" ", a, b))
    return out


def half_up(x: Column, digits: int) -> Column:
    """Rounding away from zero at the half, of the scaled double."""
    return F.round(x * 10**digits) / 10**digits


def words(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes, trimmed of these, lower-case: other letters split words."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z']+"), lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?]"), lambda s: F.regexp_replace(s, r"\s+", "") != ""))


def syllables(word: Column) -> Column:
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    less = (groups > 1) & word.endswith("e") & ~word.endswith("le")
    return F.when(F.length(F.regexp_replace(word, "[^a-z]", "")) <= 3, 1).otherwise(F.greatest(groups - F.when(less, 1).otherwise(0), F.lit(1)))


def reading_level(ease: Column) -> Column:
    return F.when(ease >= 80, "Easy").when(ease >= 60, "Standard").when(ease >= 30, "Difficult").otherwise("Very difficult")


def response_score(ms: Column) -> Column:
    """Null for null; bands of response time."""
    return F.when(ms <= 200, 100).when(ms <= 500, 90).when(ms <= 1000, 70).when(ms <= 2500, 45).when(ms.isNotNull(), 20)


def carbon_grams(size: Column, stored: Column | None = None) -> Column:
    made = F.when(size > 0, half_up(size / F.lit(1e6) * 0.8, 4))
    return made if stored is None else F.coalesce(stored, made)
