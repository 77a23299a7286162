"""Text as column expressions: cleaning, tokens, emoji, transliteration. Everything stays in the JVM.

White space is the ASCII kind everywhere, so that two engines agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the cleaning steps.
SPACE = r"[ \t\n\x0B\f\r]"
SOLID = r"[^ \t\n\x0B\f\r]"
MENTIONS = rf"{SPACE}*((rt{SPACE}*)?@{SOLID}+)+"
URLS = rf"//t\.co/{SOLID}*|http|#|:"
BEYOND_LATIN = r"([^\x{0000}-\x{0100}])"
#: A token: a sign that is one of its own, or what stands between white space, punctuation, digits and such signs.
PIECE = r"""[?<>{}]|[^ \t\n\x0B\f\r/',!#$%()*\[\]+:;=@`"\-.0-9&?<>{}]+"""

# Words that are two tokens.
FUSED = {
    "cannot": ("can", "not"),
    "gonna": ("gon", "na"),
    "gotta": ("got", "ta"),
    "wanna": ("wan", "na"),
    "gimme": ("gim", "me"),
    "lemme": ("lem", "me"),
}

# The published Buckwalter letters, in the order of the Arabic ones beside them.
ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهويىًٌٍَُِّْٰٱ"
BUCKWALTER = "'|>&<}AbptvjHxd*rzs$SDTZEg_fqklmnhwyYFNKaui~o`{"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clean_line(line: Column) -> Column:
    """A corpus line without outer white space and equals signs, and with a space for each written-out line break."""
    return F.replace(F.replace(strip(line), F.lit("=")), F.lit("\\n"), F.lit(" "))


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def split_emojis(text: Column) -> Column:
    """A space on both sides of every character beyond Latin-1 and U+0100, and single spaces."""
    return one_space(F.regexp_replace(text, BEYOND_LATIN, " $1 "))


def strip_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTIONS, "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URLS, "")


def clean_arabic(line: Column) -> Column:
    return one_space(F.regexp_replace(to_buckwalter(line), r"_|#|\.+", " "))


def pieces(text: Column, marked: Column | None = None) -> Column:
    """Tokens of a text without mentions: punctuation and digits separate, some signs stand alone, fused words are split. marked: whether it may have an ampersand."""
    plain = F.regexp_replace(text, f"&{SOLID}*", " ")
    plain = plain if marked is None else F.when(marked, plain).otherwise(text)
    # What is kept is matched, not what separates, in one pass over the text.
    found = F.regexp_extract_all(plain, F.lit(PIECE), F.lit(0))
    split = F.create_map(*[x for k, v in FUSED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    halves = lambda parts: F.flatten(F.transform(parts, lambda t: F.coalesce(F.try_element_at(split, t), F.array(t))))
    return F.get(F.transform(F.array(found), lambda parts: F.when(F.arrays_overlap(parts, F.array(*map(F.lit, FUSED))), halves(parts)).otherwise(parts)), F.lit(0))


def tokens(text: Column) -> Column:
    """From raw text to its tokens: line cleaning, emoji spacing, mentions, lower case, pieces. Null has none.

    White space does nothing but separate here, so it stays as it is, also before mentions. Lower case makes no further mention: every @ that is left has white space behind it.
    """
    text = F.coalesce(text, F.lit(""))
    line = F.replace(F.replace(text, F.lit("=")), F.lit("\\n"), F.lit(" "))
    # Most texts lack what a step looks for, which takes far less to see than the step: nothing here makes an @, an ampersand or a character beyond ASCII, so the text itself tells.
    spaced = F.when(F.octet_length(text) == F.length(text), line).otherwise(F.regexp_replace(line, BEYOND_LATIN, " $1 "))
    said = F.when(F.contains(text, F.lit("@")), F.regexp_replace(spaced, rf"(rt{SPACE}*)?@{SOLID}+", "")).otherwise(spaced)
    return pieces(F.lower(said), F.contains(text, F.lit("&")))


def is_emoji(token: Column) -> Column:
    """Whether a token starts beyond U+0BB8."""
    return F.ascii(token) > 3000


def is_surrogate(token: Column) -> Column:
    """Whether a token stands for an emoji; tokens of words are in lower case."""
    return F.regexp_like(token, F.lit("^eMJ[0-9]+$"))


def bigrams(words: Column) -> Column:
    """Each token, and after each but the first its pair with the one before it; an empty one before gives none."""
    before = F.concat(F.array(F.lit("")), words)
    pair = F.zip_with(before, words, lambda b, t: F.when(t.isNull(), F.array().cast("array<string>")).when(b != "", F.array(t, F.concat_ws("-", b, t))).otherwise(F.array(t)))
    return F.flatten(pair)


def fixed(x: Column, places: int) -> Column:
    """A number with so many places, half away from zero; what rounds to zero has no sign."""
    return F.round(x, places).cast(f"decimal(38,{places})").cast("string")


def to_buckwalter(text: Column) -> Column:
    return F.translate(text, ARABIC, BUCKWALTER)


def to_arabic(text: Column) -> Column:
    return F.translate(text, BUCKWALTER, ARABIC)


def displayed(text: Column, arabic: bool = False) -> Column:
    """A Buckwalter word in Arabic script, where the corpus is Arabic and the word starts below U+0100."""
    return F.when(F.ascii(text) < 256, to_arabic(text)).otherwise(text) if arabic else text


def shaddas(text: Column) -> Column:
    """Without sukuns, and with each shadda as a repeat of what was written before it; a leading one stays."""
    def step(made: Column, c: Column) -> Column:
        return F.when(c == "o", made).when((c == "~") & (made != ""), F.concat(made, F.right(made, F.lit(1)))).otherwise(F.concat(made, c))

    # Most words have none, and go without a step a letter.
    return F.when(F.contains(text, F.lit("~")), F.aggregate(F.split(text, ""), F.lit(""), step)).otherwise(F.replace(text, F.lit("o"), F.lit("")))


def matchable(word: Column) -> Column:
    """A Buckwalter word as the grammar has it: three letters renamed, sukuns gone."""
    return F.translate(word, "><&o", "OIW")


def joined_scores(scores: Column) -> Column:
    return F.array_join(F.transform(scores, lambda x: fixed(x, 2)), "\t")


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, r"(.)\1+", "$1")
