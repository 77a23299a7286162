"""Arabic morphology over Buckwalter text: a grammar of named patterns.

Columns are analysed in the JVM, by the patterns without conditionals that patterns.py makes of the grammar; no Python runs in a task.
analyse() and segments() say the same of one word, by the grammar as it stands.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions import text as T
from glyphloom.storage import written

from . import features, patterns

# The grammar. A name in capitals stands for its rule as a group of that name, with # before it for its rule alone; spaces don't count.
GRAMMAR = {
    "LV": "A|w|y",
    "SV": "i|o|u|a",
    "V": "#SV? (#SV| #LV)",
    "CA": "[^AiouapF]",
    "CB": "[^iouapFy]",
    "X": "[^AiouapFwy]",
    "RC1": "(?P<C1>#CA)(?P=C1)*?",
    "RC2": "(?P<C2>#CA)(?P=C2)*?",
    "ROOT": "((#RC1|^A) ((?P<V1>#V)(?P=V1)*)?) (?P<G2>(#RC2 ((?P<V2>#V)(?P=V2)*)?)){,3}? #CB",
    "VROOT": "(#RC1 ((?P<V1>#V)(?P=V1)*)?) (?P<G2>(#RC2 ((?P<V2>#V)(?P=V2)*)?)){,3}? #CA",
    "NDERIV": "mu?(?=(#X #V?){3,})|A(?=(.t.A))|A(s+)t|mst|Ist|I(?=..A)",
    "ADJ": "y",
    "NSTEM": "Allh|(NDERIV? ROOT ADJ?)",
    "VDERIV": "t(u|.A)|A(?=[^s].t)|(?<=(y|n|t))st|(?<!(y|t|n))Ast|An",
    "VSTEM": "VDERIV? VROOT",
    "XSTEM": "(#CA #V?){3,}",
    "NCONJ": "(w|f)(?=(Al|#XSTEM))",
    "VCONJ": "(w|f) (?=#XSTEM)",
    "NEG": "(m|l)A(?=...)",
    "INT": "O",
    "PREP": "(ba?|k(?:i?)|l)",
    "PREP1": "#PREP (?=(#DET|(#CA #V?){3,}))",
    "DET": "Al|(?<=l)l",
    "PX": "k(?:u?mA?|n|)|h(u?m)?(?:A*)|hn|nA|y",
    "PRON": "(?(G2)k)|k(?:u?mA?|n)|h(u?m)?(?:A*)|hn|nA|y",
    "PRON1": "#PRON|#NY",
    "NY": "ny",
    "PRON2": "#PREP #PRON1",
    "FUT": "s|H|h|b",
    "IV": "((?P<ON>O|(n(?=[^Awy]{3})))|(?P<Y>y)|(?P<T>t))(a|u)?",
    "PV": "(?P<PAST>)",
    "IMPER": "(?P<IMP>A)",
    "TENSE": "(FUT? IV)|PV",
    "AGR_ON": "",
    "AGR_A": "(?<=(.{3}))(?<!(?:n|h))A",
    "AGR_Y": "(?:An|#AGR_A|w(A|n)|n|)",
    "AGR_T": "(?:yn|An|wn|n|)",
    "AGR_PAST": "t(mA?|n?)|#AGR_A|wA|nA?|",
    "AGR_IMPER": "(#AGR_A|wA|n|)",
    "PERSON": "(?(ON)AGR_ON|(?(Y)AGR_Y|(?(T)AGR_T|(?(PAST)AGR_PAST|(?(IMP)AGR_IMPER)))))",
    "VOC": "yA",
    "AGREE": r"tAn|wn|yn|a?p|t(?=.)|At|\|t|(?(G2)An)|",
    "CASE": "SV | AF | FA? | (?(G2)(?<!(h|n))Axxxxx)",
    "ALLAH": "A?llh",
    "NAME": "Allh?",
    "NN": "(NCONJ? VOC? PREP? (PX$|(NAME | DET? NSTEM AGREE) (((ALLAH|PRON)?) | CASE?)))",
    "VB": "VCONJ? NEG? (IMPER|(INT? TENSE)) VSTEM PERSON (?(G2)(PRON1)?)",
}
# The groups that an analysis shows, in their order; the second set leaves agreement and tense with the stem.
STANDARD = {
    "NN": ("NCONJ", "VOC", "PREP", "PX", "NAME", "DET", "NSTEM", "AGREE", "PRON", "ALLAH", "CASE"),
    "VB": ("VCONJ", "NEG", "IMPER", "INT", "FUT", "IV", "PV", "VSTEM", "PERSON", "PRON1", "PRON2"),
}
STEMMING = {
    "NN": ("NCONJ", "VOC", "PREP", "PX", "NAME", "DET", "NSTEM", "NN", "PRON", "ALLAH"),
    "VB": ("VCONJ", "NEG", "VSTEM", "VB", "PRON1", "PRON2"),
}
PAIRS = "array<struct<tag:string,form:string>>"

_NAME = re.compile(r"(#?)([A-Z0-9_]+)")
_RENAMED = str.maketrans({">": "O", "<": "I", "&": "W", "o": None})


def spelled_out(rule: str, grammar: dict[str, str]) -> str:
    """A rule's pattern with the names in it replaced, down to the last."""

    def group(m: re.Match) -> str:
        if m[2] not in grammar:
            return m[0]
        inner = spelled_out(grammar[m[2]], grammar)
        return f"({inner})" if m[1] else f"(?P<{m[2]}>{inner})"

    return _NAME.sub(group, rule).replace(" ", "")


@cache
def compiled(rule: str) -> re.Pattern:
    """A pattern for whole words of one of GRAMMAR's rules."""
    return re.compile(f"^{spelled_out(GRAMMAR[rule], GRAMMAR)}$")


def analyse(word: str, rule: str, groups: dict[str, tuple[str, ...]] = STANDARD) -> list[tuple[str, str]] | None:
    """(tag, form) of the groups that took part in the match of a word (in Buckwalter letters), or None."""
    m = compiled(rule).match(word.translate(_RENAMED))
    if m is None:
        return None
    found = m.groupdict()
    return [(tag, found[tag]) for tag in groups[rule] if found.get(tag) is not None]


def segments(word: str) -> list[str]:
    """A word's prefixes, stem and suffixes by its better analysis: as a verb if that leaves the shorter stem, else as a noun.

    Words without an analysis, and those whose analysis has no stem, are one segment. The word itself is cut: letters that the grammar knows by
    another name come back as they were, and a sukun, which it doesn't see, stays with the letter before it. So the segments spell the word.
    """
    noun, verb = analyse(word, "NN", STEMMING), analyse(word, "VB", STEMMING)
    if noun and verb:
        stems = dict(noun).get("NSTEM"), dict(verb)["VSTEM"]
        if stems[0] is None:
            return [word]
        best = verb if len(stems[1]) < len(stems[0]) else noun
    else:
        best = noun or verb
    at = [i for i, (tag, _) in enumerate(best or ()) if "STEM" in tag]
    if not at:
        return [word]
    seen = [i for i, c in enumerate(word) if c != "o"]  # where the letters stand that the grammar sees
    before, after = [len(f) for _, f in best[: at[0]]], [len(f) for _, f in best[at[-1] + 1 :] if f]
    sizes = [*before, len(seen) - sum(before) - sum(after), *after]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    cuts = [0, *(seen[e] if e < len(seen) else len(word) for e in ends[:-1]), len(word)]
    cuts = [0 if i and not ends[i - 1] and i < len(sizes) else c for i, c in enumerate(cuts)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def lookup(word: Column, rule: str, groups: dict[str, tuple[str, ...]] = STANDARD) -> Column:
    """analyse() of a column: an array of (tag, form), or null."""
    return patterns.analysed(T.matchable(word), rule, groups[rule])


def lookup_either(word: Column, rule: str, other: str, groups: dict[str, tuple[str, ...]] = STANDARD) -> Column:
    return F.coalesce(lookup(word, rule, groups), lookup(word, other, groups))


def stem_word(word: Column) -> Column:
    """segments() of a column of Buckwalter words."""
    # A unit is a letter that the grammar sees, with the sukuns behind it; those before the first belong to it.
    units = F.regexp_extract_all(word, F.lit("^o*[^o]o*|[^o]o*"), F.lit(0))
    both = F.struct(units.alias("units"), lookup(word, "NN", STEMMING).alias("noun"), lookup(word, "VB", STEMMING).alias("verb"))

    def cut(x: Column) -> Column:
        stem = lambda pairs, tag: F.get(F.filter(pairs, lambda p: p["tag"] == tag), F.lit(0))["form"]
        noun, verb = stem(x["noun"], "NSTEM"), stem(x["verb"], "VSTEM")
        of_noun = x["noun"].isNotNull() & (x["verb"].isNull() | noun.isNull() | (F.length(verb) >= F.length(noun)))
        best = F.when(of_noun, x["noun"]).otherwise(x["verb"])
        return F.when(F.when(of_noun, noun).otherwise(verb).isNull(), F.array(word)).otherwise(F.get(F.transform(F.array(best), lambda pairs: joined(x["units"], pairs)), F.lit(0)))

    def joined(units: Column, pairs: Column) -> Column:
        """The units, dealt out by the lengths of the parts; the stem has what the others leave."""
        at = F.array_position(F.transform(pairs, lambda p: F.contains(p["tag"], F.lit("STEM"))), F.lit(True)).cast("int")
        ahead = F.transform(F.slice(pairs, F.lit(1), at - 1), lambda p: F.length(p["form"]))
        behind = F.filter(F.transform(F.slice(pairs, at + 1, F.size(pairs)), lambda p: F.length(p["form"])), lambda n: n > 0)
        total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
        sizes = F.concat(ahead, F.array(F.size(units) - total(ahead) - total(behind)), behind)
        start = lambda i: total(F.slice(sizes, F.lit(1), i))
        return F.transform(sizes, lambda n, i: F.array_join(F.slice(units, start(i) + 1, n), ""))

    return F.when(word.isNotNull(), F.get(F.transform(F.array(both), cut), F.lit(0)))


def words(text: Column) -> Column:
    """The words of a text in Buckwalter letters. Null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{T.SPACE}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """The segments of the words of a text in Buckwalter letters: what the tokens of an Arabic corpus are. Null has none."""
    return F.filter(F.flatten(F.transform(words(text), stem_word)), lambda s: s != "")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, token, n of the tokens() of docs (doc_id, text); each different word is analysed once."""
    return features.counts_by_word(docs, words, stem_word)


def stem_text(text: Column) -> Column:
    """Arabic text with its words in segments, all separated by single spaces of the input's splitting."""
    return T.to_arabic(F.array_join(F.transform(F.split(T.to_buckwalter(text), " "), lambda w: F.array_join(stem_word(w), " ")), " "))


def stem_texts(requests: DataFrame) -> DataFrame:
    """value, answer of a batch of requests (value): stem_text() of each; each different word is analysed once, however often it stands in them.

    Words that stand in them very often are broadcast with their segments, as in features.counts_by_word(); the others meet theirs by hash.
    """
    own = written(requests.select(F.monotonically_increasing_id().alias("row"), "value"), "requests")
    each = own.select("row", F.posexplode(F.split(T.to_buckwalter(F.col("value")), " ")).alias("pos", "word"))
    found = written(each.groupBy("word").agg(F.count("*").alias("n")).withColumn("said", F.array_join(stem_word(F.col("word")), " ")), "parts")
    least = (found.agg(F.sum("n")).first()[0] or 0) / features.HEAVY
    heavy = found.where(F.col("n") > least)
    common = each.join(F.broadcast(heavy.select("word", "said")), "word")
    rest = each.join(F.broadcast(heavy.select("word")), "word", "left_anti").join(found.where(F.col("n") <= least).select("word", "said").hint("shuffle_hash"), "word")
    placed = common.unionByName(rest).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("words"))
    return own.join(placed, "row", "left").select("value", T.to_arabic(F.array_join("words.said", " ")).alias("answer"))


def root(pairs: Column) -> Column:
    """The first pair whose tag names a root, or null."""
    return F.get(F.filter(pairs, lambda p: F.contains(p["tag"], F.lit("ROOT"))), 0)


def not_empty(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["form"].isNotNull())


def shown(pair: Column, bw: Column | None = None) -> Column:
    """form/tag, or tag/form/bw."""
    return F.concat_ws("/", pair["form"], pair["tag"]) if bw is None else F.concat_ws("/", pair["tag"], pair["form"], bw)


def all_shown(pairs: Column) -> Column:
    """form/tag of each pair."""
    return F.transform(pairs, lambda p: shown(p))


def matches(a: Column, b: Column) -> Column:
    """Whether two pairs agree, where ??? stands for any tag or form; null where the tags differ."""
    any_tag = (a["tag"] == "???") | (b["tag"] == "???")
    any_form = (a["form"] == "???") | (b["form"] == "???") | (a["form"] == b["form"])
    return F.when(any_tag, a["form"] == b["form"]).when(a["tag"] == b["tag"], any_form)


def in_script(pairs: Column) -> Column:
    """An analysis in Arabic script: form/tag, separated by spaces."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("/", T.to_arabic(p["form"]), p["tag"])), " ")


def lookup_all(gold: DataFrame, groups: dict[str, tuple[str, ...]] = STANDARD) -> DataFrame:
    """gold (form, tag, bw) with `source` and `analysis`: nouns as NN, then VB; tag VB as VB, then NN; other tags go."""
    noun = F.startswith("tag", F.lit("NN"))
    as_noun, as_verb = gold.where(noun), gold.where(F.col("tag") == "VB")
    made = as_noun.withColumn("analysis", lookup_either(F.col("bw"), "NN", "VB", groups)).unionByName(as_verb.withColumn("analysis", lookup_either(F.col("bw"), "VB", "NN", groups)))
    return made.withColumn("source", F.lit("main"))


def index_by_segment(analysed: DataFrame) -> DataFrame:
    """segment, form, tag, bw: a row for each different word that has the segment (form/TAG, no roots)."""
    each = analysed.select("form", "tag", "bw", F.explode("analysis").alias("pair")).where(~F.contains(F.col("pair.tag"), F.lit("ROOT")))
    return each.select(shown(F.col("pair")).alias("segment"), "form", "tag", "bw").distinct()


def show_index(index: DataFrame, most: int = 20) -> DataFrame:
    """segment, size, words: each segment's number of words and the first `most` of them; ranked before they are gathered."""
    from pyspark.sql import Window

    index = written(index, "segments")
    sizes = index.groupBy("segment").agg(F.count("*").alias("size"))
    # Nothing but a rank and its limit, so that each task sends on the first words of a segment alone, and no segment gathers all its words.
    ranked = index.withColumn("n", F.row_number().over(Window.partitionBy("segment").orderBy("form", "tag", "bw"))).where(F.col("n") <= most)
    words = ranked.groupBy("segment").agg(F.array_sort(F.collect_list("form")).alias("words"))
    return words.join(sizes, "segment").select("segment", "size", "words")


def show(analysed: DataFrame, sources: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """The rows whose source is main or among `sources`, the first `most` of them by form, tag and letters; all where most is None or 0."""
    rows = analysed.where(F.col("source").isin("main", *sources)).orderBy("form", "tag", "bw")
    return rows.limit(most) if most else rows


def plain(analysis: Column) -> Column:
    """An analysis as forms joined by +, in the other analyser's spelling."""
    text = F.array_join(F.transform(F.coalesce(analysis, F.array().cast(PAIRS)), lambda p: F.concat_ws("/", p["form"], p["tag"])), "+")
    # Here and below, the patterns of what doesn't count, in this order.
    text = F.regexp_replace(text, r"\+/[A-Z]*", "")
    # Spellings that differ.
    for a, b in (("All/NAME", "Allh/NAME"), ("+A/CASE", "+AF/CASE"), ("+l/DET", "+Al/DET")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, r"/[^+]*", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^\+|\+$", ""), r"\++", "+")
    # Likewise, in this order.
    for a, b in (("}", ""), ("+FA", "+AF"), ("+F", "+AF")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def agreement(both: DataFrame) -> DataFrame:
    """both (form, bw, analysis, others) with `ours` and `colour`: how our analysis stands to another analyser's list.

    PURPLE neither has one, BLACK theirs has ours, GREEN ours is missing, BLUE theirs is, RED they differ. Words of one letter, and those that only repeat letters of the form, go.
    """
    letters = lambda c: F.split(F.col(c), "")
    rows = both.where((F.length("bw") != 1) & (F.size(F.array_except(letters("bw"), letters("form"))) > 0)).withColumn("ours", plain(F.col("analysis")))
    none = F.size(F.coalesce("others", F.array().cast("array<string>"))) == 0
    colour = F.when(none & (F.col("ours") == ""), "PURPLE").when(F.coalesce(F.array_contains("others", F.col("ours")), F.lit(False)), "BLACK")
    return rows.withColumn("colour", colour.when(F.col("ours") == "", "GREEN").when(none, "BLUE").otherwise("RED"))


def agreement_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("colour").agg(F.count("*").alias("n"))
