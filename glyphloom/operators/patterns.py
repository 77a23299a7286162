"""The morphology grammar as patterns that Spark's own regular expressions run, which have no conditionals.

A conditional asks whether a group has taken part. Instead, what follows the group is written once for each answer, behind the alternative that
gives it: a stem goes on as one without further consonants or as one with some, a verb's tense as each of its five persons. The alternatives
stand where the group stood, in the order in which the grammar tries them, so that the first match is the same one. The rest of the pattern is
made of the grammar's rules, with their groups numbered apart.

One replacement lists all groups of a match. A group that is empty can't be told there from one that took no part, so three are told by others:
a pronoun may be empty only where the stem has no further consonants, a past tense is what is neither imperative nor imperfect, and a stem is what
the other parts leave of the match.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the groups of a match. A word that holds it has no analysis.
BREAK = "￾"
#: Groups that a pattern may have several of, and those that a match lists, in order.
LISTED = {
    "NN": ("ALL", "NCONJ", "VOC", "PREP", "PX", "NAME", "DET", "AGREE", "ALLAH", "PRON", "CASE", "G2"),
    "VB": ("ALL", "VCONJ", "NEG", "IMPER", "INT", "FUT", "IV", "PERSON", "PRON1", "G2"),
}
#: The parts of a match, from left to right; None is the stem.
PARTS = {
    "NN": ("NCONJ", "VOC", "PREP", "PX", "NAME", "DET", None, "AGREE", "ALLAH", "PRON", "CASE"),
    "VB": ("VCONJ", "NEG", "IMPER", "INT", "FUT", "IV", None, "PERSON", "PRON1"),
}


def decided(text: str, group: str, bound: bool) -> str:
    """A rule's text with each conditional on a group replaced by what it asks for where the group has taken part, or by nothing."""
    asks = f"(?({group})"
    while (at := text.find(asks)) >= 0:
        end, depth = at + len(asks), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[:at] + (text[at + len(asks) : end - 1] if bound else "") + text[end:]
    return text


class Spelled:
    """A pattern in the making: numbers its groups, so that each has a name of its own."""

    def __init__(self, grammar: dict[str, str]) -> None:
        self.grammar = grammar
        self.made: dict[str, list[str]] = {}

    def group(self, name: str, body: str) -> str:
        """A group of that name; those of one name exclude each other."""
        numbered = f"{name}x{sum(map(len, self.made.values()))}"
        self.made.setdefault(name, []).append(numbered)
        return f"(?<{numbered}>{body})"

    def rule(self, name: str, more: bool = False) -> str:
        """A rule with the rules in it replaced and its own groups numbered, as it is of a stem with further consonants or without."""
        text = decided(self.grammar[name], "G2", more)
        while (found := re.sub(r"(?<!\?P[<=])#?\b([A-Z][A-Z0-9_]*)\b", lambda m: f"(?:{self.grammar[m[1]]})" if m[1] in self.grammar else m[0], text)) != text:
            text = found
        names: dict[str, str] = {}

        def numbered(m: re.Match) -> str:
            names[m[1]] = f"{m[1]}x{sum(map(len, self.made.values()))}"
            self.made.setdefault("", []).append(names[m[1]])
            return f"(?<{names[m[1]]}>"

        # Three or more stand in look-aheads alone, where three say as much; Java counts repeats of a group on its stack, which a long word would fill.
        text = re.sub(r"\(\?P<(\w+)>", numbered, text).replace("{3,}", "{3}")
        return f"(?:{re.sub(r'\(\?P=(\w+)\)', lambda m: rf'\k<{names[m[1]]}>', text)})".replace(" ", "")

    def vowels(self, n: str) -> str:
        """A vowel and its repeats."""
        v = self.group("", self.rule("V"))
        return rf"(?:{v}\k<{self.made[''][-1]}>*)?"

    def consonant(self, name: str) -> str:
        return self.rule(name) + self.vowels(name)

    def further(self) -> str:
        """One to three more consonants, as few as will do: what the conditionals ask for."""
        at = len(self.made.setdefault("G2", []))
        self.made["G2"].append("")
        body = self.consonant("RC2")
        name = f"G2x{sum(map(len, self.made.values()))}"
        self.made["G2"][at] = name
        return f"(?<{name}>{body}){{1,3}}?"

    def noun(self) -> str:
        return f"(?d)^{self.group('ALL', self._noun())}$"

    def _noun(self) -> str:
        g, rule = self.group, self.rule

        def tail(more: bool) -> str:
            """ALLAH, a pronoun or a case ending, of a stem with more consonants or without."""
            return f"(?:(?:{g('ALLAH', rule('ALLAH'))}|{g('PRON', rule('PRON', more))})?|{g('CASE', rule('CASE', more))}?)$"

        def agree(more: bool) -> str:
            return g("AGREE", rule("AGREE", more))

        last = f"{rule('CB')}{rule('ADJ')}?"
        root = f"(?:{rule('NDERIV')})?(?:{rule('RC1')}|^A){self.vowels('V1')}"
        stem = f"(?:Allh{agree(False)}{tail(False)}|{root}(?:{last}{agree(False)}{tail(False)}|{self.further()}{last}{agree(True)}{tail(True)}))"
        rest = f"(?:{g('PX', rule('PX'))}$|(?:{g('NAME', rule('NAME'))}{tail(False)}|{g('DET', rule('DET'))}?{stem}))"
        return f"{g('NCONJ', rule('NCONJ'))}?{g('VOC', rule('VOC'))}?{g('PREP', rule('PREP'))}?{rest}"

    def verb(self) -> str:
        return f"(?d)^{self.group('ALL', self._verb())}$"

    def _verb(self) -> str:
        g, rule = self.group, self.rule

        def stem(person: str) -> str:
            """A stem and the endings that go with a person."""
            ending = lambda: g("PERSON", rule(person))
            alone = f"{rule('CA')}{ending()}$"
            more = f"{self.further()}{rule('CA')}{ending()}{g('PRON1', f'{rule('PRON', True)}|{rule('NY')}')}?$"
            return f"(?:{rule('VDERIV')})?{rule('RC1')}{self.vowels('V1')}(?:{alone}|{more})"

        # Each of the three persons of the imperfect has its letter, and may have a vowel behind it.
        letters = (("O|(?:n(?=[^Awy]{3}))", "AGR_ON"), ("y", "AGR_Y"), ("t", "AGR_T"))
        imperfect = "|".join(f"{g('IV', f'(?:{letter})(?:a|u)?')}{stem(person)}" for letter, person in letters)
        tense = f"(?:{g('FUT', rule('FUT'))}?(?:{imperfect})|{stem('AGR_PAST')})"
        start = f"(?:{g('IMPER', 'A')}{stem('AGR_IMPER')}|{g('INT', rule('INT'))}?{tense})"
        return f"{g('VCONJ', rule('VCONJ'))}?{g('NEG', rule('NEG'))}?{start}"


@cache
def pattern(rule: str) -> tuple[str, str]:
    """(pattern, replacement) of a rule for whole words: the replacement lists LISTED[rule], a break behind each."""
    from .morphology import GRAMMAR

    made = Spelled(GRAMMAR)
    text = made.noun() if rule == "NN" else made.verb()
    return text, "".join("".join(f"${{{n}}}" for n in made.made[name]) + BREAK for name in LISTED[rule])


def analysed(word: Column, rule: str, tags: tuple[str, ...]) -> Column:
    """The (tag, form) of each of `tags` that takes part in the match of a word in the grammar's letters, or null."""
    text, listing = pattern(rule)
    listed = F.when(~F.contains(word, F.lit(BREAK)), F.split(F.regexp_replace(word, text, listing), BREAK))

    def told(found: Column) -> Column:
        form = {name: found[i] for i, name in enumerate(LISTED[rule])}
        there = {name: x != "" for name, x in form.items()}
        parts = PARTS[rule]
        at = parts.index(None)
        length = lambda names: sum((F.length(form[n]) for n in names[1:]), F.length(form[names[0]]))
        before, after = length(parts[:at]), length(parts[at + 1 :])
        stem = "NSTEM" if rule == "NN" else "VSTEM"
        form[stem] = F.substring(form["ALL"], before + 1, F.length(form["ALL"]) - before - after)
        if rule == "NN":
            there["NSTEM"] = there["AGREE"] = ~there["PX"] & ~there["NAME"]
            bare = ~there["ALLAH"] & ~there["CASE"] & ~there["G2"] & ~there["PX"]
            there["PRON"] = there["PRON"] | bare
        else:
            there["VSTEM"] = there["PERSON"] = F.lit(True)
            form["PV"], there["PV"] = F.lit(""), ~there["IMPER"] & ~there["IV"]
        pairs = [F.when(there[t], F.struct(F.lit(t).alias("tag"), form[t].alias("form"))) for t in tags if t in form]
        return F.when(F.size(found) > len(LISTED[rule]), F.array_compact(F.array(*pairs)))

    return F.get(F.transform(F.array(listed), told), F.lit(0))
