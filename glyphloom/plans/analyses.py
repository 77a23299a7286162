"""The morphology grammar as joins, for a second engine whose regular expressions have neither conditionals, back references nor look-around.

A word's analysis is the first that the grammar's order of choices comes to. Choices before the stem are rows with a rank; what a stem may be is
worked out from the word's end: `fin` says how a word ends behind a stem that stops at a place, `hop` where a consonant with its vowels leads
from a place, and four levels, one for each number of further consonants, what the first way to an end is. The first of all is the row of
least rank. Places count letters from 0; b is 1 where the stem has further consonants, which is what the grammar's conditionals ask.
"""

from __future__ import annotations

# The grammar's letters and endings, as classes and lists of this dialect.
_CA, _CB, _SHORT, _VOWEL = "AiouapF", "iouapFy", "ioua", "iouaAwy"
_UNITS = "(?:[^AiouapF](?:[ioua]?[iouaAwy])?){3}"
_PLAIN_UNITS = "(?:[^AiouapFwy](?:[ioua]?[iouaAwy])?){3}"
_PRON, _PX, _PRON1 = "k(?:u?mA?|n)|h(?:u?m)?A*|hn|nA|y", "k(?:u?mA?|n)?|h(?:u?m)?A*|hn|nA|y", "k|k(?:u?mA?|n)|h(?:u?m)?A*|hn|nA|y|ny"
_CASES = "i|o|u|a|AF|FA?"
_AGREE = ("tAn", "wn", "yn", "ap", "p", "t", "At", "|t", "An", "")
_NDERIV = (("mu", f"^{_PLAIN_UNITS}"), ("m", f"^{_PLAIN_UNITS}"), ("A", "^.t.A"), ("As+t", ""), ("mst", ""), ("Ist", ""), ("I", "^..A"), ("", ""))
#: Endings of each person in order; the one marked needs three letters before it, the last of them neither n nor h.
_PERSONS = {
    "ON": ("",),
    "Y": ("An", "A*", "wA", "wn", "n", ""),
    "T": ("yn", "An", "wn", "n", ""),
    "PAST": ("tmA", "tm", "tn", "t", "A*", "wA", "nA", "n", ""),
    "IMP": ("A*", "wA", "n", ""),
}


def _values(rows: list[tuple[object, ...]]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def _rest(place: str) -> str:
    return f"substr(s, CAST({place} + 1 AS BIGINT))"


def _at(place: str) -> str:
    return f"substr(s, CAST({place} + 1 AS BIGINT), 1)"


def _ended(text: str) -> str:
    """A text without the line break that an end may have behind it."""
    return f"regexp_replace({text}, '\\n$', '')"


def _tail(r: str, b: str, before: str) -> str:
    """What stands behind a noun: ALLAH, PRON, CASE or none; null where nothing fits."""
    return f"""CASE WHEN {r} IN ('Allh', 'llh') THEN 'ALLAH' WHEN {r} = '' AND {b} = 0 OR {r} = 'k' AND {b} = 1 OR regexp_full_match({r}, '{_PRON}') THEN 'PRON' WHEN {r} = '' THEN 'none'
        WHEN regexp_full_match({r}, '{_CASES}') OR {b} = 1 AND {r} = 'Axxxxx' AND {before} NOT IN ('h', 'n') THEN 'CASE' END"""


def _level(exits: str, further: str | None) -> str:
    """(id, p, out): the stem stops here, or else goes on by the first consonant that leads to an end."""
    if further is None:
        return f"SELECT id, p, out FROM {exits}"
    return f"""SELECT id, p, arg_min(out, o) AS out FROM (SELECT id, p, out, CAST(-1 AS HUGEINT) AS o FROM {exits}
        UNION ALL SELECT h.id, h.p, n.out, h.o FROM hop h JOIN {further} n ON n.id = h.id AND n.p = h.q) GROUP BY id, p"""


def _hops(source: str) -> str:
    """(id, p, q, o): from the consonant at p, repeated r times, past a vowel with its repeats, or none; the first way to each place."""
    # A vowel is one of two letters where it can be, repeated as often as it can be.
    of_two = f"strpos('{_SHORT}', v1) > 0 AND v2 <> '' AND strpos('{_VOWEL}', v2) > 0"
    twice = r"(length(rest) - length(regexp_replace(rest, '^(?:' || v1 || v2 || ')+', ''))) // 2"
    return f"""SELECT id, p, q, min(o) AS o FROM (
        SELECT id, p, q0 + k * size AS q, CAST(r AS HUGEINT) * 1000000000000000 + kind * 1000000000000 + (100000000000 - k) AS o FROM (
        SELECT *, unnest(range(1, many + 1)) AS k FROM (
        SELECT *, 0 AS kind, 2 AS size, {twice} AS many FROM (SELECT * FROM {source} WHERE v1 <> '' AND {of_two})
        UNION ALL SELECT *, 1, 1, length(rest) - length(ltrim(rest, v1)) FROM {source} WHERE v1 <> '' AND strpos('{_VOWEL}', v1) > 0
        UNION ALL SELECT *, 2, 0, 1 FROM {source}))) GROUP BY id, p, q"""


def analyses(words: str) -> dict[str, str]:
    """Parts of a query: `nn` and `vb` have the analysis of each word of `words` (a query of column word) as a noun and as a verb, `analysed` both as lists of form/tag, as STANDARD and, under names with s, as STEMMING shows them."""
    once = "SELECT id, s, p, r, p + 1 + r AS q0, substr(s, p + 2 + r) AS rest, substr(s, p + 2 + r, 1) AS v1, substr(s, p + 3 + r, 1) AS v2"
    parts = {
        "mwords": f"SELECT row_number() OVER () AS id, word, translate(word, '><&o', 'OIW') AS s FROM (SELECT DISTINCT word FROM ({words}) x WHERE word IS NOT NULL AND NOT contains(word, chr(65534)))",
        "mletters": f"SELECT id, s, p, {_at('p')} AS c FROM (SELECT id, s, unnest(range(0, length(s))) AS p FROM mwords)",
        "mruns": f"{once} FROM (SELECT id, s, p, unnest(range(0, length({_rest('p')}) - length(ltrim({_rest('p')}, c)))) AS r FROM mletters WHERE strpos('{_CA}', c) = 0)",
        "mfirst": f"{once} FROM (SELECT id, s, p, 0 AS r FROM mletters WHERE p = 0 AND c = 'A')",
        "hop": _hops("mruns"),
        "ahop": _hops("mfirst"),
        "nfin": f"""SELECT id, e, b, arg_min({{'e': e, 'a': a, 'kind': kind, 'r': r, 'b': b}}, o) AS out FROM (SELECT *, {_tail("r", "b", "right(left(s, CAST(e + length(a) AS BIGINT)), 1)")} AS kind FROM (
            SELECT id, s, e, b, o, a, {_ended(_rest("e + length(a)"))} AS r FROM (SELECT id, s, unnest(range(1, length(s) + 1)) AS e FROM mwords) m, {_values(list(enumerate(_AGREE)))} g(o, a), (VALUES (0), (1)) x(b)
            WHERE starts_with({_rest("e")}, a) AND (a <> 'An' OR b = 1) AND (a <> 't' OR regexp_matches({_rest("e + 1")}, '^.')))) WHERE kind IS NOT NULL GROUP BY id, e, b""",
        "nexit": f"""SELECT * FROM (SELECT m.id, m.p, x.b, coalesce(CASE WHEN {_at("m.p + 1")} = 'y' THEN g.out END, f.out) AS out FROM mletters m, (VALUES (0), (1)) x(b)
            LEFT JOIN nfin f ON f.id = m.id AND f.e = m.p + 1 AND f.b = x.b LEFT JOIN nfin g ON g.id = m.id AND g.e = m.p + 2 AND g.b = x.b WHERE strpos('{_CB}', m.c) = 0) WHERE out IS NOT NULL""",
        "nmore": "SELECT id, p, out FROM nexit WHERE b = 1",
        "nbare": "SELECT id, p, out FROM nexit WHERE b = 0",
        "nlevel3": _level("nmore", None),
        "nlevel2": _level("nmore", "nlevel3"),
        "nlevel1": _level("nmore", "nlevel2"),
        "nlevel0": _level("nbare", "nlevel1"),
        "nroot": "SELECT h.id, h.p, arg_min(n.out, h.o) AS out FROM (SELECT * FROM hop UNION ALL SELECT * FROM ahop) h JOIN nlevel0 n ON n.id = h.id AND n.p = h.q GROUP BY h.id, h.p",
        "nconj": f"SELECT id, s, left(s, 1) AS nconj, 1 AS p, 0 AS o FROM mwords WHERE left(s, 1) IN ('w', 'f') AND regexp_matches({_rest('1')}, '^(?:Al|{_UNITS})') UNION ALL SELECT id, s, '', 0, 1 FROM mwords",
        "nvoc": f"SELECT id, s, nconj, 'yA' AS voc, p + 2 AS p, 2 * o AS o FROM nconj WHERE starts_with({_rest('p')}, 'yA') UNION ALL SELECT id, s, nconj, '', p, 2 * o + 1 FROM nconj",
        "nprep": f"""SELECT id, s, nconj, voc, prep, p + length(prep) AS p, 8 * n.o + x.o AS o FROM nvoc n, {_values(list(enumerate(("ba", "b", "ki", "k", "l", ""))))} x(o, prep) WHERE starts_with({_rest("p")}, prep)""",
        "ndet": f"""SELECT id, s, nconj, voc, prep, det, p + length(det) AS p, 4 * n.o + x.o AS o FROM nprep n, (VALUES (0, 'Al'), (1, 'l'), (2, '')) x(o, det)
            WHERE starts_with({_rest("p")}, det) AND (det <> 'l' OR p > 0 AND {_at("p - 1")} = 'l')""",
        "nderiv": "SELECT id, s, nconj, voc, prep, det, p, p + length(form) AS root, 16 * n.o + 1 + x.o AS o FROM (SELECT n.*, x.o AS xo, regexp_extract("
        + _rest("p")
        + f", '^' || x.form) AS form, x.form AS asked, x.ahead FROM ndet n, {_values([(i, a, b) for i, (a, b) in enumerate(_NDERIV)])} x(o, form, ahead)) n, LATERAL (SELECT n.xo AS o) x WHERE (form <> '' OR asked = '') AND (ahead = '' OR regexp_matches("
        + _rest("p + length(form)")
        + ", ahead))",
        # The branches before the stem's: a pronoun that is the whole rest, and the name; each comes before all stems of the same beginning.
        "ncand": f"""SELECT id, CAST(o AS HUGEINT) * 1024 AS o, nconj, voc, prep, {_ended(_rest("p"))} AS px, '' AS name, '' AS det, NULL AS stem, NULL AS agree, 'none' AS kind, '' AS r, 1 AS b FROM nprep WHERE regexp_full_match({_ended(_rest("p"))}, '{_PX}')
            UNION ALL SELECT id, o, nconj, voc, prep, '', name, '', NULL, NULL, kind, r, 0 FROM (SELECT *, {_tail("r", "0", "''")} AS kind FROM (
            SELECT id, CAST(n.o AS HUGEINT) * 1024 + 1 + x.o AS o, nconj, voc, prep, name, {_ended(_rest("p + length(name)"))} AS r FROM nprep n, (VALUES (0, 'Allh'), (1, 'All')) x(o, name) WHERE starts_with({_rest("p")}, name))) WHERE kind IS NOT NULL
            UNION ALL SELECT n.id, CAST(n.o AS HUGEINT) * 256 + 3, nconj, voc, prep, '', '', det, 'Allh', f.out.a, f.out.kind, f.out.r, 0 FROM ndet n JOIN nfin f ON f.id = n.id AND f.e = n.p + 4 AND f.b = 0 WHERE starts_with({_rest("n.p")}, 'Allh')
            UNION ALL SELECT n.id, CAST(n.o AS HUGEINT) * 16 + 8, nconj, voc, prep, '', '', det, substr(n.s, n.p + 1, CAST(f.out.e - n.p AS BIGINT)), f.out.a, f.out.kind, f.out.r, f.out.b FROM nderiv n JOIN nroot f ON f.id = n.id AND f.p = n.root""",
        "nn": "SELECT id, unnest(arg_min({'nconj': nconj, 'voc': voc, 'prep': prep, 'px': px, 'name': name, 'det': det, 'stem': stem, 'agree': agree, 'kind': kind, 'r': r}, o)) FROM ncand GROUP BY id",
        "vconj": f"SELECT id, s, left(s, 1) AS vconj, 1 AS p, 0 AS o FROM mwords WHERE left(s, 1) IN ('w', 'f') AND regexp_matches({_rest('1')}, '^{_UNITS}') UNION ALL SELECT id, s, '', 0, 1 FROM mwords",
        "vneg": f"SELECT id, s, vconj, {_at('p')} || 'A' AS neg, p + 2 AS p, 2 * o AS o FROM vconj WHERE regexp_matches({_rest('p')}, '^[ml]A...') UNION ALL SELECT id, s, vconj, '', p, 2 * o + 1 FROM vconj",
        "vint": f"SELECT id, s, vconj, neg, 'O' AS int, p + 1 AS p, 2 * o AS o FROM vneg WHERE {_at('p')} = 'O' UNION ALL SELECT id, s, vconj, neg, '', p, 2 * o + 1 FROM vneg",
        "vfut": f"SELECT id, s, vconj, neg, int, {_at('p')} AS fut, p + 1 AS p, 2 * o AS o FROM vint WHERE {_at('p')} IN ('s', 'H', 'h', 'b') UNION ALL SELECT id, s, vconj, neg, int, '', p, 2 * o + 1 FROM vint",
        "viv": f"""SELECT id, s, vconj, neg, int, fut, left({_rest("p")}, CAST(1 + length(v) AS BIGINT)) AS iv, CASE {_at("p")} WHEN 'y' THEN 'Y' WHEN 't' THEN 'T' ELSE 'ON' END AS x, p + 1 + length(v) AS p, 4 * f.o + a.o AS o FROM vfut f, (VALUES (0, 'a'), (0, 'u'), (1, '')) a(o, v)
            WHERE ({_at("p")} IN ('O', 'y', 't') OR {_at("p")} = 'n' AND regexp_matches({_rest("p + 1")}, '^[^Awy][^Awy][^Awy]')) AND starts_with({_rest("p + 1")}, v)""",
        # Rank by the beginning, then imperatives before the rest, then with the question's letter before without, the imperfect before the past.
        "vstart": f"""SELECT id, s, vconj, neg, 'A' AS imper, '' AS int, '' AS fut, '' AS iv, 'IMP' AS x, p + 1 AS p, o * 1000 AS o FROM vneg WHERE {_at("p")} = 'A'
            UNION ALL SELECT id, s, vconj, neg, '', int, fut, iv, x, p, (o // 16) * 1000 + 100 + ((o // 8) % 2) * 100 + (o % 8) FROM viv
            UNION ALL SELECT id, s, vconj, neg, '', int, '', '', 'PAST', p, (o // 2) * 1000 + 100 + (o % 2) * 100 + 50 FROM vint""",
        "vderiv": f"""SELECT v.*, p + length(d) AS root, v.o * 8 + x.o AS ro FROM (SELECT *, {_rest("p")} AS rest, CASE WHEN p > 0 THEN {_at("p - 1")} ELSE '' END AS before FROM vstart) v, (VALUES (0, 'tu'), (1, 't.A'), (2, 'A'), (3, 'st'), (4, 'Ast'), (5, 'An'), (6, '')) x(o, d)
            WHERE CASE x.o WHEN 1 THEN regexp_matches(rest, '^t.A') WHEN 2 THEN regexp_matches(rest, '^A[^s].t') WHEN 3 THEN starts_with(rest, 'st') AND before IN ('y', 'n', 't') WHEN 4 THEN starts_with(rest, 'Ast') AND before NOT IN ('y', 'n', 't') ELSE starts_with(rest, d) END""",
        "vfin": f"""SELECT id, x, e, b, arg_min({{'e': e, 'a': a, 'r': r, 'b': b}}, o) AS out FROM (
            SELECT id, x, s, e, b, o, replace(a, '*', '') AS a, {_ended(_rest("e + length(replace(a, '*', ''))"))} AS r FROM (SELECT m.id, s, v.x, unnest(range(1, length(s) + 1)) AS e FROM mwords m JOIN (SELECT DISTINCT id, x FROM vstart) v ON v.id = m.id) m
            JOIN {_values([(x, i, a) for x, ends in _PERSONS.items() for i, a in enumerate(ends)])} g(x, o, a) USING (x), (VALUES (0), (1)) y(b)
            WHERE starts_with({_rest("e")}, replace(a, '*', '')) AND (a <> 'A*' OR regexp_matches(left(s, CAST(e AS BIGINT)), '...$') AND {_at("e - 1")} NOT IN ('n', 'h')))
            WHERE r = '' OR b = 1 AND regexp_full_match(r, '{_PRON1}') GROUP BY id, x, e, b""",
        "vexit": f"SELECT m.id, m.p, f.x, f.b, f.out FROM mletters m JOIN vfin f ON f.id = m.id AND f.e = m.p + 1 WHERE strpos('{_CA}', m.c) = 0",
        "vmore": "SELECT id, x, p, out FROM vexit WHERE b = 1",
        "vbare": "SELECT id, x, p, out FROM vexit WHERE b = 0",
    }
    for n in (2, 1, 0):
        exits, further = ("vmore", f"vlevel{n + 1}") if n else ("vbare", "vlevel1")
        parts[f"vlevel{n}"] = f"""SELECT id, x, p, arg_min(out, o) AS out FROM (SELECT id, x, p, out, CAST(-1 AS HUGEINT) AS o FROM {exits}
            UNION ALL SELECT h.id, n.x, h.p, n.out, h.o FROM hop h JOIN {further} n ON n.id = h.id AND n.p = h.q) GROUP BY id, x, p"""
    parts |= {
        "vlevel3": "SELECT id, x, p, out FROM vmore",
        "vroot": "SELECT h.id, n.x, h.p, arg_min(n.out, h.o) AS out FROM hop h JOIN vlevel0 n ON n.id = h.id AND n.p = h.q GROUP BY h.id, n.x, h.p",
        "vcand": "SELECT v.id, v.ro AS o, vconj, neg, imper, int, fut, iv, substr(s, v.p + 1, CAST(f.out.e - v.p AS BIGINT)) AS stem, f.out.a AS person, f.out.r AS pron FROM vderiv v JOIN vroot f ON f.id = v.id AND f.x = v.x AND f.p = v.root",
        "vb": "SELECT id, unnest(arg_min({'vconj': vconj, 'neg': neg, 'imper': imper, 'int': int, 'fut': fut, 'iv': iv, 'stem': stem, 'person': person, 'pron': pron}, o)) FROM vcand GROUP BY id",
    }
    some = lambda x, tag: f"CASE WHEN {x} <> '' THEN {x} || '/{tag}' END"
    beginning = ", ".join(some(f"n.{x}", x.upper()) for x in ("nconj", "voc", "prep", "px", "name", "det"))
    ends = [f"CASE WHEN n.kind = '{k}' THEN n.r || '/{k}' END" for k in ("PRON", "ALLAH", "CASE")]
    noun = f"{beginning}, n.stem || '/NSTEM', n.agree || '/AGREE', {ends[0]}, {ends[1]}, {ends[2]}"
    snoun = f"{beginning}, n.stem || '/NSTEM', {ends[0]}, {ends[1]}"
    verb = f"{', '.join(some(f'v.{x}', x.upper()) for x in ('vconj', 'neg', 'imper', 'int', 'fut', 'iv'))}, CASE WHEN v.imper = '' AND v.iv = '' THEN '/PV' END, v.stem || '/VSTEM', v.person || '/PERSON', {some('v.pron', 'PRON1')}"
    sverb = f"{some('v.vconj', 'VCONJ')}, {some('v.neg', 'NEG')}, v.stem || '/VSTEM', {some('v.pron', 'PRON1')}"
    listed = lambda x, of: f"CASE WHEN {of} IS NOT NULL THEN list_filter([{x}], lambda y: y IS NOT NULL) END"
    parts["analysed"] = f"""SELECT m.word, m.s, {listed(noun, "n.id")} AS noun, {listed(verb, "v.id")} AS verb, {listed(snoun, "n.id")} AS snoun, {listed(sverb, "v.id")} AS sverb,
        n.stem AS nstem, v.stem AS vstem, n.id IS NOT NULL AND (v.id IS NULL OR n.stem IS NULL OR length(v.stem) >= length(n.stem)) AS as_noun
        FROM mwords m LEFT JOIN nn n ON n.id = m.id LEFT JOIN vb v ON v.id = m.id"""
    # A word is cut into units, a letter with the sukuns behind it (those before the first belong to it), which the parts get by their lengths.
    parts["mcut"] = """SELECT *, list_transform(list_filter(CASE WHEN as_noun THEN snoun ELSE sverb END, lambda y: true), lambda y: CASE WHEN ends_with(y, 'STEM') THEN -1 ELSE length(y) - length(regexp_extract(y, '/[A-Z0-9]+$')) END) AS sizes,
        CASE WHEN as_noun THEN nstem ELSE vstem END AS mstem, regexp_extract_all(word, '^o*[^o]o*|[^o]o*') AS units FROM analysed"""
    parts["msized"] = """SELECT *, list_transform(list_filter(sizes, lambda n, i: n <> 0 OR i < list_position(sizes, -1)), lambda n: CASE WHEN n = -1 THEN len(units) - (list_sum(sizes) + 1) ELSE n END) AS taken FROM mcut"""
    parts["segmented"] = """SELECT word, CASE WHEN mstem IS NULL THEN [word] ELSE list_transform(taken, lambda n, i: array_to_string(list_slice(units, CAST(list_sum(list_slice(taken, 1, i)) - n + 1 AS BIGINT), CAST(list_sum(list_slice(taken, 1, i)) AS BIGINT)), '')) END AS segments FROM msized"""
    return parts
