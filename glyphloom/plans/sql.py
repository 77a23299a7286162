"""The catalog's queries in SQL for a second engine: named parts, of which each query takes those that it needs."""

from __future__ import annotations

import re

from glyphloom.operators.tune import grid_values

_WS = r"[ \t\n\x0B\f\r]"
_SOLID = r"[^ \t\n\x0B\f\r]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _mentions(x: str) -> str:
    return rf"regexp_replace({x}, '{_WS}*((rt{_WS}*)?@{_SOLID}+)+', '', 'g')"


def _emojis(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([^\x{{0000}}-\x{{0100}}])', ' \1 ', 'g'), ' +', ' ', 'g')"


_LINE = rf"replace(replace({_strip("coalesce(text, '')")}, '=', ''), '\n', ' ')"
_CLEAN = _strip(_mentions("lower(" + _strip(_mentions(_strip(_emojis(_LINE)))) + ")"))
_PUNCT = rf"""[/'',!#$%()*\[\]+:;=@`"\-]|\.+|[0-9]+|&{_SOLID}*"""
_FUSED = "CASE t WHEN 'cannot' THEN ['can', 'not'] WHEN 'gonna' THEN ['gon', 'na'] WHEN 'gotta' THEN ['got', 'ta'] WHEN 'wanna' THEN ['wan', 'na'] WHEN 'gimme' THEN ['gim', 'me'] WHEN 'lemme' THEN ['lem', 'me'] ELSE [t] END"
_GRID = ", ".join(f"({t!r}{'' if 'e' in repr(t) else 'e0'})" for t in grid_values())

PARTS = {
    "clean": f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents",
    "lists": rf"""SELECT doc_id, flatten(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(cleaned, '{_PUNCT}', ' ', 'g'), '([?<>{{}}])', ' \1 ', 'g'), '{_WS}+'),
        lambda t: t <> ''), lambda t: {_FUSED})) AS toks FROM clean""",
    "tok": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, toks[i] AS token FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM lists)",
    "counted": "SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL",
    "tf": "SELECT doc_id, token, n, n / (sum(n) OVER (PARTITION BY doc_id)) AS tf FROM counted",
    "df": "SELECT token, count(*) AS df FROM counted GROUP BY token",
    "vocab": "SELECT token, df, 1.0e0 / df AS idf FROM df WHERE df > 1",
    "weights": "SELECT doc_id, token, n, tf, df, tf * idf AS w FROM tf JOIN vocab USING (token)",
    "sizes": "SELECT doc_id, sqrt(sum(tf * tf)) AS size FROM tf GROUP BY doc_id",
    "gold": "SELECT doc_id, 'quality' AS label, quality AS gs FROM labels JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'toxic', toxic FROM labels JOIN documents USING (doc_id)",
    "ldocs": "SELECT doc_id FROM labels JOIN documents USING (doc_id)",
    "lcounted": "SELECT * FROM counted SEMI JOIN ldocs USING (doc_id)",
    "ltok": "SELECT * FROM tok SEMI JOIN ldocs USING (doc_id)",
    "posted": "SELECT token, label, doc_id, n FROM lcounted JOIN gold USING (doc_id) WHERE gs = 1",
    "cnt": "SELECT label, token, CAST(sum(n * CASE WHEN unicode(token) > 3000 THEN 2 ELSE 1 END) AS BIGINT) AS cnt FROM posted GROUP BY label, token",
    "words": "SELECT token FROM lcounted GROUP BY token HAVING count(*) > 1 ORDER BY count(*) DESC, token LIMIT 2500",
    "shares": "SELECT label, token, cnt / (sum(cnt) OVER (PARTITION BY label)) AS p FROM cnt",
    "lgrid": "SELECT token, label, coalesce(p, 0.0e0) AS p FROM words CROSS JOIN (SELECT DISTINCT label FROM gold) LEFT JOIN shares USING (token, label)",
    "q": "SELECT token, label, p / s AS q FROM (SELECT *, sum(p) OVER (PARTITION BY token) AS s FROM lgrid) WHERE s > 0",
    "d": "SELECT token, label, q, q - avg(q) OVER (PARTITION BY token) AS d FROM q",
    "lex": "SELECT token, label, round(d * (avg(abs(d)) OVER (PARTITION BY token) * 1000.0e0), 6) + 0.0e0 AS weight FROM d",
    "summed": "SELECT doc_id, label, CAST(sum(CAST(weight AS DECIMAL(18, 6)) * n) AS DOUBLE) AS s FROM lcounted JOIN lex USING (token) GROUP BY ALL",
    "scored": "SELECT doc_id, label, coalesce(s, 0.0e0) AS s, max(coalesce(s, 0.0e0)) OVER (PARTITION BY doc_id) AS m FROM ldocs CROSS JOIN (SELECT DISTINCT label FROM lex) LEFT JOIN summed USING (doc_id, label)",
    "ratios": "SELECT doc_id, label, m, CASE WHEN m > 0 THEN s / m ELSE 0.0e0 END AS ratio FROM scored",
    "said": "SELECT doc_id, label, ratio, CAST(m > 0 AND ratio >= 0.3e0 AS INTEGER) AS decision FROM ratios",
    "conf": """SELECT label, count(*) FILTER (decision = 1 AND gs = 1) AS tp, count(*) FILTER (decision = 1 AND gs = 0) AS fp,
        count(*) FILTER (decision = 0 AND gs = 1) AS fn, count(*) FILTER (decision = 0 AND gs = 0) AS tn FROM said JOIN gold USING (doc_id, label) GROUP BY label""",
    "errs": "SELECT label, token, CAST(sum(n * CASE WHEN gs = 1 THEN 1 ELSE -1 END) AS BIGINT) AS err FROM lcounted JOIN said USING (doc_id) JOIN gold USING (doc_id, label) WHERE decision = 1 GROUP BY label, token",
    "grid": f"SELECT * FROM (VALUES {_GRID}) g(threshold)",
    "swept": """SELECT label, threshold, count(*) FILTER (x AND gs = 1) AS tp, count(*) FILTER (x AND gs = 0) AS fp, count(*) FILTER (NOT x AND gs = 1) AS fn, count(*) FILTER (NOT x AND gs = 0) AS tn
        FROM (SELECT label, threshold, gs, m > 0 AND ratio >= threshold AS x FROM ratios JOIN gold USING (doc_id, label) CROSS JOIN grid) GROUP BY label, threshold""",
    "curve": """SELECT label, threshold, CASE WHEN ok THEN round(p, 9) ELSE 0 END AS p, CASE WHEN ok THEN round(r, 9) ELSE 0 END AS r,
        CASE WHEN ok THEN round(2.0e0 * p * r / (p + r), 9) ELSE 0 END AS f, CASE WHEN ok THEN round(j, 9) ELSE 0 END AS j
        FROM (SELECT *, coalesce(p + r > 0 AND isfinite(p + r), false) AS ok FROM (SELECT label, threshold, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, tp / nullif(tp + fp + fn, 0) AS j FROM swept))""",
}


_WRITTEN = r"CAST(doc_id AS VARCHAR) || chr(9) || replace(replace(coalesce(text, ''), chr(10), '\n'), chr(9), ' ') || chr(9) || quality || chr(9) || toxic"
_READ = _strip(_emojis(rf"replace(replace({_strip(_WRITTEN)}, '=', ''), '\n', ' ')"))
TSV = f"""SELECT c[1] AS doc_id, {_strip(_mentions("c[2]"))} AS text, [CAST({_strip("c[3]")} AS INTEGER), CAST({_strip("c[4]")} AS INTEGER)] AS gs
    FROM (SELECT string_split({_READ}, chr(9)) AS c FROM documents JOIN labels USING (doc_id))"""


def arabic_parts(arabic: str, bw: str, segmented: dict[str, str]) -> dict[str, str]:
    """The labelled corpus, written in Arabic script under a header and read again: its tokens are the segments of its words. `segmented` has the segments of awords."""
    script = lambda x, a, b: f"translate({x}, '{a}', '{b}')"
    line = rf"replace(replace({_strip(_WRITTEN.replace("coalesce(text, '')", script("coalesce(text, '')", bw, arabic)))}, '=', ''), '\n', ' ')"
    read = _strip(_emojis(rf"regexp_replace(regexp_replace({script(line, arabic, bw)}, '_|#|\.+', ' ', 'g'), ' +', ' ', 'g')"))
    return {
        "aread": f"SELECT c[1] AS doc_id, {_strip(_mentions('c[2]'))} AS text, [CAST({_strip('c[3]')} AS INTEGER), CAST({_strip('c[4]')} AS INTEGER)] AS gs FROM (SELECT string_split({read}, chr(9)) AS c FROM documents JOIN labels USING (doc_id))",
        "aplaced": f"SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{_WS}+') AS w FROM aread)) WHERE w[i] <> ''",
        "awords": "SELECT DISTINCT word FROM aplaced",
        "atok": "SELECT * FROM (SELECT doc_id, unnest(segments) AS token FROM aplaced JOIN segmented USING (word)) WHERE token <> ''",
        "counted": "SELECT doc_id, token, count(*) AS n FROM atok GROUP BY ALL",
        "ldocs": "SELECT doc_id FROM aread",
        "gold": "SELECT doc_id, 'quality' AS label, gs[1] AS gs FROM aread UNION ALL SELECT doc_id, 'toxic', gs[2] FROM aread",
    } | segmented


def assemble(final: str, **own: str) -> str:
    """final behind a WITH of the parts that it names, and those that they name."""
    parts, used, open_ = PARTS | own, [], set()

    def need(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
            if name in parts and name not in used and name not in open_:
                open_.add(name)
                need(parts[name])
                used.append(name)

    need(final)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if 'UNION ALL SELECT r.' in parts[n] else 'MATERIALIZED '}({parts[n]})" for n in used) + "\n" + final if used else final


#: What is said, wrong and swept of a lexicon; rounds() has these for each lexicon in turn.
_OF_LEX = ("summed", "scored", "ratios", "said", "errs", "swept", "curve")


def _named(text: str, names: dict[str, str]) -> str:
    return re.sub(r"\b(FROM|JOIN)(\s+)(\w+)", lambda m: m[1] + m[2] + names.get(m[3], m[3]), text)


def corrections(count: int, threshold: str) -> dict[str, str]:
    """lex0 is lex; lex1 and so on are each corrected by the decisions of the one before at a fixed threshold; removed1 and so on count what that took."""
    made = {"lex0": "SELECT * FROM lex"}
    for i in range(1, count + 1):
        names = {x: f"{x}{i}" for x in _OF_LEX} | {"lex": f"lex{i - 1}"}
        made |= {f"{x}{i}": _named(PARTS[x], names) for x in _OF_LEX[:5]}
        made[f"said{i}"] = made[f"said{i}"].replace("0.3e0", threshold)
        made[f"lex{i}"] = f"SELECT l.token, l.label, CASE WHEN err < 0 AND weight > 0 THEN 0.0e0 ELSE weight END AS weight FROM lex{i - 1} l LEFT JOIN errs{i} ON l.token = errs{i}.token AND l.label = errs{i}.label"
        made[f"removed{i}"] = f"SELECT count(*) AS removed FROM lex{i - 1} JOIN errs{i} USING (label, token) WHERE err < 0 AND weight > 0"
    return made


def tuned(count: int, threshold: str) -> dict[str, str]:
    """limits0 has the threshold for every label; each round corrects the lexicon at the limits before it and sweeps new ones: lex1 and limits1, and so on."""
    made = {"lex0": "SELECT * FROM lex", "limits0": f"SELECT DISTINCT label, {threshold} AS threshold FROM lex"}
    for i in range(1, count + 1):
        old, new = {x: f"{x}{i}a" for x in _OF_LEX} | {"lex": f"lex{i - 1}"}, {x: f"{x}{i}b" for x in _OF_LEX} | {"lex": f"lex{i}"}
        made |= {f"{x}{i}a": _named(PARTS[x], old) for x in ("summed", "scored", "ratios", "errs")}
        made[f"said{i}a"] = f"SELECT doc_id, label, ratio, CAST(m > 0 AND ratio >= threshold AS INTEGER) AS decision FROM ratios{i}a JOIN limits{i - 1} USING (label)"
        made[f"lex{i}"] = f"SELECT l.token, l.label, CASE WHEN err < 0 AND weight > 0 THEN 0.0e0 ELSE weight END AS weight FROM lex{i - 1} l LEFT JOIN errs{i}a ON l.token = errs{i}a.token AND l.label = errs{i}a.label"
        made |= {f"{x}{i}b": _named(PARTS[x], new) for x in ("summed", "scored", "ratios", "swept", "curve")}
        made[f"limits{i}"] = f"SELECT label, CASE WHEN max(j) > 0 THEN first(threshold ORDER BY j DESC, threshold DESC) ELSE 1.0e0 END AS threshold FROM curve{i}b GROUP BY label"
    return made


def trained_and_tested(rounds: int, threshold: str) -> dict[str, str]:
    """tested: decisions on a fifth of the labelled documents of a lexicon that is learnt and tuned on the others."""
    made = {
        "ltrain": "SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE doc_id % 5 <> 0",
        "ltest": "SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE doc_id % 5 = 0",
        "allgold": PARTS["gold"],
        "gold": "SELECT * FROM allgold SEMI JOIN ltrain USING (doc_id)",
        "ldocs": "SELECT doc_id FROM ltrain",
    } | tuned(rounds, threshold)
    last = {"lex": f"lex{rounds}", "ldocs": "ltest", "lcounted": "tcounted", "summed": "tsummed", "scored": "tscored", "gold": "allgold"}
    made["tcounted"] = "SELECT * FROM counted SEMI JOIN ltest USING (doc_id)"
    made |= {f"t{x}": _named(PARTS[x], last) for x in ("summed", "scored", "ratios")}
    made["tested"] = f"SELECT doc_id, label, CAST(m > 0 AND ratio >= threshold AS INTEGER) AS decision FROM tratios JOIN limits{rounds} USING (label)"
    made["tconf"] = _named(PARTS["conf"], {"said": "tested", "gold": "allgold"})
    return made


def _prefix(a: str, b: str) -> str:
    """How many first elements two lists share."""
    return f"coalesce(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i]), false) - 1, least(len({a}), len({b})))"


def _less(a: str, k: str) -> str:
    """A list without the element after its first k."""
    return f"list_concat({a}[:{k}], {a}[{k} + 2:])"


#: A fold over the documents in the order of their tokens; the first document of the open group goes along. Lists are two edits apart where one is the other with two
#: tokens more, or they agree once each has lost one: it is the first that differs that one of them loses first.
NEAR = {
    "ordered": "SELECT doc_id, toks, row_number() OVER (ORDER BY toks, doc_id) AS n FROM lists",
    "folded": f"""SELECT n, doc_id AS group_id, toks AS head, doc_id, toks FROM ordered WHERE n = 1
        UNION ALL SELECT r.n, CASE WHEN near THEN r.group_id ELSE r.doc_id END, CASE WHEN near THEN r.y ELSE r.x END, r.doc_id, r.x FROM (
        SELECT *, x = y OR (len(x) = len(y) AND ({_less("y", "pa")} = x1 OR {_less("x", "pb")} = y1)) OR (len(x) = len(y) + 2 AND {_less("x1", "pa")} = y) OR (len(y) = len(x) + 2 AND {_less("y1", "pb")} = x) AS near FROM (
        SELECT *, {_prefix("x1", "y")} AS pa, {_prefix("x", "y1")} AS pb FROM (
        SELECT *, {_less("x", "p")} AS x1, {_less("y", "p")} AS y1 FROM (
        SELECT o.n, o.doc_id, f.group_id, o.toks AS x, f.head AS y, {_prefix("o.toks", "f.head")} AS p FROM folded f JOIN ordered o ON o.n = f.n + 1)))) r""",
}


def measured(source: str, by: str = "") -> str:
    """prfj of the sums of tp, fp and fn of a source."""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    pick = lambda x: f"CASE WHEN tp > 0 THEN round({x}, 9) ELSE 0.0e0 END"
    return f"""SELECT {keys}{pick("tp / (tp + fp)")} AS p, {pick("tp / (tp + fn)")} AS r, {pick("2.0e0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))")} AS f, {pick("tp / (tp + fp + fn)")} AS j
        FROM (SELECT {keys}CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn FROM {source} {group})"""
