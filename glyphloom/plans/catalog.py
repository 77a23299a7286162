"""Named queries over the driver's tables, with the SQL that a second engine answers them by.

The labelled corpus is documents with labels: two labels, quality and toxic. lexicon_lang learns the four languages from all documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import text as T
from glyphloom.operators import classify, duplicates, features, lexicon, lsa, measure, morphology, tune
from glyphloom.sources import corpora, reports, workbooks
from glyphloom.storage import dropped, scratch, spread, written
from glyphloom.streaming import service

from . import words as W
from .analyses import analyses
from .sql import NEAR, PARTS, TSV, arabic_parts, assemble, corrections, measured, trained_and_tested as tested_parts, tuned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LABELS = ["quality", "toxic"]
LANGUAGES = ["de", "en", "es", "fr"]
TOP, THRESHOLD = 2500, 0.3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def all_tokens(spark: SparkSession, d: str) -> DataFrame:
    return features.tokens(documents(spark, d))


def all_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.counts(documents(spark, d))


class Labelled:
    """The labelled corpus: ids, tokens, term counts and gold labels. Counts and lexicons are written once, as several steps read them."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", *LABELS)
        self.docs = documents(spark, d).join(labels.select("doc_id"), "doc_id", "left_semi")
        self.tok = features.tokens(self.docs)
        self.gold = features.gold(labels.join(documents(spark, d).select("doc_id"), "doc_id", "left_semi"), LABELS)

    @cached_property
    def counts(self) -> DataFrame:
        return written(features.counts(self.docs).select("doc_id", "token", "n"), "counts")

    def lexicon(self, kind: str = "FULL") -> DataFrame:
        return lexicon.learn(self.counts, self.gold, TOP, kind)

    @cached_property
    def lex(self) -> DataFrame:
        return written(self.lexicon(), "lexicon")

    @cached_property
    def scored(self) -> DataFrame:
        return written(classify.scores(self.docs, self.counts, self.lex, LABELS), "scores")

    def said(self) -> DataFrame:
        return classify.decide(self.scored, THRESHOLD)

    def swept(self) -> DataFrame:
        return tune.swept(self.scored, self.gold, tune.grid(self.docs.sparkSession))


# ------------------------------------------------------------------ text


@query(assemble("SELECT doc_id, cleaned FROM clean"))
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    plain = T.strip(T.strip_mentions(T.strip(T.split_emojis(T.clean_line(F.coalesce("text", F.lit("")))))))
    return documents(spark, d).select("doc_id", T.strip(T.strip_mentions(F.lower(plain))).alias("cleaned"))


@query(assemble("SELECT doc_id, pos, token FROM tok"))
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return all_tokens(spark, d)


@query(
    assemble(
        "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM pairs)",
        pairs="SELECT doc_id, flatten(list_transform(toks, lambda t, i: CASE WHEN i > 1 THEN [t, toks[i - 1] || '-' || t] ELSE [t] END)) AS w FROM lists",
    )
)
def bigrams(spark: SparkSession, d: str) -> DataFrame:
    return features.bigram_tokens(documents(spark, d))


#: Texts with what the documents may lack; they come before these, under ids below 0.
_SAMPLES = ["I am ok @bob rt @al yes", "so happy\U0001f602!", "’x中\U0001f602\U0001f600 \U0001f602", "mud~o", "~ab~", ">o<&a", "aab  bbb", "", "http//t.co/x #a:b", "وكتبها", "مُدِّ", "كتب_كتاب... #و"]
_EDGED = "SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"(CAST({n - len(_SAMPLES)} AS BIGINT), '{x}')" for n, x in enumerate(_SAMPLES)) + ") v(doc_id, text)"
_EDGED_PARTS = {"edged": _EDGED, "clean": PARTS["clean"].replace("FROM documents", "FROM edged"), "words_in_use": "SELECT DISTINCT token AS s FROM (SELECT token FROM tok UNION ALL SELECT text FROM edged WHERE doc_id < 0)"}
_BW = T.BUCKWALTER.replace("'", "''")
_SHADDAS = """list_reduce(list_concat([''], list_filter(string_split({}, ''), lambda c: c <> '')), lambda made, c: CASE WHEN c = 'o' THEN made WHEN c = '~' AND made <> '' THEN made || right(made, 1) ELSE made || c END)"""


def edged(spark: SparkSession, d: str) -> DataFrame:
    """All documents, and the samples."""
    rows = documents(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.unionByName(spark.createDataFrame([(n - len(_SAMPLES), x) for n, x in enumerate(_SAMPLES)], "doc_id long, text string"))


def words_in_use(spark: SparkSession, d: str) -> DataFrame:
    """s: the different tokens of edged(), and the samples as they are."""
    rows = edged(spark, d)
    return features.tokens(rows).select(F.col("token").alias("s")).unionByName(rows.where("doc_id < 0").select(F.col("text").alias("s"))).distinct()


@query(
    assemble(
        r"""SELECT doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]*((rt[ \t\n\x0B\f\r]*)?@[^ \t\n\x0B\f\r]+)+', '', 'g') AS unmentioned,
        regexp_replace(regexp_replace(text, '([^\x{0000}-\x{0100}])', ' \1 ', 'g'), ' +', ' ', 'g') AS spaced, regexp_replace(text, '//t\.co/[^ \t\n\x0B\f\r]*|http|#|:', '', 'g') AS unlinked,
        regexp_replace(regexp_replace(translate(text, '"""
        + f"{T.ARABIC}', '{_BW}"
        + r"""'), '_|#|\.+', ' ', 'g'), ' +', ' ', 'g') AS arabic FROM edged""",
        **_EDGED_PARTS,
    )
)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("text")
    return edged(spark, d).select("doc_id", T.strip_mentions(s).alias("unmentioned"), T.split_emojis(s).alias("spaced"), T.strip_urls(s).alias("unlinked"), T.clean_arabic(s).alias("arabic"))


@query(
    assemble(
        f"""SELECT s, CASE WHEN s = '' THEN false ELSE unicode(s) > 3000 END AS emoji, translate(s, '><&o', 'OIW') AS matchable, CASE WHEN s = '' OR unicode(s) < 256 THEN translate(s, '{_BW}', '{T.ARABIC}') ELSE s END AS displayed,
        list_reduce(list_concat([''], list_filter(string_split(s, ''), lambda c: c <> '')), lambda made, c: CASE WHEN made <> '' AND right(made, 1) = c THEN made ELSE made || c END) AS collapsed FROM words_in_use""",
        **_EDGED_PARTS,
    )
)
def word_functions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    return words_in_use(spark, d).select("s", T.is_emoji(s).alias("emoji"), T.matchable(s).alias("matchable"), T.displayed(s, True).alias("displayed"), T.collapse_repeats(s).alias("collapsed"))


@query(assemble(f"SELECT s, {_SHADDAS.format('s')} AS spelled FROM words_in_use", **_EDGED_PARTS))
def shaddas(spark: SparkSession, d: str) -> DataFrame:
    return words_in_use(spark, d).select("s", T.shaddas(F.col("s")).alias("spelled"))


@query(assemble(f"SELECT s, translate(s, '{T.ARABIC}', '{_BW}') AS bw, translate(translate(s, '{T.ARABIC}', '{_BW}'), '{_BW}', '{T.ARABIC}') AS back FROM words_in_use", **_EDGED_PARTS))
def transliteration(spark: SparkSession, d: str) -> DataFrame:
    bw = T.to_buckwalter(F.col("s"))
    return words_in_use(spark, d).select("s", bw.alias("bw"), T.to_arabic(bw).alias("back"))


@query(
    assemble(
        "SELECT doc_id, pos, coalesce(surrogate, token) AS token FROM tok LEFT JOIN surrogates USING (token)",
        emojis="SELECT token, min(struct_pack(d := doc_id, p := pos)) AS place FROM tok WHERE token <> '' AND unicode(token) > 3000 GROUP BY token",
        surrogates="SELECT token, 'eMJ' || (row_number() OVER (ORDER BY place) - 1) AS surrogate FROM emojis",
        **_EDGED_PARTS,
    )
)
def emoji_surrogates(spark: SparkSession, d: str) -> DataFrame:
    tok = features.tokens(edged(spark, d))
    return features.with_surrogates(tok, features.emoji_surrogates(tok))


_TAGS = ["NN", "NNS", "VB", "VBD", "XX"]


def gold_lines(spark: SparkSession, d: str) -> str:
    """A folder of gold standard files, two head lines in each, of the documents' tokens in Arabic script; each line comes twice."""
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), F.length("token") % len(_TAGS) + 1)
    line = F.concat_ws(",", T.to_arabic(F.col("token")), tag, F.length("token").cast("string"))
    rows = different_tokens(spark, d).select(F.pmod(F.xxhash64("token"), F.lit(4)).alias("p"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part"), line.alias("value"))
    heads = spark.range(4).select(F.col("id").alias("p"), F.explode(F.array(F.lit(0), F.lit(0))).alias("part"), F.lit("form,NN").alias("value"))
    path = scratch(spark, "gold")
    rows.unionByName(heads).repartition(4, "p").sortWithinPartitions("p", "part").select("p", "value").write.partitionBy("p").text(path)
    return path


@query(
    assemble(
        f"SELECT DISTINCT form, tag, {_SHADDAS.format('bw')} AS bw FROM gold_rows WHERE tag <> 'XX'",
        gold_rows=f"SELECT form, tag, translate(form, '{T.ARABIC}', '{_BW}') AS bw FROM (SELECT translate(token, '{_BW}', '{T.ARABIC}') AS form, {_TAGS}[1 + len(token) % {len(_TAGS)}] AS tag FROM tok) x WHERE form <> ''",
    )
)
def gold_standard(spark: SparkSession, d: str) -> DataFrame:
    return corpora.gold_standard(spark, gold_lines(spark, d)).select("form", "tag", "bw")


@query(TSV)
def labelled_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The labelled documents, written as TSV lines and read as a corpus."""
    rows = documents(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", *LABELS), "doc_id")
    path = scratch(spark, "tsv")
    corpora.write_tsv(rows, path, LABELS)
    return corpora.labelled_tsv(spark, path, labels=LABELS)[0]


@query(assemble("SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, gs FROM gold"))
def labelled_gold(spark: SparkSession, d: str) -> DataFrame:
    """The labels of the corpus that is read, by the places of their columns."""
    return corpora.gold_of(labelled_corpus(spark, d), LABELS)


# ------------------------------------------------------------------ features


@query(assemble("SELECT doc_id, token, n, tf FROM tf"))
def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return features.term_frequency(all_counts(spark, d))


@query(assemble("SELECT token, df FROM df"))
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return features.document_frequency(all_counts(spark, d))


@query(assemble("SELECT doc_id, token, n, tf, df, w FROM weights"))
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return features.tfidf(all_counts(spark, d))


@query(assemble("SELECT doc_id, token, rank, w FROM (SELECT doc_id, token, w, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, token) AS INTEGER) AS rank FROM weights) WHERE rank <= 10"))
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return features.tfidf(all_counts(spark, d), per_doc=10).select("doc_id", "token", "rank", "w")


@query(assemble("SELECT token, any_value(df) AS df, 1.0e0 / any_value(df) AS idf FROM weights GROUP BY token HAVING max(w) >= 0.001e0"))
def vocab_pruned(spark: SparkSession, d: str) -> DataFrame:
    return features.pruned_vocabulary(all_counts(spark, d), 0.001)


@query(assemble("SELECT doc_id, round(size, 9) AS size FROM sizes"))
def doc_norms(spark: SparkSession, d: str) -> DataFrame:
    return features.norms(all_counts(spark, d)).select("doc_id", F.round("size", 9).alias("size"))


@query(assemble("SELECT token, label, doc_id, n FROM posted"))
def postings(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return features.postings(x.counts, x.gold)


@query(assemble("""SELECT token, label, CAST(floor(doc_id / 1024) AS BIGINT) AS block, list(doc_id ORDER BY doc_id) AS docs FROM (SELECT token, label, doc_id, unnest(range(n)) FROM posted) GROUP BY ALL
        UNION ALL SELECT DISTINCT token, NULL, NULL, [] FROM lcounted ANTI JOIN posted USING (token)"""))
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return features.inverted_index(x.counts, x.gold)


@query(
    assemble(
        """SELECT doc_id, other_id, rank, cos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC NULLS LAST, other_id) AS INTEGER) AS rank FROM
        (SELECT q AS doc_id, o AS other_id, round(dot / nullif(a.size * b.size, 0), 9) AS cos FROM dots JOIN sizes a ON a.doc_id = q JOIN sizes b ON b.doc_id = o)) WHERE rank <= 10""",
        dots="SELECT a.doc_id AS q, b.doc_id AS o, sum(a.w * b.w) AS dot FROM weights a JOIN weights b USING (token) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL",
    )
)
def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """A search: the queries are the rows whose id is divisible by 50, against all rows."""
    queries = documents(spark, d).where("doc_id % 50 = 0")
    return features.neighbours(all_counts(spark, d), queries).select("doc_id", "other_id", "rank", "cos")


@query(assemble("SELECT doc_id, string_agg(token || ': ' || CAST(CAST(round(w, 3) AS DECIMAL(38, 3)) AS VARCHAR), ', ' ORDER BY w DESC, token) AS line FROM weights GROUP BY doc_id"))
def feature_lines(spark: SparkSession, d: str) -> DataFrame:
    """All terms of each document."""
    return reports.feature_lines(features.tfidf(all_counts(spark, d)))


# ------------------------------------------------------------------ lexicon


@query(assemble("SELECT label, token, cnt FROM cnt"))
def label_word_counts(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return lexicon.label_counts(x.counts, x.gold)


@query(assemble("SELECT label, token, cnt FROM cnt", posted=PARTS["posted"] + " AND doc_id IN (SELECT DISTINCT doc_id FROM gold ORDER BY doc_id LIMIT 50)"))
def label_word_counts_first(spark: SparkSession, d: str) -> DataFrame:
    """Of the first 50 documents, as the parameter `first` says."""
    x = Labelled(spark, d)
    return lexicon.label_counts(x.counts, x.gold, first=50)


@query(assemble("SELECT label, token, CAST(sum(cnt) AS BIGINT) AS cnt FROM cnt GROUP BY ROLLUP (label, token)"))
def label_totals_rollup(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return lexicon.label_totals(lexicon.label_counts(x.counts, x.gold))


@query(assemble("SELECT token, label, round(q, 6) + 0.0e0 AS weight FROM q"))
def lexicon_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return Labelled(spark, d).lexicon("TFIDF")


@query(assemble("SELECT token, label, round(d, 6) + 0.0e0 AS weight FROM d"))
def lexicon_dist(spark: SparkSession, d: str) -> DataFrame:
    return Labelled(spark, d).lexicon("DIST")


@query(assemble("SELECT token, label, weight FROM lex"))
def lexicon_full(spark: SparkSession, d: str) -> DataFrame:
    return Labelled(spark, d).lexicon("FULL")


@query(
    assemble(
        "SELECT token, label, weight FROM lex",
        ldocs="SELECT doc_id FROM documents",
        gold="SELECT doc_id, label, CAST(coalesce(lang = label, false) AS INTEGER) AS gs FROM documents CROSS JOIN (VALUES ('de'), ('en'), ('es'), ('fr')) l(label)",
    )
)
def lexicon_lang(spark: SparkSession, d: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"))
    counts = written(features.counts(table).select("doc_id", "token", "n"), "counts")
    return lexicon.learn(counts, features.gold_of_class(table, "lang", LANGUAGES), TOP)


@query(assemble("SELECT label, CAST(sum(CASE WHEN weight > 0 THEN CAST(weight AS DECIMAL(28, 6)) ELSE 0 END) AS DOUBLE) AS mass FROM lex GROUP BY label"))
def positive_mass(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.positive_mass(Labelled(spark, d).lexicon())


@query(
    assemble(
        "SELECT token, label, round(weight / nullif(mass * (SELECT count(*) FROM masses) / (SELECT sum(mass) FROM masses), 0), 6) AS weight FROM lex JOIN masses USING (label)",
        masses="SELECT label, CAST(sum(CASE WHEN weight > 0 THEN CAST(weight AS DECIMAL(28, 6)) ELSE 0 END) AS DOUBLE) AS mass FROM lex GROUP BY label",
    )
)
def balance(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.balance(Labelled(spark, d).lexicon())


@query(assemble("SELECT token, label, round(100.0e0 * (1.0e0 / (row_number() OVER (PARTITION BY label ORDER BY weight DESC, token) + 1) - 1.0e0 / (count(*) OVER (PARTITION BY label) + 1)), 6) AS score FROM lex"))
def reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.reciprocal_rank(Labelled(spark, d).lexicon())


@query(assemble("SELECT token, coalesce(max(weight) FILTER (label = 'quality'), 0.0e0) AS quality, coalesce(max(weight) FILTER (label = 'toxic'), 0.0e0) AS toxic FROM lex GROUP BY token"))
def lexicon_wide(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.as_rows(Labelled(spark, d).lexicon(), LABELS)


@query(assemble("SELECT token, label, weight FROM lex"))
def lexicon_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.as_columns(lexicon.as_rows(Labelled(spark, d).lexicon(), LABELS), LABELS)


@query(assemble("SELECT DISTINCT label, first_value(token) OVER (PARTITION BY label ORDER BY weight DESC, token) AS heaviest, first_value(token) OVER (PARTITION BY label ORDER BY weight, token) AS lightest FROM lex"))
def lexicon_extremes(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.extremes(Labelled(spark, d).lexicon())


_WIDE = "SELECT token, max(weight) FILTER (label = 'quality') AS a, max(weight) FILTER (label = 'toxic') AS b FROM lex GROUP BY token"


@query(assemble("SELECT concat_ws(chr(9), token, CAST(CAST(round(a, 2) AS DECIMAL(38, 2)) AS VARCHAR), CAST(CAST(round(b, 2) AS DECIMAL(38, 2)) AS VARCHAR)) AS line FROM wide", wide=_WIDE))
def lexicon_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.lexicon_lines(lexicon.as_rows(Labelled(spark, d).lexicon(), LABELS), LABELS)


@query(assemble("SELECT concat_ws(chr(9), token, CAST(CAST(round(a, 3) AS DECIMAL(38, 3)) AS VARCHAR), CAST(CAST(round(b, 3) AS DECIMAL(38, 3)) AS VARCHAR)) AS line FROM wide UNION ALL SELECT concat_ws(chr(9), '', 'quality', 'toxic')", wide=_WIDE))
def lexicon_export(spark: SparkSession, d: str) -> DataFrame:
    return reports.lexicon_export(lexicon.as_rows(Labelled(spark, d).lexicon(), LABELS), LABELS, header=True)


# ------------------------------------------------------------------ classification


@query(assemble("SELECT doc_id, label, s, m FROM scored"))
def doc_scores(spark: SparkSession, d: str) -> DataFrame:
    return Labelled(spark, d).scored


@query(assemble("SELECT doc_id, label, ratio, decision FROM said"))
def doc_decisions(spark: SparkSession, d: str) -> DataFrame:
    return Labelled(spark, d).said()


@query(assemble("SELECT concat_ws(chr(9), doc_id, CAST(CAST(round(max(s) FILTER (label = 'quality'), 2) AS DECIMAL(38, 2)) AS VARCHAR), CAST(CAST(round(max(s) FILTER (label = 'toxic'), 2) AS DECIMAL(38, 2)) AS VARCHAR)) AS line FROM scored GROUP BY doc_id UNION ALL SELECT concat_ws(chr(9), '', 'quality', 'toxic')"))
def score_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.score_lines(Labelled(spark, d).scored, LABELS, header=True)


@query(assemble("SELECT doc_id, string_agg(CAST(CAST(round(s, 2) AS DECIMAL(38, 2)) AS VARCHAR), chr(9) ORDER BY label) AS joined FROM scored GROUP BY doc_id"))
def joined_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = Labelled(spark, d).scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("label", "s"))).alias("x"))
    return rows.select("doc_id", T.joined_scores(F.col("x.s")).alias("joined"))


_EXTREMES = {
    "hits": "SELECT doc_id, label, token, pos, weight FROM ltok JOIN lex USING (token)",
    "bests": "SELECT doc_id, label, first(token ORDER BY weight DESC, pos) AS best FROM hits WHERE weight > 0 GROUP BY ALL",
    "worsts": "SELECT doc_id, label, first(token ORDER BY weight, pos) AS worst FROM hits GROUP BY ALL",
    "both_ends": "SELECT doc_id, label, best, worst FROM ldocs CROSS JOIN (SELECT DISTINCT label FROM lex) LEFT JOIN bests USING (doc_id, label) LEFT JOIN worsts USING (doc_id, label)",
}


@query(assemble("SELECT doc_id, label, best, worst FROM both_ends", **_EXTREMES))
def best_worst_word(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return classify.best_and_worst(x.docs, x.tok, x.lex).select("doc_id", "label", "best", "worst")


@query(assemble("SELECT label, tp, fp, fn, tn FROM conf"))
def confusion(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return classify.confusion(x.said(), x.gold)


@query(assemble(measured("conf")))
def prfj(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return classify.prfj(classify.confusion(x.said(), x.gold))


@query(assemble(measured("conf", "label")))
def prfj_by_label(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return classify.prfj(classify.confusion(x.said(), x.gold), "label")


@query(assemble("SELECT label, token, err FROM errs"))
def word_errors(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return classify.word_errors(x.counts, x.said(), x.gold)


@query(
    assemble(
        """SELECT doc_id, label, label || ':' || CAST(CAST(round(ratio, 2) AS DECIMAL(38, 2)) AS VARCHAR) AS cell, CASE WHEN decision = 1 AND gs = 1 THEN 'GREEN' WHEN decision = 1 THEN 'RED' WHEN gs = 1 THEN 'BLUE' ELSE 'BLACK' END AS colour, best, worst
        FROM said JOIN gold USING (doc_id, label) JOIN both_ends USING (doc_id, label)""",
        **_EXTREMES,
    )
)
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    return classify.report(x.docs, x.tok, x.lex, x.said(), x.gold)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, cell, colour, best, worst FROM (" + ORACLES["evaluation_report"] + ")")
def report_csv(spark: SparkSession, d: str) -> DataFrame:
    """evaluation_report, written as CSV and read back."""
    names, path = ["doc_id", "label", "cell", "colour", "best", "worst"], scratch(spark, "csv")
    reports.write_csv(evaluation_report(spark, d).select(*names), path)
    return spark.read.csv(path, schema=", ".join(f"{n} string" for n in names))


_EXTREMES_WEIGHED = _EXTREMES | {
    "bests": "SELECT doc_id, label, first(token ORDER BY weight DESC, pos) AS best, max(weight) AS best_weight FROM hits WHERE weight > 0 GROUP BY ALL",
    "worsts": "SELECT doc_id, label, first(token ORDER BY weight, pos) AS worst, min(weight) AS worst_weight FROM hits GROUP BY ALL",
    "texts": "SELECT doc_id, array_to_string(toks, ' ') AS said FROM lists",
    "celled": """SELECT doc_id, label, label || ':' || CAST(CAST(round(ratio, 2) AS DECIMAL(38, 2)) AS VARCHAR) AS cell, CASE WHEN decision = 1 AND gs = 1 THEN 'GREEN' WHEN decision = 1 THEN 'RED' WHEN gs = 1 THEN 'BLUE' ELSE 'BLACK' END AS colour,
        coalesce(best || ':' || CAST(CAST(round(best_weight, 2) AS DECIMAL(38, 2)) AS VARCHAR), '') AS b, coalesce(worst || ':' || CAST(CAST(round(worst_weight, 2) AS DECIMAL(38, 2)) AS VARCHAR), '') AS w
        FROM said JOIN gold USING (doc_id, label) LEFT JOIN bests USING (doc_id, label) LEFT JOIN worsts USING (doc_id, label)""",
    "lined": "SELECT doc_id, list(cell ORDER BY label) AS cell, list(colour ORDER BY label) AS colour, list(b ORDER BY label) AS b, list(w ORDER BY label) AS w FROM celled GROUP BY doc_id",
}


@query(
    assemble(
        """SELECT doc_id, line, CASE line WHEN 0 THEN list_append(cell, said) WHEN 1 THEN b WHEN 2 THEN w ELSE ['', ''] END AS cells, CASE line WHEN 0 THEN list_append(colour, 'BLACK') ELSE ['BLACK', 'BLACK'] END AS colours
        FROM lined JOIN texts USING (doc_id), (VALUES (0), (1), (2), (3)) n(line)""",
        **_EXTREMES_WEIGHED,
    )
)
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The report as a reader gets it: decisions and tokens, best words, worst words, an empty line."""
    x = Labelled(spark, d)
    return classify.report_lines(x.docs, x.tok, x.lex, x.said(), x.gold, LABELS)


@query("SELECT cells, colours FROM (" + ORACLES["report_lines"] + ")")
def report_workbook(spark: SparkSession, d: str) -> DataFrame:
    """report_lines, written as a workbook by its tasks and read back, cell by cell with its colour."""
    path = f"{scratch(spark, 'book')}.xlsx"
    workbooks.write(report_lines(spark, d).orderBy("doc_id", "line").select("cells", "colours"), path)
    return workbooks.read(spark, path).select("cells", "colours")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, cell, colour FROM (" + ORACLES["evaluation_report"] + ") WHERE colour <> 'BLACK'")
def coloured_workbook(spark: SparkSession, d: str) -> DataFrame:
    """evaluation_report as a workbook in large letters, without its black rows."""
    path = f"{scratch(spark, 'book')}.xlsx"
    workbooks.write(evaluation_report(spark, d).select("doc_id", "label", "cell", "colour"), path, drop="BLACK", size=16)
    cell = F.col("cells")
    return workbooks.read(spark, path).select(cell[0].alias("doc_id"), cell[1].alias("label"), cell[2].alias("cell"), F.col("colours")[0].alias("colour"))


_ARABIC = arabic_parts(T.ARABIC, _BW, analyses("SELECT word FROM awords"))


def arabic_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The labelled documents in Arabic script, written as TSV files with a header in each, and read as a corpus: doc_id, text, gs, labels."""
    rows = documents(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", *LABELS), "doc_id").withColumn("text", T.to_arabic(F.coalesce("text", F.lit(""))))
    path = scratch(spark, "arabic")
    corpora.write_tsv(rows, path, LABELS, header=True)
    return corpora.labelled_files(spark, path, arabic=True)


@query(assemble("SELECT doc_id, token, n FROM counted", **_ARABIC))
def arabic_counts(spark: SparkSession, d: str) -> DataFrame:
    return morphology.counts(arabic_corpus(spark, d))


@query(assemble(measured("conf"), **_ARABIC))
def arabic_prfj(spark: SparkSession, d: str) -> DataFrame:
    """An Arabic corpus from its files to its measures: the lexicon is learnt of the words' segments, and read on the same documents."""
    rows = written(arabic_corpus(spark, d), "corpus")
    counts = written(morphology.counts(rows), "counts")
    gold = corpora.gold_of(rows)
    lex = written(lexicon.learn(counts, gold, TOP), "lexicon")
    return classify.prfj(classify.confusion(classify.decide(classify.scores(rows, counts, lex, LABELS), THRESHOLD), gold))


@query(
    assemble(
        f"""SELECT concat_ws(chr(9), CASE WHEN e.token IS NOT NULL THEN e.token WHEN l.token = '' OR unicode(l.token) < 256 THEN translate(l.token, '{_BW}', '{T.ARABIC}') ELSE l.token END, CAST(CAST(round(a, 3) AS DECIMAL(38, 3)) AS VARCHAR), CAST(CAST(round(b, 3) AS DECIMAL(38, 3)) AS VARCHAR)) AS line
        FROM wide l LEFT JOIN surrogates e ON l.token = e.surrogate UNION ALL SELECT concat_ws(chr(9), '', 'quality', 'toxic')""",
        emojis="SELECT token, min(struct_pack(d := doc_id, p := pos)) AS place FROM tok WHERE token <> '' AND unicode(token) > 3000 GROUP BY token",
        surrogates="SELECT token, 'eMJ' || (row_number() OVER (ORDER BY place) - 1) AS surrogate FROM emojis",
        lcounted="SELECT doc_id, coalesce(surrogate, c.token) AS token, n FROM counted c LEFT JOIN surrogates s ON c.token = s.token SEMI JOIN ldocs USING (doc_id)",
        wide=_WIDE,
        cnt=PARTS["cnt"].replace("CASE WHEN unicode(token) > 3000 THEN 2 ELSE 1 END", "CASE WHEN regexp_matches(token, '^eMJ[0-9]+$') OR unicode(token) > 3000 THEN 2 ELSE 1 END"),
        **{"clean": PARTS["clean"].replace("FROM documents", "FROM smiling"), "smiling": "SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' \U0001f602' WHEN doc_id % 3 = 1 THEN ' ok\U0001f600' ELSE '' END AS text FROM documents"},
    )
)
def emoji_export(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon of texts with emoji, which are counted under their surrogates, exported with the emoji themselves and words in Arabic script."""
    n = F.col("doc_id") % 3
    smiling = documents(spark, d).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(n == 0, " \U0001f602").when(n == 1, " ok\U0001f600").otherwise("")))
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", *LABELS)
    tok = features.tokens(smiling)
    surrogates = written(features.emoji_surrogates(tok), "surrogates")
    mine = features.with_surrogates(features.counts(smiling.join(labels.select("doc_id"), "doc_id", "left_semi")), surrogates)
    gold = features.gold(labels.join(smiling.select("doc_id"), "doc_id", "left_semi"), LABELS)
    lex = lexicon.learn(written(mine.select("doc_id", "token", "n"), "counts"), gold, TOP)
    return reports.lexicon_export(lexicon.as_rows(lex, LABELS), LABELS, surrogates, header=True, arabic=True)


# ------------------------------------------------------------------ tuning


@query(assemble("SELECT token, label, weight FROM lex2", **corrections(2, "0.3e0")))
def selfcorrect(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds."""
    x = Labelled(spark, d)
    return tune.corrected(x.docs, x.counts, x.gold, x.lex, THRESHOLD, 2, LABELS)[0]


@query(assemble("SELECT CAST(sum(removed) AS BIGINT) AS removed FROM (SELECT removed FROM removed1 UNION ALL SELECT removed FROM removed2)", **corrections(2, "0.3e0")))
def removed_words(spark: SparkSession, d: str) -> DataFrame:
    """Of both rounds."""
    x = Labelled(spark, d)
    return tune.corrected(x.docs, x.counts, x.gold, x.lex, THRESHOLD, 2, LABELS)[1]


@query(assemble("SELECT label, threshold, tp, fp, fn, tn FROM swept"))
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return Labelled(spark, d).swept()


@query(assemble(measured("swept", "threshold")))
def sweep_prfj(spark: SparkSession, d: str) -> DataFrame:
    return classify.prfj(Labelled(spark, d).swept(), "threshold")


@query(assemble("SELECT label, CASE WHEN max(j) > 0 THEN first(threshold ORDER BY j DESC, threshold DESC) ELSE 1.0e0 END AS threshold FROM curve GROUP BY label"))
def label_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return tune.label_thresholds(Labelled(spark, d).swept())


@query(
    assemble(
        "SELECT label, first(threshold + (before - threshold) / 2 ORDER BY threshold DESC) FILTER (r > p) AS sweetspot FROM stepped GROUP BY label",
        stepped="SELECT *, lag(threshold, 1, 1.0e0) OVER (PARTITION BY label ORDER BY threshold DESC) AS before FROM curve",
    )
)
def sweetspot(spark: SparkSession, d: str) -> DataFrame:
    return tune.sweet_spot(Labelled(spark, d).swept())


@query(assemble("SELECT label, token, weight, threshold FROM lex3 JOIN limits3 USING (label)", **tuned(3, "0.15e0")))
def tuned_lexicon(spark: SparkSession, d: str) -> DataFrame:
    x = Labelled(spark, d)
    lex, thresholds = tune.tune(x.docs, x.counts, x.gold, x.lex, labels=LABELS)
    return lex.join(F.broadcast(thresholds), "label")  # a row for each label


@query(assemble(measured("tconf"), **tested_parts(3, "0.15e0")))
def trained_and_tested(spark: SparkSession, d: str) -> DataFrame:
    """Trained on four fifths of the labelled documents by their ids, tested on the others."""
    x = Labelled(spark, d)
    held = F.col("doc_id") % 5 == 0
    return tune.create_and_tune(x.docs.where(~held), x.docs.where(held), x.gold, top=TOP, labels=LABELS)


@query(
    " UNION ALL ".join(f"SELECT CAST({t!r}{'' if 'e' in repr(t) else 'e0'} AS DOUBLE) AS threshold, * FROM ({assemble(measured('tconf'), **tested_parts(1, repr(t) + ('' if 'e' in repr(t) else 'e0')))})" for t in tune.grid_values(1.0, 0.2, 0.4, True))
)
def trained_range(spark: SparkSession, d: str) -> DataFrame:
    """One round of tuning from each of two starting thresholds."""
    x = Labelled(spark, d)
    held = F.col("doc_id") % 5 == 0
    return tune.create_and_tune_range(x.docs.where(~held), x.docs.where(held), x.gold, 1.0, 0.2, 0.4, top=TOP, rounds=1, labels=LABELS)


@query(" UNION ALL ".join(f"SELECT CAST({t!r}{'' if 'e' in repr(t) else 'e0'} AS DOUBLE) AS threshold, * FROM ({assemble(measured('tconf'), **tested_parts(3, repr(t) + ('' if 'e' in repr(t) else 'e0')))})" for t in tune.grid_values(1.0, 0.0, 0.1, True)))
def trained_range_whole(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of tuning from each of eleven starting thresholds."""
    x = Labelled(spark, d)
    held = F.col("doc_id") % 5 == 0
    return tune.create_and_tune_range(x.docs.where(~held), x.docs.where(held), x.gold, top=TOP, labels=LABELS)


@query(assemble(measured("oneconf"), oneconf="SELECT * FROM conf WHERE label = 'toxic'"))
def evaluated_label(spark: SparkSession, d: str) -> DataFrame:
    """One label's measures, in shares of the greatest score of all."""
    x = Labelled(spark, d)
    return classify.evaluate(x.docs, x.tok, x.lex, x.gold, THRESHOLD, "toxic")["measures"]


# ------------------------------------------------------------------ duplicates, LSA


@query(assemble("SELECT doc_id, min(doc_id) OVER (PARTITION BY toks) AS kept_id, count(*) OVER (PARTITION BY toks) AS copies FROM lists"))
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact(documents(spark, d))


@query(assemble("SELECT doc_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY len(list_distinct(toks)) DESC, doc_id) = 1 AS kept FROM folded", **NEAR))
def near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near(documents(spark, d))


def lsa_features(spark: SparkSession, d: str) -> DataFrame:
    """The matrix's columns are the whole vocabulary, its rows all documents."""
    return features.tfidf(all_counts(spark, d)).select("doc_id", "token", "w")


def lsa_matrix(spark: SparkSession, d: str) -> DataFrame:
    """lsa_features(), written; the frequencies go when the weights are there."""
    tok = features.frequencies(all_counts(spark, d))
    rows = written(features.tfidf(tok).select("doc_id", "token", "w"), "matrix")
    dropped(tok)
    return rows


@query(assemble("SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT token FROM weights)"))
def term_index(spark: SparkSession, d: str) -> DataFrame:
    return lsa.term_index(lsa_features(spark, d))


@query()
def svd(spark: SparkSession, d: str) -> DataFrame:
    rows = lsa_matrix(spark, d)
    found = lsa.factors(rows, written(lsa.term_index(rows), "terms"), 10, vectors=False)
    return spark.createDataFrame([(i, round(float(s), 9)) for i, s in enumerate(found.s)], "i int, s double")


@query()
def svd_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    rows = lsa_matrix(spark, d)
    index = written(lsa.term_index(rows), "terms")
    return lsa.compare(rows, lsa.reconstruct(lsa.prune(lsa.factors(rows, index, 10), first=8), index, 0.0005), 0.001)


# A matrix of two rows, the labels, and a column a word has a factorisation in closed form: that of its rows' products.
_TWO_ROWS = {
    "lw": "SELECT token, max(weight) FILTER (label = 'quality') AS a, max(weight) FILTER (label = 'toxic') AS b FROM (SELECT token, label, round(q, 6) + 0.0e0 AS weight FROM q) GROUP BY token",
    "gram": "SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM lw",
    "eigen": "SELECT *, (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS hi, (aa + bb) / 2 - sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS lo FROM gram",
    "first_axis": "SELECT ab / sqrt(ab * ab + (hi - aa) ** 2) AS u, (hi - aa) / sqrt(ab * ab + (hi - aa) ** 2) AS v FROM eigen",
    "projected": "SELECT 0 AS doc_id, token, u * (u * a + v * b) AS w, a AS w0 FROM lw CROSS JOIN first_axis UNION ALL SELECT 1, token, v * (u * a + v * b), b FROM lw CROSS JOIN first_axis",
}


def label_matrix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The words' shares of each label as a matrix (doc_id, token, w) with the labels as its rows, and its term index."""
    lex = Labelled(spark, d).lexicon("TFIDF")
    rows = written(lex.select((F.col("label") == LABELS[1]).cast("long").alias("doc_id"), "token", F.col("weight").alias("w")), "matrix")
    return rows, written(lsa.term_index(rows), "terms")


@query(assemble("SELECT 0 AS i, round(sqrt(hi), 6) AS s FROM eigen UNION ALL SELECT 1, round(sqrt(lo), 6) FROM eigen", **_TWO_ROWS))
def label_svd(spark: SparkSession, d: str) -> DataFrame:
    """The singular values of the labels' matrix."""
    found = lsa.factors(*label_matrix(spark, d), 2, vectors=False)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(found.s)], "i int, s double")


@query(assemble("SELECT CAST(doc_id AS BIGINT) AS doc_id, token, round(w, 4) AS w FROM projected WHERE w > 0.3", **_TWO_ROWS))
def label_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """The labels' matrix of its first singular value alone: entries over 0.3."""
    rows, index = label_matrix(spark, d)
    return lsa.reconstruct(lsa.prune(lsa.factors(rows, index, 2), first=1), index, 0.3).withColumn("w", F.round("w", 4))


@query(assemble("SELECT CAST(doc_id AS BIGINT) AS doc_id, token, round(w, 4) AS w FROM projected WHERE w > 0.3 AND (SELECT sqrt(lo) FROM eigen) <= (SELECT sqrt(hi) FROM eigen) / 1.5", **_TWO_ROWS))
def label_reconstruct_above(spark: SparkSession, d: str) -> DataFrame:
    """As label_reconstruct, of the singular values over two thirds of the first."""
    rows, index = label_matrix(spark, d)
    made = lsa.factors(rows, index, 2)
    return lsa.reconstruct(lsa.prune(made, above=float(made.s[0]) / 1.5), index, 0.3).withColumn("w", F.round("w", 4))


# ------------------------------------------------------------------ morphology, service


def different_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the documents, read as Buckwalter words."""
    return all_tokens(spark, d).select("token").distinct()


_TOKENS = analyses("SELECT token AS word FROM tok")


@query(assemble("SELECT word AS token, coalesce(noun, verb) AS analysis FROM analysed", **_TOKENS))
def morphology_lookup(spark: SparkSession, d: str) -> DataFrame:
    pairs = morphology.lookup_either(F.col("token"), "NN", "VB")
    return different_tokens(spark, d).select("token", morphology.all_shown(pairs).alias("analysis"))


@query(assemble("SELECT count(*) AS words, count(coalesce(noun, verb)) AS analysed, CAST(sum(len(coalesce(noun, verb))) AS BIGINT) AS parts FROM analysed", **_TOKENS))
def lookup_observed(spark: SparkSession, d: str) -> DataFrame:
    """What a run of morphology_lookup says of itself, beside its rate: words, those with an analysis, and their parts."""
    seen = measure.timed(morphology_lookup(spark, d), "lookup", analysed=F.count("analysis"), parts=F.sum(F.size("analysis")).cast("long"))
    return spark.createDataFrame([(seen["rows"], seen["analysed"], seen["parts"])], "words long, analysed long, parts long")


@query(assemble("SELECT word AS token, segments FROM segmented", **_TOKENS))
def stem_words(spark: SparkSession, d: str) -> DataFrame:
    return different_tokens(spark, d).select("token", morphology.stem_word(F.col("token")).alias("segments"))


def _stemmed(requests: str) -> str:
    """SQL of value and answer of a query of requests (value)."""
    return assemble(
        f"SELECT value, translate(string_agg(array_to_string(segments, ' '), ' ' ORDER BY i), '{_BW}', '{T.ARABIC}') AS answer FROM placed JOIN segmented USING (word) GROUP BY n, value",
        requests=f"SELECT row_number() OVER () AS n, value FROM ({requests}) x",
        placed=f"SELECT n, value, i, w[i] AS word FROM (SELECT n, value, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT n, value, string_split(translate(value, '{T.ARABIC}', '{_BW}'), ' ') AS w FROM requests))",
        **analyses("SELECT word FROM placed"),
    )


@query(_stemmed("SELECT coalesce(text, '') AS value FROM conversations"))
def stemmed_requests(spark: SparkSession, d: str) -> DataFrame:
    """The service's answers to all turns of the conversations."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.coalesce("text", F.lit("")).alias("value"))
    return morphology.stem_texts(service.answers(turns))


_GOLD = {
    "gold_rows": f"SELECT form, tag, translate(form, '{T.ARABIC}', '{_BW}') AS raw FROM (SELECT translate(token, '{_BW}', '{T.ARABIC}') AS form, {_TAGS}[1 + len(token) % {len(_TAGS)}] AS tag FROM tok) x WHERE form <> ''",
    "gold_words": f"SELECT DISTINCT form, tag, {_SHADDAS.format('raw')} AS bw FROM gold_rows WHERE starts_with(tag, 'NN') OR tag = 'VB'",
    "gold_analysed": "SELECT form, tag, bw, CASE WHEN tag = 'VB' THEN coalesce(verb, noun) ELSE coalesce(noun, verb) END AS analysis FROM gold_words JOIN analysed ON bw = word",
    **analyses("SELECT bw AS word FROM gold_words"),
}


@query(assemble("SELECT form, tag, bw, 'main' AS source, analysis, CAST(NULL AS VARCHAR) AS root FROM gold_analysed", **_GOLD))
def gold_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The gold standard's words with their analyses, as form/tag, and the pair that names a root."""
    done = morphology.lookup_all(corpora.gold_standard(spark, gold_lines(spark, d)))
    pairs = morphology.not_empty(F.col("analysis"))
    return done.select("form", "tag", "bw", "source", morphology.all_shown(pairs).alias("analysis"), morphology.root(F.col("analysis"))["form"].alias("root"))


@query(assemble("SELECT segment, count(*) AS size, list(form ORDER BY form, tag, bw)[:20] AS words FROM (SELECT DISTINCT segment, form, tag, bw FROM (SELECT form, tag, bw, unnest(analysis) AS segment FROM gold_analysed)) GROUP BY segment", **_GOLD))
def segment_index(spark: SparkSession, d: str) -> DataFrame:
    """Each segment of the gold standard's words with its number of words and the first of them."""
    return morphology.show_index(morphology.index_by_segment(morphology.lookup_all(corpora.gold_standard(spark, gold_lines(spark, d)))))


# The documents' tokens between Arabic affixes, by their length, and words in which all rules of the grammar come to bear.

_LISTED = ", ".join("('" + w.replace("'", "''") + "')" for w in W.words())
_AFFIXED = {
    "affixed": f"SELECT DISTINCT word FROM (SELECT {list(W.BEFORE)!r}[1 + len(token) % {len(W.BEFORE)}] || token || {list(W.AFTER)!r}[1 + len(token) % {len(W.AFTER)}] AS word FROM tok UNION ALL SELECT * FROM (VALUES {_LISTED}) v(word))",
    **analyses("SELECT word FROM affixed"),
}


def grammar_words(spark: SparkSession, d: str) -> DataFrame:
    """word"""
    affix = lambda some: F.element_at(F.array(*map(F.lit, some)), F.length("token") % len(some) + 1)
    made = different_tokens(spark, d).select(F.concat(affix(W.BEFORE), F.col("token"), affix(W.AFTER)).alias("word"))
    return made.unionByName(spark.createDataFrame([(w,) for w in W.words()], "word string")).distinct()


@query(assemble("SELECT word, coalesce(noun, verb) AS as_noun, coalesce(verb, noun) AS as_verb, len(coalesce(noun, verb)) AS parts FROM analysed", **_AFFIXED))
def grammar_analyses(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("word")
    noun, verb = morphology.lookup_either(w, "NN", "VB"), morphology.lookup_either(w, "VB", "NN")
    made = grammar_words(spark, d).select("word", noun.alias("noun"), verb.alias("verb"))
    return made.select("word", morphology.all_shown(F.col("noun")).alias("as_noun"), morphology.all_shown(F.col("verb")).alias("as_verb"), F.when(F.col("noun").isNotNull(), F.size("noun").cast("long")).alias("parts"))


@query(assemble("SELECT word, segments FROM segmented", **_AFFIXED))
def grammar_segments(spark: SparkSession, d: str) -> DataFrame:
    return grammar_words(spark, d).select("word", morphology.stem_word(F.col("word")).alias("segments"))


@query(assemble(f"SELECT translate(word, '{_BW}', '{T.ARABIC}') AS value, translate(array_to_string(segments, ' '), '{_BW}', '{T.ARABIC}') AS answer FROM turned JOIN segmented USING (word)", **_AFFIXED | {"turned": f"SELECT word AS was, translate(translate(word, '{_BW}', '{T.ARABIC}'), '{T.ARABIC}', '{_BW}') AS word FROM affixed"} | analyses(f"SELECT translate(translate(word, '{_BW}', '{T.ARABIC}'), '{T.ARABIC}', '{_BW}') AS word FROM affixed")))
def grammar_requests(spark: SparkSession, d: str) -> DataFrame:
    """The service's answers to the words in Arabic script."""
    return service.answers(grammar_words(spark, d).select(T.to_arabic(F.col("word")).alias("value")), morphology.stem_text)


@query(assemble("SELECT word AS bw, tag, 'main' AS source, CASE WHEN tag = 'VB' THEN coalesce(verb, noun) ELSE coalesce(noun, verb) END AS analysis FROM analysed, (VALUES ('NNS'), ('VB')) t(tag)", **_AFFIXED))
def grammar_gold(spark: SparkSession, d: str) -> DataFrame:
    """The words as a gold standard's nouns and verbs; a tag that is neither goes."""
    tags = F.explode(F.array(*map(F.lit, ("NNS", "VB", "VBD", "XX")))).alias("tag")
    gold = grammar_words(spark, d).select(T.to_arabic(F.col("word")).alias("form"), tags, F.col("word").alias("bw"))
    return morphology.lookup_all(gold).select("bw", "tag", "source", morphology.all_shown(F.col("analysis")).alias("analysis"))


# A light analysis in SQL's means, for what is done with analyses: a conjunction before the word, an ending behind it, and the first letters as its root.


def light(bw: Column) -> Column:
    conj = F.regexp_extract(bw, "^([wf])...", 1)
    rest = F.substring(bw, F.length(conj) + 1, F.length(bw))
    ending = F.regexp_extract(rest, "..(At|hA|h|k|y|A)$", 1)
    stem = F.left(rest, F.length(rest) - F.length(ending))
    pair = lambda tag, form: F.struct(F.lit(tag).alias("tag"), form.alias("form"))
    return F.array(pair("NCONJ", F.nullif(conj, F.lit(""))), pair("ROOT", F.left(stem, F.lit(3))), pair("NSTEM", stem), pair("CASE", ending))


_LIGHT = {
    "lit": "SELECT DISTINCT token AS bw, regexp_extract(token, '^([wf])...', 1) AS conj FROM tok",
    "rested": "SELECT *, substring(bw, 1 + length(conj)) AS rest FROM lit",
    "ended": "SELECT *, regexp_extract(rest, '..(At|hA|h|k|y|A)$', 1) AS ending FROM rested",
    "stemmed": "SELECT *, left(rest, CAST(length(rest) - length(ending) AS BIGINT)) AS stem FROM ended",
    "paired": "SELECT *, [{'tag': 'NCONJ', 'form': nullif(conj, '')}, {'tag': 'ROOT', 'form': left(stem, 3)}, {'tag': 'NSTEM', 'form': stem}, {'tag': 'CASE', 'form': ending}] AS analysis FROM stemmed",
    "plained": r"""SELECT *, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(
        regexp_replace(array_to_string(list_transform(analysis, lambda p: concat_ws('/', p.form, p.tag)), '+'), '\+/[A-Z]*', '', 'g'), 'All/NAME', 'Allh/NAME'), '+A/CASE', '+AF/CASE'), '+l/DET', '+Al/DET'),
        '/[^+]*', '', 'g'), '^\+|\+$', '', 'g'), '\++', '+', 'g'), '}', ''), '+FA', '+AF'), '+F', '+AF') AS ours FROM paired""",
    "other": f"SELECT *, translate(bw, '{_BW}', '{T.ARABIC}') AS form, CASE WHEN length(bw) % 3 = 0 THEN [] WHEN length(bw) % 3 = 1 THEN [ours] ELSE [bw, stem || '+' || ending] END AS others FROM (SELECT * REPLACE (CASE WHEN length(bw) % 5 = 0 THEN '' ELSE ours END AS ours) FROM plained)",
}


def lightly(spark: SparkSession, d: str) -> DataFrame:
    return different_tokens(spark, d).select(F.col("token").alias("bw")).withColumn("analysis", light(F.col("bw")))


@query(
    assemble(
        f"""SELECT bw, list_transform(list_filter(analysis, lambda p: p.form IS NOT NULL), lambda p: p.form || '/' || p.tag) AS shown, analysis[2].form AS root, ours,
        array_to_string(list_transform(analysis, lambda p: concat_ws('/', translate(p.form, '{_BW}', '{T.ARABIC}'), p.tag)), ' ') AS script, 'NSTEM/' || stem || '/' || bw AS named,
        CASE WHEN conj = '' THEN NULL ELSE conj = stem END AS same, stem = ending AS wild FROM plained""",
        **_LIGHT,
    )
)
def pair_functions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tag and form: shown, without empty ones, the root, in the other spelling, in Arabic script, and matched."""
    at = lambda i: F.col("analysis")[i]
    as_stem = F.struct(F.lit("NSTEM").alias("tag"), at(0)["form"].alias("form"))
    any_tag = F.struct(F.lit("???").alias("tag"), at(3)["form"].alias("form"))
    return lightly(spark, d).select(
        "bw", morphology.all_shown(morphology.not_empty(F.col("analysis"))).alias("shown"), morphology.root(F.col("analysis"))["form"].alias("root"), morphology.plain(F.col("analysis")).alias("ours"),
        morphology.in_script(F.col("analysis")).alias("script"), morphology.shown(at(2), F.col("bw")).alias("named"), morphology.matches(at(2), as_stem).alias("same"), morphology.matches(any_tag, at(2)).alias("wild"),
    )


@query(
    assemble(
        """SELECT bw, CASE WHEN len(others) = 0 AND ours = '' THEN 'PURPLE' WHEN list_contains(others, ours) THEN 'BLACK' WHEN ours = '' THEN 'GREEN' WHEN len(others) = 0 THEN 'BLUE' ELSE 'RED' END AS colour FROM other
        WHERE length(bw) <> 1 AND len(list_filter(string_split(bw, ''), lambda c: c <> '' AND NOT contains(form, c))) > 0""",
        **_LIGHT,
    )
)
def agreement_classes(spark: SparkSession, d: str) -> DataFrame:
    """How the light analysis stands to a list made from it: words without a partner, without an analysis, and those that agree or don't."""
    bw = F.col("bw")
    known = F.when(F.length(bw) % 5 != 0, F.col("analysis"))
    rest = F.concat(F.col("analysis")[2]["form"], F.lit("+"), F.col("analysis")[3]["form"])
    shown = F.when(F.length(bw) % 5 == 0, "").otherwise(morphology.plain(F.col("analysis")))
    others = F.when(F.length(bw) % 3 == 0, F.array().cast("array<string>")).when(F.length(bw) % 3 == 1, F.array(shown)).otherwise(F.array(bw, rest))
    rows = lightly(spark, d).withColumns({"form": T.to_arabic(bw), "others": others}).withColumn("analysis", known)
    return morphology.agreement(rows).select("bw", "colour")


@query(
    assemble(
        """SELECT segment, count(*) AS size, list(form ORDER BY form, bw)[:20] AS words FROM (SELECT DISTINCT p.form || '/' || p.tag AS segment, form, bw FROM (SELECT bw, form, unnest(analysis) AS p FROM other) WHERE p.tag <> 'ROOT' AND p.form IS NOT NULL) GROUP BY segment""",
        **_LIGHT,
    )
)
def light_segments(spark: SparkSession, d: str) -> DataFrame:
    """The words of each segment of the light analysis, the first 20 of them by name."""
    rows = lightly(spark, d).select(T.to_arabic(F.col("bw")).alias("form"), F.lit("NN").alias("tag"), "bw", morphology.not_empty(F.col("analysis")).alias("analysis"))
    return morphology.show_index(morphology.index_by_segment(rows), 20)


@query(assemble("SELECT doc_id, token, w0, w, CASE WHEN w0 < 0.004e0 THEN '*' ELSE '' END AS star FROM (SELECT doc_id, token, CASE WHEN df <= 5 THEN w ELSE 0.0e0 END AS w0, w FROM weights) WHERE w > 0.004e0"))
def weights_compared(spark: SparkSession, d: str) -> DataFrame:
    """The weights beyond a bound beside those of rare terms alone."""
    rows = written(features.tfidf(all_counts(spark, d)), "weights")
    return lsa.compare(rows.where("df <= 5"), rows.select("doc_id", "token", "w"), 0.004)


@query(assemble("SELECT doc_id, list(CAST(idx AS INTEGER) ORDER BY idx) AS terms FROM weights JOIN (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT token FROM weights)) USING (token) GROUP BY doc_id"))
def matrix_rows(spark: SparkSession, d: str) -> DataFrame:
    """The places of each document's weights."""
    return lsa.matrix_rows(features.tfidf(all_counts(spark, d), index=True)).select("doc_id", F.col("entries.idx").alias("terms"))


@query(assemble("SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(w, 12) AS w FROM weights JOIN (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT token FROM weights)) USING (token)"))
def matrix_entries(spark: SparkSession, d: str) -> DataFrame:
    """The matrix with its weights, an entry a row."""
    return features.tfidf(all_counts(spark, d), index=True).select("doc_id", "idx", F.round("w", 12).alias("w"))


@query(assemble("SELECT doc_id, '<' || CAST(CAST(round(size, 6) AS DECIMAL(18, 6)) AS VARCHAR) || ', ' || text || '>' AS shown FROM sizes JOIN (SELECT doc_id, text FROM documents) USING (doc_id)"))
def document_forms(spark: SparkSession, d: str) -> DataFrame:
    sizes = features.norms(all_counts(spark, d)).withColumn("size", F.round("size", 6).cast("decimal(18,6)"))
    return reports.document_form(documents(spark, d), sizes)


_PLAIN = """replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(
    regexp_replace(array_to_string(coalesce(noun, verb, []), '+'), '\\+/[A-Z]*', '', 'g'), 'All/NAME', 'Allh/NAME'), '+A/CASE', '+AF/CASE'), '+l/DET', '+Al/DET'),
    '/[^+]*', '', 'g'), '^\\+|\\+$', '', 'g'), '\\++', '+', 'g'), '}', ''), '+FA', '+AF'), '+F', '+AF')"""


@query(
    assemble(
        """SELECT CASE WHEN length(bw) <= 3 AND ours = '' THEN 'PURPLE' WHEN length(bw) > 3 AND ours IN (bw, stemmed) THEN 'BLACK' WHEN ours = '' THEN 'GREEN' WHEN length(bw) <= 3 THEN 'BLUE' ELSE 'RED' END AS colour, count(*) AS n
        FROM own WHERE length(bw) <> 1 AND len(list_filter(string_split(bw, ''), lambda c: c <> '' AND NOT contains(form, c))) > 0 GROUP BY colour""",
        own=f"SELECT word AS bw, translate(word, '{_BW}', '{T.ARABIC}') AS form, {_PLAIN} AS ours, regexp_replace(regexp_replace(word, '^(w|f|Al|b|l)(...)', '\\1+\\2'), '^(.*?...)(h|hA|hm|k|wn|yn|At)$', '\\1+\\2') AS stemmed FROM analysed",
        **_TOKENS,
    )
)
def analyser_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Our analyses of the documents' tokens, in Arabic script as forms, beside a light stemmer's: a conjunction or article before the word, a pronoun or plural behind it."""
    bw = F.col("token")
    light = F.regexp_replace(F.regexp_replace(bw, "^(w|f|Al|b|l)(?=...)", "$1+"), "(?<=...)(h|hA|hm|k|wn|yn|At)$", "+$1")
    words = different_tokens(spark, d).select(T.to_arabic(bw).alias("form"), bw.alias("bw"), morphology.lookup_either(bw, "NN", "VB").alias("analysis"), F.when(F.length(bw) > 3, F.array(bw, light)).otherwise(F.array().cast("array<string>")).alias("others"))
    return morphology.agreement_counts(morphology.agreement(words))
