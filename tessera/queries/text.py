"""Text analysis, inverted index and dictionary over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.ranking import idf
from tessera.functions.text import WORD, default_stopwords, tokens
from tessera.operators import index as ix
from tessera.plans.settings import TokenizerConfig
from tessera.queries.common import POST, TERMS, TOK, table

STOP = default_stopwords()
#: From the published sample of the English (Porter2) stemmer.
KNOWN = dict(x.split(":") for x in (
    "consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistent:consist consistently:consist consisting:consist "
    "consists:consist consolation:consol consolations:consol consolatory:consolatori console:consol consoled:consol consoles:consol consolidate:consolid consolidated:consolid "
    "consolidating:consolid consoling:consol consolingly:consol consols:consol consonant:conson consort:consort consorted:consort consorting:consort conspicuous:conspicu "
    "conspicuously:conspicu conspiracy:conspiraci conspirator:conspir conspirators:conspir conspire:conspir conspired:conspir conspiring:conspir constable:constabl constables:constabl "
    "constance:constanc constancy:constanc constant:constant knack:knack knackeries:knackeri knacks:knack knag:knag knave:knave knaves:knave knavish:knavish kneaded:knead kneading:knead "
    "knee:knee kneel:kneel kneeled:kneel kneeling:kneel kneels:kneel knees:knee knell:knell knelt:knelt knew:knew knick:knick knif:knif knife:knife knight:knight knightly:knight "
    "knights:knight knit:knit knits:knit knitted:knit knitting:knit knives:knive knob:knob knobs:knob knock:knock knocked:knock knocker:knocker knockers:knocker knocking:knock "
    "knocks:knock knopp:knopp knot:knot knots:knot").split())  # fmt: skip
_stop_sql = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


def _docs(spark, d):
    return table(spark, d, "documents")


def _tok(spark, d):
    return ix.tokenized(_docs(spark, d))


def tok_tokens_simple(spark, d):
    return _tok(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def tok_segments(spark, d):
    """Segmentation alone."""
    return _docs(spark, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("n_words"))


def tok_length_filter(spark, d):
    return ix.tokenized(_docs(spark, d), TokenizerConfig(min_len=3, max_len=5)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def tok_case_kept(spark, d):
    return ix.tokenized(_docs(spark, d), TokenizerConfig(lowercase=False)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def tok_stopwords(spark, d):
    return ix.tokenized(_docs(spark, d), TokenizerConfig(remove_stopwords=True)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def tok_term_freq(spark, d):
    return ix.postings(_tok(spark, d)).select("doc_id", "term", "tf")


def tok_doc_length(spark, d):
    return ix.doc_stats(_tok(spark, d))


def tok_unique_terms(spark, d):
    return _tok(spark, d).select("doc_id", F.size(F.array_distinct("tokens")).alias("n_unique"))


def tok_stemmed(spark, d):
    """Porter2 stems of all tokens."""
    return _docs(spark, d).select("doc_id", F.array_join(tokens(F.col("text"), TokenizerConfig(stem=True)), " ").alias("stems"))


def tok_uax29(spark, d):
    """Unicode words."""
    return _docs(spark, d).select("doc_id", F.array_join(tokens(F.col("text"), TokenizerConfig(mode="uax29")), " ").alias("tokens"))


def idx_terms(spark, d):
    return ix.terms(ix.postings(_tok(spark, d)))


def idx_postings(spark, d):
    return ix.postings(_tok(spark, d)).where(F.col("term") == TERMS[0])


def idx_positions(spark, d):
    p = ix.postings(_tok(spark, d), positions=True)
    return p.select("term", "doc_id", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def idx_corpus_stats(spark, d):
    return ix.corpus_stats(ix.doc_stats(_tok(spark, d))).select("n", "total_len", F.round("avgdl", 6).alias("avgdl"))


def idx_partial_stats(spark, d):
    return ix.partial_stats(ix.doc_stats(_tok(spark, d)), F.col("doc_id") % 12)


def idx_merged_stats(spark, d):
    return ix.merged_stats(idx_partial_stats(spark, d)).select("n", "total_len", F.round("avgdl", 6).alias("avgdl"))


def idx_live_counts(spark, d):
    """All documents, and those that aren't deleted (here: toxic)."""
    docs, gone = _docs(spark, d), table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("gone", F.lit(1))
    j = docs.select("doc_id").join(gone, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total_docs"), F.count_if(F.col("gone").isNull()).alias("live_docs"))


def idx_contains(spark, d):
    """Labelled ids that the corpus has."""
    return table(spark, d, "labels").select("doc_id").join(_docs(spark, d).select("doc_id"), "doc_id", "left_semi")


def idx_live_df(spark, d):
    """Document frequencies of what isn't deleted."""
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return ix.terms(ix.without(ix.postings(_tok(spark, d)), gone))


def idx_saved(spark, d):
    """The term table of an index that was written, sorted by term, and read again."""
    from tessera.sources.scratch import shared_folder

    path = shared_folder(spark)
    ix.InvertedIndex.build(_docs(spark, d)).save(path)
    return ix.InvertedIndex.load(spark, path).terms


def dic_prefix(spark, d):
    return ix.prefix(idx_terms(spark, d), "th").select("term", "df")


def dic_vocab(spark, d):
    return idx_terms(spark, d).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total_tf").alias("n_tokens"))


def dic_term_ids(spark, d):
    """Every term has an id of its own, by which it is found again."""
    t = idx_terms(spark, d).withColumn("id", ix.term_id(F.col("term")))
    back = t.select("term", "id").join(t.select("id", F.col("term").alias("other")), "id").where("term = other")
    return t.agg(F.count(F.lit(1)).alias("n_terms"), F.countDistinct("id").alias("n_ids")).crossJoin(back.agg(F.count(F.lit(1)).alias("n_found")))


def tok_stems_known(spark, d):
    """Stems of words whose stems are published."""
    words = spark.createDataFrame([(w,) for w in KNOWN], "word string")
    return words.select("word", F.element_at(tokens(F.col("word"), TokenizerConfig(stem=True, min_len=1)), 1).alias("stem"))


def dic_contains(spark, d):
    """Which words of the benchmark the dictionary has."""
    w = table(spark, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return w.join(idx_terms(spark, d).select("term", "df"), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def dic_skip_to(spark, d):
    return ix.first_at_or_after(ix.postings(_tok(spark, d)), "the", 50)


def kw_idf(spark, d):
    n = ix.corpus_stats(ix.doc_stats(_tok(spark, d))).select("n")
    return idx_terms(spark, d).crossJoin(F.broadcast(n)).select("term", F.round(idf(F.col("df"), F.col("n")), 6).alias("idf"))


def _toks(low: int, high: int, lower: bool = True, extra: str = "") -> str:
    inner = r"regexp_extract_all(text, '[\p{L}\p{N}]+')"
    if lower:
        inner = f"list_transform({inner}, lambda x: lower(x))"
    return f"SELECT doc_id, coalesce(array_to_string(list_filter({inner}, lambda t: strlen(t) BETWEEN {low} AND {high}{extra}), ' '), '') AS tokens FROM documents"


#: Marks that join letters, or digits, to one word, and the letters that stand for them while words are cut.
MARKS = {"'": "ꀀ", "’": "ꀁ", ".": "ꀂ", "‘": "ꀃ", ":": "ꀄ", "·": "ꀅ", "․": "ꀆ", ",": "ꀇ", ";": "ꀈ"}


def _unicode_words() -> str:
    """Unicode words of texts in which a mark between two letters (or digits) joins them."""
    t, quoted = "coalesce(text, '')", lambda c: "''" if c == "'" else c
    for kind, marks in ((r"\p{L}\p{M}*", "'’.‘:·․"), (r"\p{Nd}", "'’.‘․,;")):
        for c in marks:
            for _ in range(2):  # a letter may stand between two marks
                t = f"regexp_replace({t}, '({kind})[{quoted(c)}]({kind.removesuffix('*').removesuffix(r'\p{M}')})', '\\1{MARKS[c]}\\2', 'g')"
    cut = rf"list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))"
    words = f"list_transform({cut}, lambda x: translate(lower(x), '{''.join(MARKS.values())}', '{''.join(map(quoted, MARKS))}'))"
    return f"SELECT doc_id, coalesce(array_to_string(list_filter({words}, lambda x: strlen(x) BETWEEN 2 AND 50), ' '), '') AS tokens FROM documents"


TERM_SQL = "SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM post GROUP BY term"
QUERIES = {
    f.__name__: f
    for f in (
        tok_tokens_simple, tok_segments, tok_length_filter, tok_case_kept, tok_stopwords, tok_term_freq, tok_doc_length, tok_unique_terms, tok_stemmed, tok_stems_known, tok_uax29, idx_terms, idx_postings,
        idx_positions, idx_corpus_stats, idx_partial_stats, idx_merged_stats, idx_live_counts, idx_contains, idx_live_df, idx_saved, dic_prefix, dic_vocab, dic_contains, dic_term_ids, dic_skip_to, kw_idf,
    )
}
STATS_SQL = f"WITH {TOK} SELECT count(*) AS n, sum(len(tokens))::BIGINT AS total_len, round(avg(len(tokens)), 6) AS avgdl FROM tok"
ORACLES = {
    "tok_uax29": _unicode_words(),
    "dic_term_ids": f"WITH {POST} SELECT count(*) AS n_terms, count(*) AS n_ids, count(*) AS n_found FROM df",
    "tok_stems_known": "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in KNOWN.items()) + ") AS t(word, stem)",
    "tok_tokens_simple": _toks(2, 50),
    "tok_segments": r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS n_words FROM documents",
    "tok_length_filter": _toks(3, 5),
    "tok_case_kept": _toks(2, 50, lower=False),
    "tok_stopwords": _toks(2, 50, extra=f" AND t NOT IN {_stop_sql}"),
    "tok_term_freq": f"WITH {POST} SELECT doc_id, term, tf FROM post",
    "tok_doc_length": f"WITH {TOK} SELECT doc_id, len(tokens) AS doc_len FROM tok",
    "tok_unique_terms": f"WITH {TOK} SELECT doc_id, len(list_distinct(tokens)) AS n_unique FROM tok",
    "idx_terms": f"WITH {POST} {TERM_SQL}",
    "idx_saved": f"WITH {POST} {TERM_SQL}",
    "idx_postings": f"WITH {POST} SELECT term, doc_id, tf FROM post WHERE term = 'the'",
    "idx_positions": f"""WITH {TOK}, each AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM tok)
      SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM each GROUP BY ALL""",
    "idx_corpus_stats": STATS_SQL,
    "idx_merged_stats": STATS_SQL,
    "idx_partial_stats": f"WITH {TOK} SELECT doc_id % 12 AS segment, count(*) AS n, sum(len(tokens))::BIGINT AS total_len FROM tok GROUP BY 1",
    "idx_live_counts": "SELECT count(*) AS total_docs, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS live_docs FROM documents",
    "idx_contains": "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)",
    "idx_live_df": f"WITH {POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM post WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY term",
    "dic_prefix": f"WITH {POST} SELECT term, df FROM df WHERE starts_with(term, 'th')",
    "dic_vocab": f"WITH {POST} SELECT count(DISTINCT term) AS n_terms, sum(tf)::BIGINT AS n_tokens FROM post",
    "dic_contains": rf"""WITH {POST}, w AS (SELECT DISTINCT term FROM (SELECT unnest(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))) AS term FROM benchmark) WHERE strlen(term) BETWEEN 2 AND 50)
      SELECT w.term, coalesce(df, 0) AS df FROM w LEFT JOIN df ON w.term = df.term""",
    "dic_skip_to": f"WITH {POST} SELECT term, doc_id, tf FROM post WHERE term = 'the' AND doc_id >= 50 ORDER BY doc_id LIMIT 1",
    "kw_idf": f"WITH {POST} SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, st",
}
