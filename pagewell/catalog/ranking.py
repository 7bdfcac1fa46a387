"""Ranked search, snippets and hits for the queries of all benchmark texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.catalog import inputs as I
from pagewell.catalog.indexing import SQL_BATCHES, SQL_HAN_RUN, SQL_SEGMENTED, han_analyser, in_han, segmented_index, two_batches
from pagewell.catalog.registry import query
from pagewell.config import SearchConfig
from pagewell.functions.text import flatten_newlines
from pagewell.operators import search as S
from pagewell.operators.index import read_index
from pagewell.operators.snippets import best_fragment, query_terms, search_snippets
from pagewell.session import scratch_path
from pagewell.sources.sinks import sink_hits

HITS = ["query_id", "rank", "score", "doc_id"]


def word(n: int) -> Column:
    return F.try_element_at("w", F.lit(n))


def clause(number: int, kind: str, **columns: Column | str | int | float) -> Column:
    """Clause row as a struct; missing columns are null here and get their defaults later."""
    fixed = {"clause_id": number, "kind": kind, "occur": "should", "field": "content", "boost": 1.0, **columns}
    types = dict(e.split(" ", 1) for e in S.CLAUSE_SCHEMA.split(", ") if not e.startswith("query_id"))
    defaults = {"slop": 0, "max_edits": 2, "incl_lo": True, "incl_hi": True}

    def column(name: str) -> Column:
        value = fixed.get(name, defaults.get(name))
        return (value if isinstance(value, Column) else F.lit(value)).cast(types[name]).alias(name)

    return F.struct(*[column(n) for n in types])


def clauses(spark: SparkSession, folder: str, n: int, *parts: Column) -> DataFrame:
    """The same clauses for every group of ``n`` query words ``w``; a clause whose word is missing falls out."""
    rows = I.query_words(spark, folder, n).select("query_id", F.explode(F.array(*parts)).alias("c"))
    wordless = F.col("kind").isin("term", "prefix", "wildcard", "fuzzy") & F.col("term").isNull()
    return rows.select("query_id", "c.*").filter(~wordless)


def ranked(
    spark: SparkSession, folder: str, n: int, *parts: Column, config: SearchConfig = SearchConfig()
) -> DataFrame:
    index = I.documents_index(spark, folder)
    return S.search(index, clauses(spark, folder, n, *parts), config).hits.select(*HITS)


# --- SQL of the same ------------------------------------------------------------------------

SQL_RANK = I.SQL_INDEX + f""",
{I.SQL_QUERIES}"""


def sql_rank_words(n: int) -> str:
    return f"{SQL_RANK}, {I.sql_query_words(n)}"


_LENGTH = (
    "(CASE WHEN p.dl < 40 THEN p.dl ELSE 24 + "
    "(((p.dl - 24) >> (length(bin(p.dl - 24)) - 4)) << (length(bin(p.dl - 24)) - 4)) END)"
)
_BM25 = (
    "{weight} * {idf} * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * "
    + _LENGTH
    + " * f.n_docs / f.total_len))"
)
_IDF = "ln(1 + (f.n_docs - {df} + 0.5) / ({df} + 0.5))"


def sql_terms(leaves: str, extra: str = "") -> str:
    """CTE ``clause_scores`` of bare-term leaves ``query_id, clause_id, occur, field, term, weight``."""
    score = _BM25.format(weight="l.weight", idf=_IDF.format(df="s.df"), tf="p.tf")
    return f"""
    leaves AS ({leaves}),
    clause_scores AS (
      SELECT l.query_id, l.clause_id, l.occur, p.doc_id, {score} AS score
      FROM leaves l JOIN postings p ON p.field = l.field AND p.term = l.term
      JOIN term_stats s ON s.field = l.field AND s.term = l.term
      JOIN field_stats f ON f.field = l.field {extra})"""


def sql_rank(k: int = 20, columns: str = "query_id, rank, score, doc_id") -> str:
    """Top ``k`` of ``clause_scores`` when every clause is optional."""
    return f"""
    scored AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM clause_scores GROUP BY query_id, doc_id),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM scored),
    hits AS (SELECT query_id, rank, score, doc_id FROM ranked WHERE rank <= {k})
    SELECT {columns} FROM hits"""


_BARE = """SELECT query_id, i AS clause_id, 'should' AS occur, 'content' AS field, t AS term, 1.0 AS weight FROM (
      SELECT query_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (
        SELECT query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS l FROM user_queries))""".replace("\\\\", "\\")


def bare(spark: SparkSession, folder: str, config: SearchConfig = SearchConfig()) -> S.Ranked:
    return S.search(
        I.documents_index(spark, folder), S.clauses_of_text(I.user_queries(spark, folder)), config
    )


# --- clause kinds -----------------------------------------------------------------------------


@query("search_terms", f"WITH {SQL_RANK}, {sql_terms(_BARE)}, {sql_rank()}")
def _search_terms(spark: SparkSession, folder: str) -> DataFrame:
    return bare(spark, folder).hits.select(*HITS)


@query("top_k_hits", f"WITH {SQL_RANK}, {sql_terms(_BARE)}, {sql_rank(5)}")
def _top_k_hits(spark: SparkSession, folder: str) -> DataFrame:
    return bare(spark, folder, SearchConfig(top_k=5)).hits.select(*HITS)


@query(
    "fetch_stored",
    f"WITH {SQL_RANK}, {sql_terms(_BARE)}, {sql_rank(columns='hits.query_id, hits.rank, hits.score, hits.doc_id, d.url, d.title, d.content')} "
    "JOIN docs d ON d.doc_id = hits.doc_id",
)
def _fetch_stored(spark: SparkSession, folder: str) -> DataFrame:
    found = bare(spark, folder)
    docs = I.documents_index(spark, folder).docs
    return S.fetch_stored(found.hits, docs, found.max_hits).select(*HITS, "url", "title", "content")


@query(
    "sink_hits",
    f"WITH {SQL_RANK}, {sql_terms(_BARE)}, {sql_rank()}",
)
def _sink_hits(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "hits")
    sink_hits(bare(spark, folder).hits.select(*HITS), path)
    return spark.read.parquet(path)


def sql_leaf(number: int, word: str, occur: str = "should", field: str = "content", weight: float = 1.0) -> str:
    return (
        f"SELECT query_id, {number} AS clause_id, '{occur}' AS occur, '{field}' AS field, "
        f"{word} AS term, CAST({weight} AS DOUBLE) AS weight FROM qw"
    )


_BOOLEAN = " UNION ALL ".join(
    [sql_leaf(0, "w[1]", "must"), sql_leaf(1, "w[2]"), sql_leaf(2, "w[len(w)]", "must_not")]
)


@query(
    "search_boolean",
    f"""WITH {sql_rank_words(3)}, {sql_terms(_BOOLEAN)},
    combined AS (
      SELECT query_id, doc_id, round(sum(score) FILTER (WHERE occur <> 'must_not'), 6) AS score
      FROM clause_scores GROUP BY query_id, doc_id
      HAVING count(*) FILTER (WHERE occur = 'must') = 1 AND count(*) FILTER (WHERE occur = 'must_not') = 0),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM combined)
    SELECT query_id, rank, score, doc_id FROM ranked WHERE rank <= 20""",
)
def _search_boolean(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(
        spark,
        folder,
        3,
        clause(0, "term", term=word(1), occur="must"),
        clause(1, "term", term=word(2)),
        clause(2, "term", term=word(-1), occur="must_not"),
    )


_FIELDED = " UNION ALL ".join([sql_leaf(0, "w[1]", field="title"), sql_leaf(1, "w[2]")])


@query("search_field", f"WITH {sql_rank_words(2)}, {sql_terms(_FIELDED)}, {sql_rank()}")
def _search_field(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(
        spark, folder, 2, clause(0, "term", term=word(1), field="title"), clause(1, "term", term=word(2))
    )


_BOOSTED = " UNION ALL ".join([sql_leaf(0, "w[1]", weight=2.0), sql_leaf(1, "w[2]", weight=0.5)])


@query("search_boost", f"WITH {sql_rank_words(2)}, {sql_terms(_BOOSTED)}, {sql_rank()}")
def _search_boost(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(
        spark, folder, 2, clause(0, "term", term=word(1), boost=2.0), clause(1, "term", term=word(2), boost=0.5)
    )


@query(
    "search_url_exact",
    f"WITH {I.SQL_DOCS} SELECT CAST(doc_id AS INTEGER) AS query_id, 1 AS rank, CAST(1.0 AS DOUBLE) AS score, doc_id FROM docs",
)
def _search_url_exact(spark: SparkSession, folder: str) -> DataFrame:
    index = I.documents_index(spark, folder)
    wanted = I.documents(spark, folder).select(
        F.col("doc_id").cast("int").alias("query_id"),
        F.lit(0).alias("clause_id"),
        F.lit("url").alias("kind"),
        F.lit("url").alias("field"),
        F.col("url").alias("term"),
    )
    return S.search(index, wanted).hits.select(*HITS)


_GROUP_SCORE = _BM25.format(weight="1.0", idf=_IDF.format(df="g.df"), tf="p.tf")


@query(
    "search_synonym_group",
    f"""WITH {sql_rank_words(2)},
    leaves AS (SELECT DISTINCT query_id, unnest([w[1], w[2]]) AS term FROM qw),
    g AS (SELECT l.query_id, max(s.df) AS df FROM leaves l
          JOIN term_stats s ON s.term = l.term AND s.field = 'content' GROUP BY l.query_id),
    p AS (SELECT l.query_id, x.doc_id, sum(x.tf) AS tf, any_value(x.dl) AS dl FROM leaves l
          JOIN postings x ON x.term = l.term AND x.field = 'content' GROUP BY l.query_id, x.doc_id),
    clause_scores AS (
      SELECT p.query_id, p.doc_id, {_GROUP_SCORE} AS score FROM p JOIN g ON g.query_id = p.query_id
      JOIN field_stats f ON f.field = 'content'),
    {sql_rank()}""",
)
def _search_synonym_group(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(spark, folder, 2, clause(0, "synonyms", terms=F.col("w")))


_SQL_STARTS = """
    pos0 AS (SELECT q.query_id, t.doc_id, t.pos AS a FROM qw q JOIN tokens t ON t.term = q.w[1] AND t.field = 'content'),
    pos1 AS (SELECT q.query_id, t.doc_id, t.pos - 1 AS a FROM qw q JOIN tokens t ON t.term = q.w[2] AND t.field = 'content'),
    idfs AS (
      SELECT q.query_id, ln(1 + (f.n_docs - s0.df + 0.5) / (s0.df + 0.5)) + ln(1 + (f.n_docs - s1.df + 0.5) / (s1.df + 0.5)) AS idf,
             f.n_docs, f.total_len
      FROM qw q JOIN term_stats s0 ON s0.term = q.w[1] AND s0.field = 'content'
      JOIN term_stats s1 ON s1.term = q.w[2] AND s1.field = 'content' JOIN field_stats f ON f.field = 'content')"""
_PHRASE_SCORE = _BM25.format(weight="1.0", idf="f.idf", tf="x.tf")
_SQL_PHRASE_RANK = f"""
    clause_scores AS (
      SELECT x.query_id, x.doc_id, {_PHRASE_SCORE} AS score FROM freq x
      JOIN idfs f ON f.query_id = x.query_id
      JOIN lengths p ON p.doc_id = x.doc_id AND p.field = 'content'),
    {sql_rank()}"""


@query(
    "search_phrase",
    f"""WITH {sql_rank_words(2)}, {_SQL_STARTS},
    freq AS (
      SELECT a.query_id, a.doc_id, CAST(count(*) AS DOUBLE) AS tf FROM pos0 a
      JOIN pos1 b ON b.query_id = a.query_id AND b.doc_id = a.doc_id AND b.a = a.a GROUP BY a.query_id, a.doc_id),
    {_SQL_PHRASE_RANK}""",
)
def _search_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(spark, folder, 2, clause(0, "phrase", terms=F.col("w")))


@query(
    "search_phrase_slop",
    f"""WITH {sql_rank_words(2)}, {_SQL_STARTS},
    both_pos AS (SELECT *, 0 AS i FROM pos0 UNION ALL SELECT *, 1 FROM pos1),
    windows AS (
      SELECT query_id, doc_id, a, i,
             CASE WHEN i = 0 THEN min(CASE WHEN i = 1 THEN a END) OVER later
                  ELSE min(CASE WHEN i = 0 THEN a END) OVER later END AS ahead,
             lead(a) OVER (PARTITION BY query_id, doc_id, i ORDER BY a) AS own
      FROM both_pos
      WINDOW later AS (PARTITION BY query_id, doc_id ORDER BY a RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    freq AS (
      SELECT query_id, doc_id, sum(1.0 / (1 + ahead - a)) AS tf FROM windows
      WHERE ahead IS NOT NULL AND ahead - a <= 2 AND (own IS NULL OR own > ahead) GROUP BY query_id, doc_id),
    {_SQL_PHRASE_RANK}""",
)
def _search_phrase_slop(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(spark, folder, 2, clause(0, "phrase", terms=F.col("w"), slop=2))


def sql_constant(conditions: list[tuple[int, str]]) -> str:
    """CTE ``clause_scores`` of clauses that give every document with a matching term 1.0."""
    found = " UNION ALL ".join(
        f"SELECT DISTINCT q.query_id, {n} AS clause_id, s.term FROM qw q JOIN term_stats s "
        f"ON s.field = 'content' AND {condition}"
        for n, condition in conditions
    )
    return f"""
    expanded AS ({found}),
    clause_scores AS (
      SELECT DISTINCT e.query_id, e.clause_id, p.doc_id, CAST(1.0 AS DOUBLE) AS score FROM expanded e
      JOIN postings p ON p.field = 'content' AND p.term = e.term)"""


_WILD = [
    (0, "starts_with(s.term, substr(q.w[1], 1, 3))"),
    (1, "s.term LIKE substr(q.w[2], 1, 1) || '_' || substr(q.w[2], 3, 2) || '%t'"),
]


@query("search_prefix_wildcard", f"WITH {sql_rank_words(2)}, {sql_constant(_WILD)}, {sql_rank()}")
def _search_prefix_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    pattern = F.concat(
        F.substring(word(2), 1, 1), F.lit("?"), F.substring(word(2), 3, 2), F.lit("*t")
    )
    return ranked(
        spark,
        folder,
        2,
        clause(0, "prefix", term=F.substring(word(1), 1, 3)),
        clause(1, "wildcard", term=pattern),
    )


_RANGES = [
    (0, "s.term >= q.w[1] AND s.term < q.w[1] || 'm'"),
    (1, "s.term > q.w[2] AND s.term <= q.w[2] || 't'"),
    (2, "s.term > least(q.w[1], q.w[2]) AND s.term <= greatest(q.w[1], q.w[2])"),
]


@query("search_range", f"WITH {sql_rank_words(2)}, {sql_constant(_RANGES)}, {sql_rank()}")
def _search_range(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(
        spark,
        folder,
        2,
        clause(0, "range", lo=word(1), hi=F.concat(word(1), F.lit("m")), incl_hi=False),
        clause(1, "range", lo=word(2), hi=F.concat(word(2), F.lit("t")), incl_lo=False),
        clause(2, "range", lo=F.least(word(1), word(2)), hi=F.greatest(word(1), word(2)), incl_lo=False),
    )


def _plain(term: str) -> str:
    """SQL that makes accented letters one byte each, as edits are counted in bytes there."""
    return f"translate({term}, 'èéñßêçíüöóä', 'ABCDEFGHIJK')"


_FUZZY_SCORE = _BM25.format(weight="e.similarity", idf=_IDF.format(df="e.most"), tf="p.tf")


@query(
    "search_fuzzy",
    f"""WITH {sql_rank_words(1)},
    plain_words AS (
      SELECT DISTINCT w[1] AS w, {_plain('w[1]')} AS p, 2 AS k FROM qw),
    plain_terms AS (SELECT term, df, {_plain('term')} AS p FROM term_stats WHERE field = 'content'),
    near AS (
      SELECT q.w, s.term, s.df, levenshtein(s.p, q.p) AS edits,
             1.0 - CAST(levenshtein(s.p, q.p) AS DOUBLE) / least(length(s.p), length(q.p)) AS similarity
      FROM plain_words q JOIN plain_terms s
        ON abs(length(s.p) - length(q.p)) <= q.k AND levenshtein(s.p, q.p) <= q.k),
    e AS (
      SELECT q.query_id, n.term, n.similarity, max(n.df) OVER (PARTITION BY q.query_id) AS most
      FROM qw q JOIN near n ON n.w = q.w[1] WHERE n.edits = 0 OR n.similarity > 0),
    clause_scores AS (
      SELECT e.query_id, p.doc_id, {_FUZZY_SCORE} AS score FROM e
      JOIN postings p ON p.field = 'content' AND p.term = e.term
      JOIN field_stats f ON f.field = 'content'),
    {sql_rank()}""",
)
def _search_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(spark, folder, 1, clause(0, "fuzzy", term=word(1), max_edits=2))


_SAFE = " UNION ALL ".join(
    [f"({sql_leaf(0, 'w[1]')} WHERE length(w[2]) > 3)", f"({sql_leaf(1, 'w[3]')} WHERE length(w[2]) > 3)"]
)


@query("search_batch_safe", f"WITH {sql_rank_words(3)}, {sql_terms(_SAFE)}, {sql_rank()}")
def _search_batch_safe(spark: SparkSession, folder: str) -> DataFrame:
    # A short second word becomes a pattern with a leading wildcard, which no query may hold.
    short = F.length(word(2)) <= 3
    return ranked(
        spark,
        folder,
        3,
        clause(0, "term", term=word(1)),
        clause(1, "term", term=word(3)),
        clause(
            2,
            "wildcard",
            term=F.when(short, F.concat(F.lit("*"), word(2))).otherwise(F.lit("nosuchword*")),
        ),
    )


_LATEST_SCORE = _BM25.format(weight="1.0", idf=_IDF.format(df="s.df"), tf="p.tf")


@query(
    "search_latest",
    rf"""WITH {SQL_BATCHES}, {I.SQL_QUERIES},
    l AS (
      SELECT batch_id, doc_id, url, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS t FROM batch_docs),
    p AS (
      SELECT batch_id, doc_id, url, term, count(*) AS tf, any_value(dl) AS dl FROM (
        SELECT batch_id, doc_id, url, CAST(len(t) AS BIGINT) AS dl, unnest(t) AS term FROM l)
      GROUP BY batch_id, doc_id, url, term),
    s AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    f AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total_len FROM l),
    newest AS (SELECT url, max(batch_id) AS batch_id FROM batch_docs GROUP BY url),
    bare AS ({_BARE}),
    scored AS (
      SELECT b.query_id, p.batch_id, p.doc_id, round(sum({_LATEST_SCORE}), 6) AS score
      FROM bare b JOIN p ON p.term = b.term JOIN s ON s.term = b.term CROSS JOIN f
      JOIN newest n ON n.url = p.url AND n.batch_id = p.batch_id
      GROUP BY b.query_id, p.batch_id, p.doc_id),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, batch_id, doc_id) AS INTEGER) AS rank
      FROM scored)
    SELECT query_id, rank, score, batch_id, doc_id FROM ranked WHERE rank <= 20""",
)
def _search_latest(spark: SparkSession, folder: str) -> DataFrame:
    index = read_index(spark, two_batches(spark, folder))
    clauses_in = S.clauses_of_text(I.user_queries(spark, folder))
    return S.search(index, clauses_in, latest_only=True).hits.select(*HITS, "batch_id")


# --- snippets -----------------------------------------------------------------------------------

_SQL_TEXTS = """
    texts AS (
      SELECT h.query_id, h.rank, h.doc_id, replace(d.content, chr(13) || chr(10), ' ') AS text
      FROM hits h JOIN docs d ON d.doc_id = h.doc_id),
"""
_SQL_PIECES = r"""
    cut AS (
      SELECT query_id, rank, regexp_split_to_array(text, '[\p{L}\p{N}_]+') AS g,
             regexp_extract_all(text, '[\p{L}\p{N}_]+') AS t FROM texts),
    pieces AS (
      SELECT query_id, rank, unnest(t) AS run, unnest(g[1:len(t)]) AS gap, generate_subscripts(t, 1) - 1 AS pos FROM cut),
"""
_SQL_CHOSEN = """
    placed AS (
      SELECT *, sum(length(gap) + length(run)) OVER (PARTITION BY query_id, rank ORDER BY pos) AS e FROM pieces),
    fragged AS (
      SELECT *, pos + min(CASE WHEN pos = 0 THEN 0 ELSE e // 128 - pos END)
               OVER (PARTITION BY query_id, rank ORDER BY pos) AS frag FROM placed),
    extent AS (
      SELECT query_id, rank, frag, min(e - length(run) - length(gap)) AS frag_start, max(e) AS frag_end,
             max(frag) OVER (PARTITION BY query_id, rank) AS last_frag
      FROM fragged GROUP BY query_id, rank, frag),
    query_terms AS (SELECT DISTINCT l.query_id, l.term FROM leaves l
      JOIN term_stats s ON s.field = l.field AND s.term = l.term),
    scores AS (
      SELECT f.query_id, f.rank, f.frag, count(DISTINCT lower(f.run)) AS frag_score FROM fragged f
      JOIN query_terms q ON q.query_id = f.query_id AND q.term = lower(f.run) GROUP BY f.query_id, f.rank, f.frag),
    best AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY frag_score DESC, frag) AS rn
        FROM scores) WHERE rn = 1),
    chosen AS (
      SELECT b.query_id, b.rank, CAST(x.frag_start AS INTEGER) AS frag_start,
             CAST(CASE WHEN b.frag < x.last_frag THEN x.frag_end END AS INTEGER) AS frag_end,
             CAST(b.frag_score AS DOUBLE) AS frag_score
      FROM best b JOIN extent x ON x.query_id = b.query_id AND x.rank = b.rank AND x.frag = b.frag)
"""
_SQL_FRAGMENTS = _SQL_TEXTS + _SQL_PIECES + _SQL_CHOSEN
_SQL_HITS = f"WITH {SQL_RANK}, {sql_terms(_BARE)}, " + sql_rank().rsplit("SELECT", 1)[0].rstrip() + ", "


@query(
    "best_fragment",
    f"{_SQL_HITS} {_SQL_FRAGMENTS} SELECT query_id, rank, frag_start, frag_end, frag_score FROM chosen",
)
def _best_fragment(spark: SparkSession, folder: str) -> DataFrame:
    found = bare(spark, folder)
    stored = S.fetch_stored(found.hits, I.documents_index(spark, folder).docs, found.max_hits)
    texts = stored.select("query_id", "rank", flatten_newlines(F.col("content")).alias("text"))
    best = best_fragment(texts, query_terms(found.leaves.by_query), 128, found.leaves.max_by_query)
    return best.select("query_id", "rank", "frag_start", "frag_end", "frag_score")


@query(
    "search_snippets",
    rf"""{_SQL_HITS} {_SQL_FRAGMENTS},
    snips AS (
      SELECT c.query_id, c.rank, substr(t.text, c.frag_start + 1, coalesce(c.frag_end, length(t.text)) - c.frag_start) AS s
      FROM chosen c JOIN texts t ON t.query_id = c.query_id AND t.rank = c.rank),
    split AS (
      SELECT query_id, rank, regexp_split_to_array(s, '[\p{{L}}\p{{N}}_]+') AS g,
             list_append(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+'), '') AS t FROM snips),
    parts AS (
      SELECT query_id, rank, unnest(g) AS g, unnest(t) AS t, generate_subscripts(g, 1) AS i FROM split),
    marked AS (
      SELECT p.query_id, p.rank, string_agg(p.g || CASE WHEN q.term IS NOT NULL
        THEN '<font color=''red''>' || p.t || '</font>' ELSE p.t END, '' ORDER BY p.i) AS snippet
      FROM parts p LEFT JOIN query_terms q ON q.query_id = p.query_id AND q.term = lower(p.t)
      GROUP BY p.query_id, p.rank)
    SELECT h.query_id, h.rank, h.score, h.doc_id, d.url, d.title, m.snippet FROM hits h
    JOIN docs d ON d.doc_id = h.doc_id
    LEFT JOIN marked m ON m.query_id = h.query_id AND m.rank = h.rank""",
)
def _search_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return search_snippets(bare(spark, folder), I.documents_index(spark, folder))


_SEGMENTED = """SELECT CAST(doc_id AS INTEGER) AS query_id, row_number() OVER () AS clause_id, 'should' AS occur, 'content' AS field, term,
      1.0 AS weight FROM terms WHERE field = 'query'"""


@query(
    "search_segmented",
    rf"""WITH RECURSIVE {SQL_SEGMENTED},
    term_stats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term),
    field_stats AS (SELECT field, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_len FROM sizes GROUP BY field),
    {sql_terms(_SEGMENTED)}, {sql_rank().rsplit("SELECT", 1)[0].rstrip()},
    {_SQL_TEXTS}
    split AS (
      SELECT query_id, rank, regexp_split_to_array(text, '{SQL_HAN_RUN}') AS g,
             regexp_extract_all(text, '{SQL_HAN_RUN}') AS t FROM texts),
    text_runs AS (
      SELECT query_id, rank, unnest(t) AS run, unnest(g[1:len(t)]) AS gap, generate_subscripts(t, 1) AS at FROM split),
    pieces AS (
      SELECT r.query_id, r.rank, coalesce(substr(c.run, c.p, c.n), r.run) AS run,
             CASE WHEN coalesce(c.i, 0) = 0 THEN r.gap ELSE '' END AS gap,
             row_number() OVER (PARTITION BY r.query_id, r.rank ORDER BY r.at, c.i) - 1 AS pos
      FROM text_runs r LEFT JOIN cut c ON c.run = r.run),
    {_SQL_CHOSEN},
    marked AS (
      SELECT b.query_id, b.rank, max(f.e) AS e, string_agg(f.gap || CASE WHEN q.term IS NOT NULL
        THEN '<font color=''red''>' || f.run || '</font>' ELSE f.run END, '' ORDER BY f.pos) AS s
      FROM best b JOIN fragged f ON f.query_id = b.query_id AND f.rank = b.rank AND f.frag = b.frag
      LEFT JOIN query_terms q ON q.query_id = f.query_id AND q.term = f.run GROUP BY b.query_id, b.rank)
    SELECT h.query_id, h.rank, h.score, h.doc_id, d.url, d.title,
           m.s || CASE WHEN c.frag_end IS NULL THEN substr(t.text, CAST(m.e AS BIGINT) + 1) ELSE '' END AS snippet
    FROM hits h JOIN docs d ON d.doc_id = h.doc_id
    JOIN texts t ON t.query_id = h.query_id AND t.rank = h.rank
    LEFT JOIN marked m ON m.query_id = h.query_id AND m.rank = h.rank
    LEFT JOIN chosen c ON c.query_id = h.query_id AND c.rank = h.rank""",
)
def _search_segmented(spark: SparkSession, folder: str) -> DataFrame:
    """Hits and snippets of an index that is searched by dictionary words."""
    analyser = han_analyser(spark, folder)
    asked = I.user_queries(spark, folder).select("query_id", in_han("text").alias("text"))
    index = segmented_index(spark, folder)
    found = S.search(index, S.clauses_of_tokens(analyser.tokens(asked, "text", ["query_id"])))
    return search_snippets(found, index, analyser=analyser)
