"""Best fragment of each hit, highlighted.

A text is cut into fragments of about ``snippet_length`` characters at token ends. A
fragment scores the weights of the distinct query terms in it; the best one, the earliest
among equals, becomes the snippet. Whole texts are looked at. Texts of an index that was built with an
analyser are cut and matched by the same analyser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewell.config import SearchConfig
from pagewell.functions.text import flatten_newlines, highlight_terms, let
from pagewell.operators.analysis import Analyser
from pagewell.operators.index import Index
from pagewell.operators.joins import PIN_ROWS, lookup_join, pin
from pagewell.operators.search import Ranked, fetch_stored

HIT = ["query_id", "rank"]
# Hits whose document keys are pushed into the scan of the stored documents.
_PRUNE_DOCS = 2_000
_PLAIN = Analyser()


def query_terms(leaves: DataFrame) -> DataFrame:
    """``query_id, term, weight`` of the terms a query highlights, in whatever field they match."""
    return (
        leaves.filter("occur != 'must_not'")
        .groupBy("query_id", "term")
        .agg(F.max("weight").alias("weight"))
    )


def fragments(hits: DataFrame, length: int, analyser: Analyser = _PLAIN) -> DataFrame:
    """``query_id, rank, pos, run, frag, start, end``: each run of a hit's text with its fragment.

    A run opens a new fragment when its end reaches the next multiple of ``length``, but one
    run opens at most one. ``start`` is the end of the run before.
    """
    runs = analyser.pieces(hits, "text", HIT)
    order = Window.partitionBy(*HIT).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = runs.withColumn("end", F.sum(F.col("gap_len") + F.length("run")).over(upto)).withColumn(
        "start", F.col("end") - F.length("run") - F.col("gap_len")
    )
    lag = F.when(F.col("pos") == 0, 0).otherwise(F.floor(F.col("end") / length) - F.col("pos"))
    return placed.withColumn("frag", F.col("pos") + F.min(lag).over(upto))


def best_fragment(
    hits: DataFrame,
    terms: DataFrame,
    length: int = 128,
    max_terms: int | None = None,
    analyser: Analyser = _PLAIN,
) -> DataFrame:
    """``query_id, rank, frag_start, frag_end, frag_score, terms, marks`` of the best fragment of each hit.

    ``terms`` are the query's terms found in that fragment and ``marks`` the stretches of text (``at`` from 0, and
    ``size``) that gave them. ``hits`` has ``query_id, rank, text`` and ``terms`` has ``query_id, term, weight``. The end
    of a text's last fragment is null: it takes in whatever follows. Hits without a matching
    term have no row. The windows and both sums share one exchange by hit.
    """
    located = fragments(hits, length, analyser).withColumn("size", F.length("run"))
    weighed = lookup_join(
        analyser.terms(located, [*HIT, "frag", "start", "end", "size"]),
        terms,
        ["query_id", "term"],
        HIT,
        "left",
        max_rows=max_terms,
    )
    is_match = F.col("weight").isNotNull()
    matched = F.when(is_match, F.struct("term", "weight"))
    place = F.when(is_match, F.struct((F.col("end") - F.col("size")).cast("int").alias("at"), "size"))
    scored = weighed.groupBy(*HIT, "frag").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.collect_set(matched).alias("m"),
        F.sort_array(F.collect_set(place)).alias("marks"),
    )
    score = F.round(F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["weight"]), 6)
    best = scored.groupBy(*HIT).agg(
        F.max(F.struct(score.alias("score"), (-F.col("frag")).alias("early"), "start", "end", "m", "marks")).alias("b"),
        F.max("frag").alias("last"),
    )
    end = F.when(-F.col("b.early") < F.col("last"), F.col("b.end"))
    return best.filter("b.score > 0").select(
        *HIT,
        F.col("b.start").cast("int").alias("frag_start"),
        end.cast("int").alias("frag_end"),
        F.col("b.score").alias("frag_score"),
        F.transform("b.m", lambda x: x["term"]).alias("terms"),
        F.col("b.marks").alias("marks"),
    )


def highlight_marks(text: Column, marks: Column, start: Column, open_tag: str, close_tag: str) -> Column:
    """Wrap the stretches ``marks`` of ``text``, whose first character is the one at ``start``; nothing is escaped."""

    def wrapped(whole: Column) -> Column:
        def piece(mark: Column, i: Column) -> Column:
            before = F.get(marks, i - 1)
            gap = F.coalesce(before["at"] + before["size"], start) - start
            at = mark["at"] - start
            parts = [F.substring(whole, gap + 1, at - gap), F.substring(whole, at + 1, mark["size"])]
            return F.concat(parts[0], F.lit(open_tag), parts[1], F.lit(close_tag))

        last = F.element_at(marks, -1)
        rest = F.substring(whole, last["at"] + last["size"] - start + 1, F.length(whole))
        return F.concat(F.array_join(F.transform(marks, piece), ""), rest)

    return let(text, wrapped)


def search_snippets(
    ranked: Ranked, index: Index, config: SearchConfig = SearchConfig(), analyser: Analyser = _PLAIN
) -> DataFrame:
    """``query_id, rank, score, doc_id, url, title, snippet`` of all hits; the snippet may be null.

    ``analyser`` is the one that the index was built with. With a dictionary each matching word is marked; with
    synonyms or readings alone, the whole run of text that has a match.
    """
    hits, rows = pin(ranked.hits, maybe_large=ranked.max_hits is None or ranked.max_hits > PIN_ROWS)
    docs = index.docs
    if rows is not None and len(rows) <= _PRUNE_DOCS:
        docs = docs.filter(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    stored = fetch_stored(hits, docs, ranked.max_hits).withColumn(
        "text", flatten_newlines(F.col("content"))
    )
    terms = query_terms(ranked.leaves.by_query)
    best = best_fragment(stored.select(*HIT, "text"), terms, config.snippet_length, ranked.leaves.max_by_query, analyser)
    fragment = F.substring(
        F.col("text"),
        F.col("frag_start") + 1,
        F.coalesce(F.col("frag_end"), F.length("text")) - F.col("frag_start"),
    )
    tags = config.open_tag, config.close_tag
    if analyser.is_plain:
        snippet = highlight_terms(fragment, F.col("terms"), *tags)
    else:
        snippet = highlight_marks(fragment, F.col("marks"), F.col("frag_start"), *tags)
    return stored.join(best, HIT, "left").select(
        *["query_id", "rank", "score", "doc_id", "url", "title"], snippet.alias("snippet")
    )
