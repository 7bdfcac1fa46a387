"""Token tables: positions, dictionary segmentation, synonyms and readings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from pagewell.functions.text import TOKEN, let, runs, tokens
from pagewell.operators.joins import lookup_join
from pagewell.session import stage

_HAN_ONLY = r"^\p{IsHan}+\z"
# Words of a dictionary that every task may hold.
DICTIONARY_WORDS = 200_000


def tokenize(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys, pos, term``: lower-cased tokens with their position in the text."""
    return docs.select(*keys, F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def token_offsets(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys, pos, run, gap_len``: runs in their written case with the length of the gap before.

    Running sums of the lengths give each run's offsets in the text.
    """
    pieces = F.arrays_zip(
        F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)).alias("run"),
        F.transform(F.split(F.col(text), TOKEN), F.length).alias("gap_len"),
    )
    exploded = docs.select(*keys, F.posexplode(pieces).alias("pos", "p"))
    return exploded.select(
        *keys, "pos", F.col("p.run").alias("run"), F.col("p.gap_len").alias("gap_len")
    ).filter(F.col("run").isNotNull())


def word_prefixes(dictionary: DataFrame) -> DataFrame:
    """``prefix, best``: every beginning, from two characters on, of the words of ``dictionary(word)``.

    ``best`` is the length of the longest word that the prefix itself begins with, 0 if there is none.
    """
    words = dictionary.select("word").filter(F.length("word") > 1).distinct()

    def beginnings(of: str) -> Column:
        lengths = F.sequence(F.lit(2), F.length(of))
        return F.explode(F.transform(lengths, lambda n: F.substring(F.col(of), F.lit(1), n)))

    prefixes = words.select(beginnings("word").alias("prefix")).distinct()
    known = prefixes.select("prefix", beginnings("prefix").alias("word")).join(words, "word")
    best = known.groupBy("prefix").agg(F.max(F.length("word")).alias("best"))
    return prefixes.join(best, "prefix", "left").select("prefix", F.coalesce("best", F.lit(0)).alias("best"))


def segment_dict(docs: DataFrame, text: str, keys: list[str], dictionary: DataFrame) -> DataFrame:
    """``keys, run_pos, i, term`` with Han runs cut by forward maximum matching.

    At every character the longest word of ``dictionary(word)`` that starts there is taken,
    or the single character; ``i`` counts the words of a run. A text is cut in its own row while the
    dictionary has at most ``DICTIONARY_WORDS`` words.
    """
    words = held_words(dictionary)
    if words is not None:
        texts = docs.select(*keys, F.col(text).alias("_text"))
        # A row that comes twice is one text; only then are texts moved.
        if not texts.groupBy(*keys).count().filter("count > 1").isEmpty():
            texts = texts.dropDuplicates()
        cut = cut_runs(texts.select(*keys, runs(F.col("_text")).alias("runs")), words)
        by_run = cut.select(*keys, F.posexplode("cut").alias("run_pos", "words"))
        return by_run.select(*keys, "run_pos", F.posexplode("words").alias("i", "term"))
    located = docs.select(*keys, F.posexplode(runs(F.col(text))).alias("run_pos", "run"))
    return segment_runs(located, keys, dictionary)


def held_words(dictionary: DataFrame) -> list[str] | None:
    """The words of two characters or more, where there are at most ``DICTIONARY_WORDS`` of them."""
    words = dictionary.select("word").filter(F.length("word") > 1).distinct().limit(DICTIONARY_WORDS + 1).collect()
    return [r["word"] for r in words] if len(words) <= DICTIONARY_WORDS else None


def _cutter(words: list[str]) -> Callable[[str], list[str]]:
    """Forward maximum matching of one run; only lengths of words that start with the pair at hand are tried."""
    known, lengths = set(words), {}
    for word in words:
        lengths.setdefault(word[:2], set()).add(len(word))
    longest_first = {pair: sorted(found, reverse=True) for pair, found in lengths.items()}

    def cut(run: str) -> list[str]:
        out, at = [], 0
        while at < len(run):
            fitting = (n for n in longest_first.get(run[at : at + 2], ()) if run[at : at + n] in known)
            n = next(fitting, 1)
            out.append(run[at : at + n])
            at += n
        return out

    return cut


def cut_runs(rows: DataFrame, words: list[str]) -> DataFrame:
    """``rows`` with an array ``runs``, and in place of it ``cut``: the words of each run.

    A batch cuts each of its different runs once.
    """
    flagged = rows.withColumn("is_han", F.transform("runs", lambda r: r.rlike(_HAN_ONLY)))
    kept = [c for c in rows.columns if c != "runs"]
    schema = StructType([rows.schema[c] for c in kept]).add("cut", ArrayType(ArrayType(StringType())))
    held = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(held.value)
        for batch in batches:
            listed = batch.column("runs")
            sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy()
            coded = pc.list_flatten(listed).dictionary_encode()
            codes = coded.indices.to_numpy()
            han = np.zeros(len(coded.dictionary), dtype=bool)
            han[codes[pc.list_flatten(batch.column("is_han")).to_numpy(zero_copy_only=False).astype(bool)]] = True
            each = [cut(r) if h else [r] for r, h in zip(coded.dictionary.to_pylist(), han)]
            taken = pa.array(each, pa.list_(pa.string())).take(coded.indices)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(ends), taken)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], whole], names=[*kept, "cut"])

    return flagged.mapInArrow(run, schema)


def segment_runs(located: DataFrame, keys: list[str], dictionary: DataFrame) -> DataFrame:
    """``keys, run_pos, i, term`` of the runs ``keys, run_pos, run``; see :func:`segment_dict`.

    With a dictionary that tasks can hold each run is cut where it is. Else characters whose pair begins no word drop out at once. The others, a row each, look for the longest
    prefix known there: prefixes of a known one are known too, so its length is found by halving steps.
    """
    words = held_words(dictionary)
    if words is not None:
        cut = cut_runs(located.select(*keys, "run_pos", F.array("run").alias("runs")), words)
        return cut.select(*keys, "run_pos", F.posexplode(F.get("cut", F.lit(0))).alias("i", "term"))
    prefixes = stage(word_prefixes(dictionary), "prefixes")
    n_prefixes, longest = prefixes.agg(F.count(F.lit(1)), F.max(F.length("prefix"))).first()
    is_han = F.col("run").rlike(_HAN_ONLY)
    at = F.explode(F.sequence(F.lit(1), F.length("run") - 1))
    where = [*keys, "run_pos", "at"]

    def probed(rows: DataFrame, step: int) -> DataFrame:
        """Rows whose known prefix is longer by ``step`` where that one is known too."""
        further = F.substring(F.col("run"), F.col("at"), F.col("n") + step)
        fits = F.col("at") + F.col("n") + (step - 1) <= F.length("run")
        asked = rows.withColumn("prefix", F.when(fits, further))
        met = lookup_join(asked, prefixes.withColumnRenamed("best", "_best"), ["prefix"], where, "left", n_prefixes)
        return met.select(
            *where,
            "run",
            (F.col("n") + F.when(F.col("_best").isNotNull(), step).otherwise(0)).alias("n"),
            F.coalesce("_best", "best").alias("best"),
        )

    starts = located.filter(is_han & (F.length("run") > 1)).select(*keys, "run_pos", "run", at.alias("at"))
    starts = starts.withColumn("n", F.lit(0)).withColumn("best", F.lit(None).cast("int"))
    found = probed(starts, 2).filter("n > 0")
    step = 1 << max((longest or 0) - 2, 0).bit_length()
    while step > 1:
        step //= 2
        found = probed(found, step)
    # The entry at 0 stands for the run itself, whether or not a word is found in it.
    none = F.lit(0)
    steps = (
        located.select(*keys, "run_pos", none.alias("at"), none.alias("neg_len"), "run")
        .unionByName(
            found.filter("best > 0").select(
                *where, (-F.col("best")).alias("neg_len"), F.lit(None).cast("string").alias("run")
            )
        )
        .groupBy(*keys, "run_pos")
        .agg(F.sort_array(F.collect_list(F.struct("at", "neg_len", "run"))).alias("steps"))
    )
    run = F.get("steps", F.lit(0))["run"]
    cut = F.when(run.rlike(_HAN_ONLY), let(run, lambda r: _greedy_words(r, F.col("steps")))).otherwise(
        F.array(run)
    )
    return steps.select(*keys, "run_pos", F.posexplode(cut).alias("i", "term"))


def _greedy_words(run: Column, steps: Column) -> Column:
    """Walk the words found in ``run`` from the left; characters between them stand alone."""
    begin = F.struct(F.lit(1).alias("free"), F.array().cast("array<string>").alias("words"))

    def singles(start: Column, end: Column) -> Column:
        return F.when(
            end >= start, F.transform(F.sequence(start, end), lambda i: F.substring(run, i, F.lit(1)))
        ).otherwise(F.array().cast("array<string>"))

    def step(state: Column, s: Column) -> Column:
        word = F.array(F.substring(run, s["at"], -s["neg_len"]))
        taken = F.struct(
            (s["at"] - s["neg_len"]).alias("free"),
            F.concat(state["words"], singles(state["free"], s["at"] - 1), word).alias("words"),
        )
        return F.when((s["at"] > 0) & (s["at"] >= state["free"]), taken).otherwise(state)

    return F.aggregate(
        steps,
        begin,
        step,
        lambda state: F.concat(state["words"], singles(state["free"], F.length(run))),
    )


def _expand(token_table: DataFrame, table: DataFrame, term: str, added: str, keys: list[str]) -> DataFrame:
    """Each token followed by those added to it, in one pass over the tokens."""
    extra = table.filter(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(
        F.collect_list(F.struct(F.col(added).alias("term"), F.lit(True).alias("is_overlap"))).alias("_added")
    )
    expanded = _with_added(token_table, extra, [*keys, "pos"], [*keys, "pos"])
    # Known to this table only, and to none that is made from it.
    expanded._made_of = (token_table, extra)
    return expanded


def _with_added(rows: DataFrame, extra: DataFrame, kept: list[str], salt_on: list[str]) -> DataFrame:
    """``kept, term, is_overlap``: each row by its term, then by the terms that ``extra(term, _added)`` adds to it."""
    own = F.array(F.struct("term", _overlap_flag(rows).alias("is_overlap")))
    met = lookup_join(rows, extra, ["term"], salt_on, "left")
    both = F.when(F.col("_added").isNull(), own).otherwise(F.concat(own, "_added"))
    return met.select(*kept, F.explode(both).alias("t")).select(*kept, "t.*")


def term_counts(token_table: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, term, tf, positions, dl`` of a token table; ``dl`` counts the tokens of a text that were not added.

    The tokens of a table that others were added to are counted first, and each different one of a text takes its additions
    once, with its count and positions.
    """
    tokens, extra = getattr(token_table, "_made_of", (None, None))
    if tokens is None:
        own = F.sum(F.when(_overlap_flag(token_table), 0).otherwise(1)).alias("own")
        listed = F.sort_array(F.collect_list("pos")).alias("positions")
        per_term = token_table.dropna(subset=keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"), listed, own)
        return per_term.withColumn("dl", F.sum("own").over(Window.partitionBy(*keys))).drop("own")
    found = _with_added(term_counts(tokens, keys), extra, [*keys, "tf", "positions", "dl"], keys)
    listed = F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    return found.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"), listed, F.max("dl").alias("dl"))


def _overlap_flag(token_table: DataFrame) -> Column:
    return F.col("is_overlap") if "is_overlap" in token_table.columns else F.lit(False)


def expand_synonyms(token_table: DataFrame, synonyms: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens plus, at the same position, the synonyms of each from ``synonyms(term, syn)``."""
    return _expand(token_table, synonyms, "term", "syn", keys)


def expand_readings(token_table: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens plus, at the same position, the reading of each from ``readings(term, reading)``."""
    return _expand(token_table, readings, "term", "reading", keys)


def analyse(
    docs: DataFrame,
    text: str,
    keys: list[str],
    dictionary: DataFrame | None = None,
    synonyms: DataFrame | None = None,
    readings: DataFrame | None = None,
) -> DataFrame:
    """``keys, pos, term, is_overlap``: the token table that documents and queries are searched by.

    Han runs give dictionary words where a ``dictionary(word)`` is given, else overlapping pairs; then
    each token's synonyms and readings stand at its position. ``keys`` identify a row of ``docs``.
    """
    if dictionary is None:
        table = tokenize(docs, text, keys)
    else:
        arrays = term_arrays(docs, text, keys, dictionary)
        if arrays is not None:
            table = arrays.select(*keys, F.posexplode("terms").alias("pos", "term"))
            return _expanded(table.withColumn("is_overlap", F.lit(False)), keys, synonyms, readings)
        lower = docs.select(*keys, F.lower(text).alias("_text"))
        in_text = Window.partitionBy(*keys).orderBy("run_pos", "i")
        table = segment_dict(lower, "_text", keys, dictionary).select(
            *keys, (F.row_number().over(in_text) - 1).alias("pos"), "term"
        )
    return _expanded(table.withColumn("is_overlap", F.lit(False)), keys, synonyms, readings)


def term_arrays(docs: DataFrame, text: str, keys: list[str], dictionary: DataFrame | None = None) -> DataFrame | None:
    """``keys, terms``: the tokens of each text in order, none of them added; ``None`` for a dictionary too large to hold."""
    if dictionary is None:
        return docs.select(*keys, tokens(F.col(text)).alias("terms"))
    words = held_words(dictionary)
    if words is None:
        return None
    cut = cut_runs(docs.select(*keys, runs(F.lower(text)).alias("runs")), words)
    return cut.select(*keys, F.flatten("cut").alias("terms"))


def _expanded(table: DataFrame, keys: list[str], synonyms: DataFrame | None, readings: DataFrame | None) -> DataFrame:
    if synonyms is not None:
        table = expand_synonyms(table, synonyms, keys)
    return table if readings is None else expand_readings(table, readings, keys)


@dataclass(frozen=True)
class Analyser:
    """The tables that documents, queries and snippets are analysed with; each may be missing.

    The same analyser belongs to the index, to the queries asked of it and to their snippets.
    """

    dictionary: DataFrame | None = None
    synonyms: DataFrame | None = None
    readings: DataFrame | None = None

    @property
    def is_plain(self) -> bool:
        """True when the tokens are those of the text alone."""
        return self.dictionary is None and self.synonyms is None and self.readings is None

    def tokens(self, docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
        """``keys, pos, term, is_overlap``, see :func:`analyse`."""
        return analyse(docs, text, keys, self.dictionary, self.synonyms, self.readings)

    def arrays(self, docs: DataFrame, text: str, keys: list[str]) -> DataFrame | None:
        """``keys, terms`` where no token is added to those of the text, see :func:`term_arrays`; else ``None``."""
        adds = self.synonyms is not None or self.readings is not None
        return None if adds else term_arrays(docs, text, keys, self.dictionary)

    def pieces(self, docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
        """``keys, pos, run, gap_len``: as :func:`token_offsets`, with Han runs cut into the dictionary's words."""
        located = token_offsets(docs, text, keys)
        if self.dictionary is None:
            return located
        carried = [*keys, "gap_len"]
        cut = segment_runs(located.withColumnRenamed("pos", "run_pos"), carried, self.dictionary)
        in_text = Window.partitionBy(*keys).orderBy("run_pos", "i")
        return cut.select(
            *keys,
            (F.row_number().over(in_text) - 1).alias("pos"),
            F.col("term").alias("run"),
            F.when(F.col("i") == 0, F.col("gap_len")).otherwise(0).alias("gap_len"),
        )

    def terms(self, pieces: DataFrame, keys: list[str]) -> DataFrame:
        """``keys, pos, term`` of pieces with a ``pos`` and a ``run``: its tokens, their synonyms and readings."""
        own = tokens(F.col("run")) if self.dictionary is None else runs(F.col("run"))
        table = pieces.select(*keys, "pos", F.explode(own).alias("term"))
        if self.synonyms is None and self.readings is None:
            return table
        table = table.withColumn("is_overlap", F.lit(False))
        return _expanded(table, keys, self.synonyms, self.readings).drop("is_overlap")
