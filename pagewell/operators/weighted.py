"""Best documents of queries whose scores add up over single terms, kept task by task.

A document meets most queries through its frequent terms, so rows of query, document and term would be as many as all
of them multiplied. Here the terms of a task's documents pass in the order of the documents, meet the queries in arrays,
and of each query only the best documents stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Scores of documents and queries, products of terms and queries, and rows that are held at once.
_CELLS = 500_000
_PRODUCTS = 1_000_000
_ROWS = 50_000
# Stands for a document without a number, which comes first.
_NONE = np.iinfo(np.int64).min


def held_pairs(pairs: pa.Table) -> dict[str, np.ndarray]:
    """Queries and weights of each term, from rows ``number, query_id, weight``."""
    terms, term = np.unique(pairs.column("number").to_numpy(), return_inverse=True)
    queries, query = np.unique(pairs.column("query_id").to_numpy(), return_inverse=True)
    order = np.argsort(term, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(term, minlength=len(terms))))
    weight = pairs.column("weight").to_numpy()[order]
    return {"terms": terms, "first": first, "queries": queries, "query": query[order].astype(np.int32), "weight": weight}


class Best:
    """The best ``k`` of ``n`` queries' documents that come in order: a later one takes a place only by a higher score."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.seen, self.waiting = n, k, 0, 0
        self.floor = np.full(n, -np.inf)
        self.kept: list[tuple[np.ndarray, ...]] = []

    def add(self, scores: np.ndarray, found: np.ndarray | None, batch_id: np.ndarray, doc_id: np.ndarray) -> None:
        """Scores by document and query, of those ``found``; where that is ``None`` all scores but 0 are."""
        least = self.floor - 1e-6
        near = scores > np.maximum(least, 0.0) if found is None else found & (scores > least)
        at, query = np.nonzero(near)
        score = np.round(scores[at, query], 6)
        higher = score > self.floor[query]
        at, query, score = at[higher], query[higher], score[higher]
        self.kept.append((query, score, self.seen + at, batch_id[at], doc_id[at]))
        self.seen += len(batch_id)
        self.waiting += len(at)
        if self.waiting > self.n * self.k:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """``query, score, place, batch_id, doc_id`` of the best so far."""
        if not self.kept:
            self.kept.append((np.zeros(0, np.int64), np.zeros(0), *[np.zeros(0, np.int64)] * 3))
        rows = [np.concatenate(c) for c in zip(*self.kept, strict=True)]
        order = np.lexsort((rows[2], -rows[1], rows[0]))
        query = rows[0][order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[rank < self.k]
        best = tuple(c[order] for c in rows)
        last = rank[rank < self.k] == self.k - 1
        self.floor[best[0][last]] = best[1][last]
        self.kept, self.waiting = [best], 0
        return best

    def batch(self, queries: np.ndarray) -> pa.RecordBatch:
        """``query_id, score, batch_id, doc_id`` of the best, in which ``queries`` are numbered."""
        query, score, _, batch_id, doc_id = self.cut()
        numbers = [pa.array(c, mask=c == _NONE) for c in (batch_id, doc_id)]
        asked = pa.array(queries[query].astype(np.int32))
        return pa.RecordBatch.from_arrays([asked, pa.array(score), *numbers], names=["query_id", "score", "batch_id", "doc_id"])


def pieces(size: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose sizes add up to at most ``most``, by default ``_PRODUCTS``, or of one row."""
    upto, start = np.cumsum(size), 0
    while start < len(size):
        before = upto[start] - size[start]
        end = max(start + 1, int(np.searchsorted(upto, before + (most or _PRODUCTS), side="right")))
        yield start, end
        start = end


def _products(held: dict[str, np.ndarray], own: np.ndarray, term: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores of some documents, and which are found where a weight is not above 0."""
    n, positive = len(held["queries"]), bool((held["weight"] > 0).all())
    size = held["first"][term + 1] - held["first"][term]
    scores, found = np.zeros(n_docs * n), None if positive else np.zeros(n_docs * n, bool)
    for start, end in pieces(size):
        part = size[start:end]
        pair = np.arange(part.sum()) + np.repeat(held["first"][term[start:end]] - (np.cumsum(part) - part), part)
        cell = np.repeat(doc[start:end] * n, part) + held["query"][pair]
        scores += np.bincount(cell, np.repeat(own[start:end], part) * held["weight"][pair], n_docs * n)
        if found is not None:
            found[cell] = True
    shape = (n_docs, n)
    return scores.reshape(shape), None if found is None else found.reshape(shape)


def _add_documents(held: dict[str, np.ndarray], best: Best, batch_id: np.ndarray, doc_id: np.ndarray, number: np.ndarray, own: np.ndarray) -> None:
    """Add documents, each as the rows of its terms."""
    if not len(held["terms"]):
        return
    term = np.minimum(np.searchsorted(held["terms"], number), len(held["terms"]) - 1)
    asked = held["terms"][term] == number
    batch_id, doc_id, term, own = batch_id[asked], doc_id[asked], term[asked], own[asked]
    if not len(term):
        return
    first = np.flatnonzero(np.append(True, (batch_id[1:] != batch_id[:-1]) | (doc_id[1:] != doc_id[:-1])))
    ends = np.append(first[1:], len(term))
    doc = np.repeat(np.arange(len(first)), ends - first)
    upto = np.cumsum(held["first"][term + 1] - held["first"][term])[ends - 1]
    most, start = max(1, _CELLS // len(held["queries"])), 0
    while start < len(first):
        before = upto[start - 1] if start else 0
        end = max(start + 1, min(start + most, int(np.searchsorted(upto, before + _PRODUCTS, side="right"))))
        rows = slice(first[start], ends[end - 1])
        scores, found = _products(held, own[rows], term[rows], doc[rows] - start, end - start)
        best.add(scores, found, batch_id[first[start:end]], doc_id[first[start:end]])
        start = end


def whole_documents(batches: Iterator[pa.RecordBatch], at_once: int = _ROWS) -> Iterator[pa.Table]:
    """Rows in the order of ``batch_id, doc_id`` in groups that cut no document; ``_NONE`` stands for a document without a number."""
    waiting: list[pa.Table] = []
    n, more = 0, at_once
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for name in ("batch_id", "doc_id"):
            rows = rows.set_column(rows.column_names.index(name), name, pc.fill_null(rows.column(name).cast(pa.int64()), _NONE))
        waiting.append(rows)
        n += len(rows)
        if n >= more:
            rows = pa.concat_tables(waiting).combine_chunks()
            keys = [rows.column(c).to_numpy() for c in ("batch_id", "doc_id")]
            last = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield rows.slice(0, cut)
            waiting = [rows.slice(cut)]
            n -= cut
            # A long document is not looked through again at each batch.
            more = max(at_once, 2 * n)
    if n:
        yield pa.concat_tables(waiting).combine_chunks()


def best_of_task(held: Callable[[], dict[str, np.ndarray]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task over rows ``batch_id, doc_id, number, own`` in the order of documents: a term's share of the score before its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held()
        best = Best(len(table["queries"]), k)
        for rows in whole_documents(batches):
            _add_documents(table, best, *[rows.column(c).to_numpy() for c in ("batch_id", "doc_id", "number", "own")])
        yield best.batch(table["queries"])

    return run
