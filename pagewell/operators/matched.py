"""Best documents of queries of terms, synonyms and phrases that may be required or refused, kept task by task.

Rows of query, clause and document would be as many as a frequent word has documents, for every query that asks for it. Here
the terms of a task's documents meet the clauses in arrays, the clauses of a query are put together where the document
lies, and of each query only the best documents stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pagewell.operators import weighted
from pagewell.operators.phrases import frequencies

SHOULD, MUST, MUST_NOT = range(3)


def _by_key(key: np.ndarray, n: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the rows of each of ``n`` keys begin, and the columns in that order."""
    order = np.argsort(key, kind="stable")
    return np.append(0, np.cumsum(np.bincount(key, minlength=n))), *[c[order] for c in columns]


def held_clauses(leaves: pa.Table, n_terms: int, gain: float, phrases: tuple[dict, pa.Table] | None = None) -> dict:
    """What a task needs of rows ``number, query_id, clause_id, grouped, occur, n_must, weight``, a term of a clause each.

    Terms have the numbers below ``n_terms``. Found ``tf`` times, one gives ``weight * gain * tf / (tf + norm)``; the terms of
    a clause that are ``grouped`` count as one. ``phrases`` are those held for :func:`phrases.frequencies` and the clauses
    ``phrase, query_id, occur, n_must, weight`` that ask for them, which count as terms do.
    """
    columns = {c: leaves.column(c).to_numpy(zero_copy_only=False) for c in leaves.column_names}
    asked = {} if phrases is None else {c: phrases[1].column(c).to_numpy() for c in phrases[1].column_names}
    every = {c: np.append(columns[c], asked.get(c, columns[c][:0])) for c in ("query_id", "n_must")}
    queries, query = np.unique(every["query_id"], return_inverse=True)
    n_must = np.zeros(len(queries), np.int64)
    n_must[query] = every["n_must"]
    query, of_phrase = np.split(query, [len(columns["query_id"])])
    term, occur, grouped, weight = (columns[c] for c in ("number", "occur", "grouped", "weight"))
    alone = []
    for what in (SHOULD, MUST, MUST_NOT):
        mine = (occur == what) & ~grouped
        alone.append(_by_key(term[mine], n_terms, query[mine], weight[mine]))
    clauses, clause = np.unique(columns["clause_id"], return_inverse=True)
    _, at, group = np.unique(((query * len(clauses) + clause) * 3 + occur)[grouped], return_index=True, return_inverse=True)
    most = np.zeros(len(at))
    np.maximum.at(most, group, weight[grouped])
    groups = {"query": query[grouped][at], "occur": occur[grouped][at], "weight": most, "terms": _by_key(term[grouped], n_terms, group)}
    held = {"queries": queries, "n_must": n_must, "alone": alone, "groups": groups, "gain": gain, "phrases": None}
    if phrases is not None:
        place = np.searchsorted(phrases[0]["phrases"], asked["phrase"])
        held["phrases"] = phrases[0]
        held["asked"] = _by_key(place, len(phrases[0]["phrases"]), of_phrase, asked["occur"], asked["weight"])
    return held


def _met(first: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and the entries of their terms, ``_PRODUCTS`` of them at once."""
    size = first[term + 1] - first[term]
    for start, end in weighted.pieces(size):
        part = size[start:end]
        row = np.repeat(np.arange(start, end), part)
        yield row, np.arange(len(row)) + np.repeat(first[term[start:end]] - (np.cumsum(part) - part), part)


class _Cells:
    """Scores of some documents and all queries, and what tells whether a document answers a query."""

    def __init__(self, held: dict, n_docs: int) -> None:
        self.n_must, self.shape = held["n_must"], (n_docs, len(held["queries"]))
        self.n = n_docs * len(held["queries"])
        self.scores, self.matched = np.zeros(self.n), np.zeros(self.n, bool)
        self.musts = self.refused = None

    def add(self, occur: int, cell: np.ndarray, score: np.ndarray | None) -> None:
        """Matches of clauses: a refused one has no score."""
        if occur == MUST_NOT:
            self.refused = np.zeros(self.n, bool) if self.refused is None else self.refused
            self.refused[cell] = True
            return
        self.scores += np.bincount(cell, score, self.n)
        self.matched[cell] = True
        if occur == MUST:
            times = np.bincount(cell, minlength=self.n)
            self.musts = times if self.musts is None else self.musts + times

    def found(self) -> np.ndarray:
        """All required clauses match and no refused one; without required ones any optional clause does."""
        found = self.matched.reshape(self.shape)
        if self.musts is not None:
            found = found & (self.musts.reshape(self.shape) == self.n_must)
        elif self.n_must.any():
            found = found & (self.n_must == 0)
        return found if self.refused is None else found & ~self.refused.reshape(self.shape)


def _scored(held: dict, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, norm: np.ndarray, n_docs: int) -> _Cells:
    cells, n = _Cells(held, n_docs), len(held["queries"])
    own = held["gain"] * tf / (tf + norm)
    for occur, (first, query, weight) in enumerate(held["alone"]):
        if len(query):
            for row, pair in _met(first, term):
                cells.add(occur, doc[row] * n + query[pair], None if occur == MUST_NOT else own[row] * weight[pair])
    groups = held["groups"]
    if len(groups["query"]):
        at, own = _of_groups(held, doc, term, tf, norm, n_docs)
        cell = (np.arange(n_docs)[:, None] * n + groups["query"]).ravel()[at]
        group = np.broadcast_to(np.arange(len(groups["query"])), (n_docs, len(groups["query"]))).ravel()[at]
        score = own * groups["weight"][group]
        for occur in np.unique(groups["occur"]):
            mine = slice(None) if (groups["occur"] == occur).all() else groups["occur"][group] == occur
            cells.add(int(occur), cell[mine], None if occur == MUST_NOT else score[mine])
    return cells


def _of_groups(held: dict, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, norm: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a document and a group that meet, numbered document by document, and their shares of the score."""
    n = len(held["groups"]["query"])
    times, norms = np.zeros(n_docs * n), np.zeros(n_docs * n)
    first, group = held["groups"]["terms"]
    for row, pair in _met(first, term):
        cell = doc[row] * n + group[pair]
        times += np.bincount(cell, tf[row], n_docs * n)
        np.maximum.at(norms, cell, norm[row])
    at = np.flatnonzero(times)
    return at, held["gain"] * times[at] / (times[at] + norms[at])


def _phrases(held: dict, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the first words of the phrases found, the phrases and their shares of the score, in the order of rows."""
    # A document without a number has no phrases.
    numbered = np.flatnonzero((rows.column("batch_id").to_numpy() != weighted._NONE) & (rows.column("doc_id").to_numpy() != weighted._NONE))
    row, phrase, times = frequencies(held["phrases"], rows if len(numbered) == len(rows) else rows.take(pa.array(numbered)))
    row = numbered[row]
    order = np.argsort(row, kind="stable")
    row, phrase, times = row[order], phrase[order], times[order]
    return row, phrase, held["gain"] * times / (times + rows.column("norm").to_numpy()[row])


def _add_phrases(held: dict, cells: _Cells, doc: np.ndarray, phrase: np.ndarray, own: np.ndarray) -> None:
    first, query, occur, weight = held["asked"]
    for row, pair in _met(first, phrase):
        cell, score = doc[row] * len(held["queries"]) + query[pair], own[row] * weight[pair]
        for what in np.unique(occur[pair]):
            mine = occur[pair] == what
            cells.add(int(what), cell[mine], None if what == MUST_NOT else score[mine])


def _add_documents(held: dict, best: weighted.Best, rows: pa.Table) -> None:
    """Add documents, each as the rows of its terms."""
    batch_id, doc_id, term, tf, norm = (rows.column(c).to_numpy() for c in ("batch_id", "doc_id", "number", "tf", "norm"))
    first = np.flatnonzero(np.append(True, (batch_id[1:] != batch_id[:-1]) | (doc_id[1:] != doc_id[:-1])))
    ends = np.append(first[1:], len(term))
    doc = np.repeat(np.arange(len(first)), ends - first)
    found = None if held["phrases"] is None else _phrases(held, rows)
    most = max(1, weighted._CELLS // max(len(held["queries"]), len(held["groups"]["query"])))
    for start in range(0, len(first), most):
        end = min(start + most, len(first))
        mine = slice(first[start], ends[end - 1])
        cells = _scored(held, doc[mine] - start, term[mine], tf[mine], norm[mine], end - start)
        if found is not None:
            here = slice(*np.searchsorted(found[0], [mine.start, mine.stop]))
            _add_phrases(held, cells, doc[found[0][here]] - start, found[1][here], found[2][here])
        best.add(cells.scores.reshape(cells.shape), cells.found(), batch_id[first[start:end]], doc_id[first[start:end]])


def best_of_task(held: Callable[[], dict], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task over rows ``batch_id, doc_id, number, tf, norm`` in the order of documents, with ``positions`` where phrases are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held()
        best = weighted.Best(len(table["queries"]), k)
        for rows in weighted.whole_documents(batches):
            _add_documents(table, best, rows)
        yield best.batch(table["queries"])

    return run
