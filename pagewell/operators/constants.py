"""Best documents of queries whose clauses all give a constant, kept task by task.

A frequent range meets nearly every document, so rows of query and document would be as many as both multiplied.
Here the documents of a task pass one after the other, in their order, and of each query only the best stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CELLS = 2_000_000
# Stands for a document without a number, which comes first.
_NONE = np.iinfo(np.int64).min


def held_patterns(asked: pa.Table, stretches: pa.Table | None, singles: pa.Table | None) -> dict[str, np.ndarray]:
    """Arrays that a task needs: clauses ``query, pattern, weight``, stretches of segments ``lo, hi`` by pattern, and terms that stand alone."""
    queries, query = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
    patterns, pattern = np.unique(asked.column("pattern").to_numpy(), return_inverse=True)
    lo, hi = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
    if stretches is not None:
        place = np.searchsorted(patterns, stretches.column("pattern").to_numpy())
        lo[place], hi[place] = stretches.column("lo_number").to_numpy(), stretches.column("hi_number").to_numpy()
    segment = np.zeros(0, np.int64) if singles is None else singles.column("node").to_numpy()
    own = np.zeros(0, np.int64) if singles is None else np.searchsorted(patterns, singles.column("pattern").to_numpy())
    order = np.argsort(segment, kind="stable")
    alone, first = np.unique(segment[order], return_index=True)
    return {
        "queries": queries, "query": query, "pattern": pattern, "weight": asked.column("weight").to_numpy(),
        "lo": lo, "hi": hi, "alone": alone, "first": np.append(first, len(segment)), "alone_patterns": own[order],
    }


def document_scores(held: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Scores of all queries for a document with some segments; -1 where no clause matches."""
    n, last = len(held["queries"]), int(held["hi"].max(initial=0))

    def scores(segments: np.ndarray) -> np.ndarray:
        seen = np.zeros(last + 1, np.int32)
        inside = segments[(segments >= 0) & (segments < last)]
        seen[inside + 1] = 1
        before = np.cumsum(seen)
        hit = before[held["hi"]] > before[held["lo"]]
        for segment in segments[segments < 0]:
            at = np.searchsorted(held["alone"], segment)
            if at < len(held["alone"]) and held["alone"][at] == segment:
                hit[held["alone_patterns"][held["first"][at] : held["first"][at + 1]]] = True
        met = hit[held["pattern"]]
        found = np.bincount(held["query"][met], minlength=n) > 0
        total = np.bincount(held["query"][met], weights=held["weight"][met], minlength=n)
        return np.where(found, np.round(total, 6), -1.0)

    return scores


def best_documents(held: dict[str, np.ndarray], k: int, rows: Iterator[tuple[int, int, np.ndarray]]) -> dict[str, np.ndarray]:
    """``query_id, score, batch_id, doc_id`` of each query's best ``k`` of ``rows``, which come in the order of documents."""
    scores, n = document_scores(held), len(held["queries"])
    best, place = np.full((k, n), -1.0), np.zeros((k, n), np.int64)
    keys: list[tuple[int, int]] = []
    chunk: list[np.ndarray] = []

    def merge() -> None:
        # A later document takes a place only by a higher score.
        block = np.stack(chunk)
        better = np.flatnonzero(block.max(axis=0) > best[-1])
        numbers = np.broadcast_to(np.arange(len(keys) - len(chunk), len(keys))[:, None], (len(chunk), len(better)))
        both = np.concatenate([best[:, better], block[:, better]])
        both_place = np.concatenate([place[:, better], numbers])
        order = np.argsort(-both, axis=0, kind="stable")[:k]
        best[:, better] = np.take_along_axis(both, order, 0)
        place[:, better] = np.take_along_axis(both_place, order, 0)
        chunk.clear()

    for batch_id, doc_id, segments in rows:
        keys.append((batch_id, doc_id))
        chunk.append(scores(segments))
        if len(chunk) * n >= _CELLS:
            merge()
    if chunk:
        merge()
    at, query = np.nonzero(best >= 0)
    taken = np.array(keys, np.int64).reshape(-1, 2)[place[at, query]]
    return {"query_id": held["queries"][query], "score": best[at, query], "batch_id": taken[:, 0], "doc_id": taken[:, 1]}


def best_of_task(held: Callable[[], dict[str, np.ndarray]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task over rows ``batch_id, doc_id, segments`` in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            numbers = [pc.fill_null(batch.column(c).cast(pa.int64()), _NONE).to_numpy() for c in ("batch_id", "doc_id")]
            sizes = pc.list_value_length(batch.column("segments")).to_numpy()
            flat, ends = pc.list_flatten(batch.column("segments")).to_numpy(), np.cumsum(sizes)
            for i in range(len(sizes)):
                yield int(numbers[0][i]), int(numbers[1][i]), flat[ends[i] - sizes[i] : ends[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = best_documents(held(), k, rows(batches))
        numbered = {c: pa.array(v, mask=v == _NONE) if c.endswith("_id") else pa.array(v) for c, v in found.items()}
        numbered["query_id"] = numbered["query_id"].cast(pa.int32())
        yield pa.RecordBatch.from_arrays([*numbered.values()], names=[*numbered])

    return run
