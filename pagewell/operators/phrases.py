"""Phrases of many queries found in the postings of whole documents.

Two frequent words meet in most documents and stand side by side in few, so each pair of a document and a phrase is
too many. Here a task sees the positions of a document's words at once and only follows words that do stand together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagewell.operators.weighted import pieces, whole_documents

# Up to this slop the first two words of a phrase are looked for near each other; beyond it in the same document.
_NEAR = 8
FOUND = "phrase bigint, batch_id bigint, doc_id bigint, dl bigint, freq double, parts array<struct<part:int,positions:array<int>>>"
_PARTS = pa.list_(pa.struct([("part", pa.int32()), ("positions", pa.list_(pa.int32()))]))


def held_phrases(words: pa.Table, count_near: bool = False) -> dict:
    """What a task needs of rows ``phrase, part, number, slop``, the words of each phrase in the order of their parts.

    Exact phrases are a tree of their words, level by level; those that share a beginning are followed together.
    With ``count_near`` phrases of two words within a slop of ``_NEAR`` are counted too; positions of all other sloppy ones are given.
    """
    columns = {c: words.column(c).to_numpy() for c in ("phrase", "part", "number", "slop")}
    order = np.lexsort((columns["part"], columns["phrase"]))
    numbers, term = np.unique(columns["number"][order], return_inverse=True)
    phrases, first, size = np.unique(columns["phrase"][order], return_index=True, return_counts=True)
    slop = columns["slop"][order][first]
    exact = (slop == 0) | (size == 1)
    levels, alive, node = [], np.flatnonzero(exact), np.zeros(int(exact.sum()), np.int64)
    while len(alive):
        keys, node = np.unique(node * len(numbers) + term[first[alive] + len(levels)], return_inverse=True)
        over = size[alive] == len(levels) + 1
        ends = np.argsort(node[over], kind="stable")
        levels.append((keys, node[over][ends], alive[over][ends]))
        alive, node = alive[~over], node[~over]
    near = ~exact & (size == 2) & (slop <= _NEAR) & count_near
    return {
        "numbers": numbers, "term": term, "phrases": phrases, "first": first, "size": size, "slop": slop, "levels": levels,
        "near": np.flatnonzero(near), "loose": np.flatnonzero(~exact & ~near),
    }


def _among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ``wanted`` are in the sorted ``keys``, and their places."""
    place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    there = np.flatnonzero(keys[place] == wanted) if len(keys) else np.zeros(0, np.int64)
    return there, place[there]


def _spread(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a row of ``wanted`` and a place of the sorted ``keys`` with the same value."""
    low = np.searchsorted(keys, wanted, side="left")
    size = np.searchsorted(keys, wanted, side="right") - low
    own = np.repeat(np.arange(len(wanted)), size)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + low[own]


def _counted(doc: np.ndarray, phrase: np.ndarray, n_phrases: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, times = np.unique(doc * n_phrases + phrase, return_counts=True)
    return pair // n_phrases, pair % n_phrases, times


class _Words:
    """The postings of some documents that phrases ask for, and their words in the order of places.

    A document's first place lies far behind the last one of the document before.
    """

    def __init__(self, held: dict, rows: pa.Table) -> None:
        self.n_terms = len(held["numbers"])
        self.asked, self.term = _among(held["numbers"], rows.column("number").to_numpy())
        rows = rows.take(pa.array(self.asked)).combine_chunks()
        self.batch_id, self.doc_id = (rows.column(c).to_numpy() for c in ("batch_id", "doc_id"))
        self.listed = rows.column("positions").combine_chunks()
        changes = (self.batch_id[1:] != self.batch_id[:-1]) | (self.doc_id[1:] != self.doc_id[:-1])
        self.doc = np.cumsum(np.append(0, changes))[: len(self.term)]
        posting_key = self.doc * self.n_terms + self.term
        self.by_key = np.argsort(posting_key, kind="stable")
        self.posting_key = posting_key[self.by_key]
        posting = np.repeat(np.arange(len(self.term)), pc.list_value_length(self.listed).to_numpy())
        position = pc.list_flatten(self.listed).to_numpy().astype(np.int64)
        gap = int(held["size"].max(initial=1)) + _NEAR + 1
        place = position + gap + self.doc[posting] * (int(position.max(initial=0)) + 2 * gap)
        order = np.lexsort((self.term[posting], place))
        place, posting = place[order], posting[order]
        once = np.append(True, (place[1:] != place[:-1]) | (self.term[posting[1:]] != self.term[posting[:-1]]))[: len(place)]
        # How often a posting names a place.
        self.times = np.diff(np.append(np.flatnonzero(once), len(place)))
        self.place, self.posting = place[once], posting[once]
        self.word = self.term[self.posting]

    def source(self, held: dict, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Postings of the first word of phrases that were found."""
        _, at = _among(self.posting_key, doc * self.n_terms + held["term"][held["first"][phrase]])
        return self.by_key[at]


def _exact_found(held: dict, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, phrase and number of the exact phrases."""
    found_doc, found_phrase = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.arange(len(words.place))
    node = np.zeros(len(words.place), np.int64)
    for depth, (keys, end_node, end_phrase) in enumerate(held["levels"]):
        if depth:
            own, at = _spread(words.place, words.place[at] + 1)
            node = node[own]
        here, node = _among(keys, node * words.n_terms + words.word[at])
        at = at[here]
        own, end = _spread(end_node, node)
        found_doc.append(words.doc[words.posting[at[own]]])
        found_phrase.append(end_phrase[end])
    return _counted(np.concatenate(found_doc), np.concatenate(found_phrase), len(held["phrases"]))


def _pairs_at(held: dict, words: _Words, mine: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first and second word of some phrases, the second ``ahead`` of the first one, and the phrase."""
    pair = held["term"][held["first"][mine]] * words.n_terms + held["term"][held["first"][mine] + 1]
    order = np.argsort(pair, kind="stable")
    own, other = _spread(words.place, words.place + ahead)
    left, met = _spread(pair[order], words.word[own] * words.n_terms + words.word[other])
    return own[left], other[left], mine[order[met]]


def _near_found(held: dict, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, phrase and frequency of the sloppy phrases of two words.

    A word starts a window at its place, less its part, that ends where the other word starts next. It counts
    ``1 / (1 + spread)`` if the word does not start again up to there. So a pair counts if neither word has a nearer partner on that side.
    """
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    keys = words.place * words.n_terms + words.word

    def stands(place: np.ndarray, word: np.ndarray) -> np.ndarray:
        wanted = place * words.n_terms + word
        return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted

    for slop in np.unique(held["slop"][held["near"]]) if len(keys) else ():
        mine = held["near"][held["slop"][held["near"]] == slop]
        for spread in range(slop + 1):
            for side in (1, -1) if spread else (1,):
                own, other, phrase = _pairs_at(held, words, mine, 1 + side * spread)
                for nearer in range(spread):
                    alone = ~stands(words.place[own] + 1 + side * nearer, words.word[other])
                    alone &= ~stands(words.place[other] - 1 - side * nearer, words.word[own])
                    own, other, phrase = own[alone], other[alone], phrase[alone]
                doc = words.doc[words.posting[own]]
                # Words that start at one place begin a window each.
                times = (words.times[own] if side > 0 else 0) + (words.times[other] if side < 0 or not spread else 0)
                found.append((doc, phrase, times / (1.0 + spread)))
    doc, phrase, share = (np.concatenate(c) for c in zip(*found, strict=True))
    pair, number = np.unique(doc * len(held["phrases"]) + phrase, return_inverse=True)
    return pair // len(held["phrases"]), pair % len(held["phrases"]), np.bincount(number, share, len(pair))


def frequencies(held: dict, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies of the phrases of some documents, none of which is left ``loose``: a row of the first word, phrase and frequency."""
    words = _Words(held, rows)
    exact, near = _exact_found(held, words), _near_found(held, words)
    doc, phrase = np.append(exact[0], near[0]), np.append(exact[1], near[1])
    return words.asked[words.source(held, doc, phrase)], phrase, np.append(exact[2], near[2])


def phrases_of(held: dict, rows: pa.Table) -> pa.RecordBatch:
    """Phrases of some documents, from their postings ``batch_id, doc_id, number, dl, positions``."""
    words = _Words(held, rows)
    n_terms, n = words.n_terms, len(held["phrases"])
    term, doc, posting_key, by_key = words.term, words.doc, words.posting_key, words.by_key
    exact, near = _exact_found(held, words), _near_found(held, words)
    known_doc, known_phrase, known = (np.append(a, b) for a, b in zip(exact, near, strict=True))

    loose_doc, loose_phrase = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for slop in np.unique(held["slop"][held["loose"]]):
        mine = held["loose"][held["slop"][held["loose"]] == slop]
        opening = held["term"][held["first"][mine]]
        if slop <= _NEAR:
            for ahead in range(1 - slop, 2 + slop):
                own, _, met = _pairs_at(held, words, mine, ahead)
                loose_doc.append(doc[words.posting[own]])
                loose_phrase.append(met)
        else:
            mine, opening = mine[np.argsort(opening, kind="stable")], np.sort(opening)
            asked = np.searchsorted(opening, term, side="right") - np.searchsorted(opening, term, side="left")
            for start, end in pieces(asked):
                own, met = _spread(opening, term[start:end])
                follows, _ = _among(posting_key, doc[start + own] * n_terms + held["term"][held["first"][mine[met]] + 1])
                loose_doc.append(doc[start + own[follows]])
                loose_phrase.append(mine[met[follows]])
    loose_doc, loose_phrase, _ = _counted(np.concatenate(loose_doc), np.concatenate(loose_phrase), n)
    # The positions of all words, where the document has them.
    size = held["size"][loose_phrase]
    part = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wanted = np.repeat(loose_doc, size) * n_terms + held["term"][np.repeat(held["first"][loose_phrase], size) + part]
    has, key_place = _among(posting_key, wanted)
    whole = np.bincount(np.repeat(np.arange(len(size)), size)[has], minlength=len(size)) == size
    loose_doc, loose_phrase = loose_doc[whole], loose_phrase[whole]
    inside = np.repeat(whole, size)[has]
    part, source = part[has][inside], by_key[key_place[inside]]
    parts = pa.StructArray.from_arrays(
        [pa.array(part.astype(np.int32)), pc.take(words.listed, pa.array(source))], fields=list(_PARTS.value_type)
    )
    ends = np.append(np.zeros(len(known_doc) + 1, np.int64), np.cumsum(size[whole])).astype(np.int32)

    all_doc, all_phrase = np.append(known_doc, loose_doc), np.append(known_phrase, loose_phrase)
    # All words of a phrase are in one field, whose length each posting holds.
    source = words.source(held, all_doc, all_phrase)
    dl = rows.column("dl").to_numpy()[words.asked[source]]
    freq = np.append(known.astype(np.float64), np.zeros(len(loose_doc)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(held["phrases"][all_phrase]), pa.array(words.batch_id[source]), pa.array(words.doc_id[source]), pa.array(dl),
            pa.array(freq, mask=np.arange(len(freq)) >= len(known_doc)), pa.ListArray.from_arrays(pa.array(ends), parts).cast(_PARTS),
        ],
        names=["phrase", "batch_id", "doc_id", "dl", "freq", "parts"],
    )


def phrases_of_task(held: Callable[[], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task over postings ``batch_id, doc_id, number, dl, positions`` in the order of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held()
        for rows in whole_documents(batches):
            yield phrases_of(table, rows)

    return run
