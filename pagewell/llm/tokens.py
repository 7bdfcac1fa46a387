"""Token ids of whole texts from a vocabulary file with word ends."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

# Words whose ids a worker remembers; beyond that it starts afresh.
_MEMO_WORDS = 400_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Letters, then ASCII marks other than the apostrophe: two units of the vocabulary's own splitter.
_PLAIN = re.compile(f"([{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")
# Words of these characters alone are in the vocabulary's normal form but for case.
_SIMPLE = re.compile("[ -~\\t\\n\\rÀ-ÖØ-öø-ÿ]*")
# The vocabulary's units of such a word in lower case; the characters that end a unit and a word below.
_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_END, _STOP = "\x01", "\x02"


def byte_of() -> dict[str, int]:
    """Byte that a character of the file stands for: printable ones themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _by_rank(path: str) -> tiktoken.Encoding | None:
    """The file as ranks of byte strings in which a word's end is a byte of its own.

    A byte at a word's end has a lower id than any merge, so it takes the end up first, and from there on the
    merges go by id as in the file; ``None`` for a file that is not in that order.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, suffix, byte = model["vocab"], model.get("end_of_word_suffix"), byte_of()
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    single = [vocab.get(c + end) for c in byte for end in ("", suffix or "")]
    if not suffix or None in single or not merged or merged != sorted(merged) or max(single) > merged[0]:
        return None
    ranks = {}
    for token, i in vocab.items():
        body = token.removesuffix(suffix)
        ranks[bytes(byte[c] for c in body) + _END.encode() * (body != token)] = i
    return tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})


class WordTokenizer:
    """Ids of a vocabulary that drops white space and never joins what white space parts.

    A text is cut at blanks and line feeds, each distinct word is encoded once and its ids are
    kept as little-endian unsigned 32-bit bytes. The new words of a text are encoded together: those of
    plain characters are cut into the vocabulary's units and merged by rank in one call. Where
    the file has no such order, plain words go to the vocabulary's model one by one. Any other word takes
    the library's whole way.
    """

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._ranks = _by_rank(path)
        self._stop = self._ranks.encode_single_token((_STOP + _END).encode()) if self._ranks else None
        self._mapped = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self._memo: dict[str, bytes] = {"": b""}
        self._marks: dict[str, bytes] = {"": b""}

    def _unit(self, unit: str) -> bytes:
        return np.array([t.id for t in self._model.tokenize(unit)], dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if not plain:
            ids = self._tokenizer.encode(word, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        letters, marks = plain.groups()
        if marks not in self._marks:
            self._marks[marks] = self._unit(marks)
        return self._unit(letters.lower().translate(self._mapped)) + self._marks[marks]

    def _learn(self, words: set[str]) -> None:
        memo = self._memo
        plain = [w for w in words if self._ranks and "<|" not in w and _SIMPLE.fullmatch(w)]
        if plain:
            cut = _UNITS.findall
            joined = "".join([_END.join([*cut(w.lower()), _STOP, ""]) for w in plain])
            ids = self._ranks.encode_to_numpy(joined).astype("<u4", copy=False)
            ends = (np.flatnonzero(ids == self._stop) * 4).tolist()
            data, begin = ids.tobytes(), 0
            for word, end in zip(plain, ends):
                memo[word] = data[begin:end]
                begin = end + 4
        for word in words:
            if word not in memo:
                memo[word] = self._word(word)

    def ids(self, text: str) -> bytes:
        """Ids of the whole text, without special tokens of its own."""
        words = text.replace("\n", " ").split(" ")
        memo = self._memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            pass
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        self._learn({w for w in words if w not in memo})
        return b"".join([memo[w] for w in words])


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker and file."""
    return WordTokenizer(path)
