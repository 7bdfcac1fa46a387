"""Token ids of a byte-level vocabulary file, merged by rank where the file allows that."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from pagewell.llm.tokens import byte_of

# Fixed value: the splitter that byte-level vocabulary files of this kind mean by "use_regex".
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _by_rank(path: str) -> tiktoken.Encoding | None:
    """The file as ranks, if its ids are in the order of its merges and nothing but the splitter comes before."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None and spec.get("post_processor") is None and model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    )
    if not plain:
        return None
    vocab, byte = model["vocab"], byte_of()
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:])) or not all(c in vocab for c in byte):
        return None
    if merged and max(vocab[c] for c in byte) > merged[0]:
        return None
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)


class ByteTokenizer:
    """Ids of whole texts as ``tokenizers`` gives them, as little-endian unsigned 32-bit bytes.

    Strings of special tokens in a text are those tokens, and none are added.
    """

    def __init__(self, path: str) -> None:
        self._ranks = _by_rank(path)
        self._plain = None if self._ranks else Tokenizer.from_file(path)

    def ids(self, text: str) -> bytes:
        """Ids of the whole text."""
        if self._ranks:
            return self._ranks.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        return np.array(self._plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def byte_tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer per worker and file."""
    return ByteTokenizer(path)
