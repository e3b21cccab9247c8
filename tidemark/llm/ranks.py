"""Token ids of plain byte-level BPE vocabularies through their ranks, where that is proven to be the same.

A tokenizer file lists merges of token pairs; a rank encoder merges whatever two neighbours spell a token.  Both give
the same ids for every text if each token's own bytes, merged by the listed pairs alone, end in that very token by its
listed merge: when a pair of rank r is next, all lower merges are done, so a token's bytes stand as they would alone.
``ranks_are_equivalent`` checks this for every token of the file; only then is the rank encoder used.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from tidemark.llm.segments import _plain_byte_level, library_encoder, vocabulary_path


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level tokenizer files: printable Latin-1 characters stand for themselves, the
    other bytes for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]] | None:
    """(token bytes to id, merges, special strings to id) of a plain byte-level .json file, else None."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if not _plain_byte_level(spec) or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}

    def raw(token: str) -> bytes:
        return bytes(alphabet[c] for c in token)

    try:
        ranks = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    except KeyError:
        return None
    return ranks, merges, special


@lru_cache(maxsize=8)
def ranks_are_equivalent(path: str) -> bool:
    """Whether the ids rise with the merges and every merged token, by listed merges alone, ends in its listed pair."""
    read = read_ranks(path)
    if read is None:
        return False
    ranks, merges, _ = read
    order = {m: i for i, m in enumerate(merges)}
    if len(order) != len(merges) or any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != 256 + len(merges):
        return False
    merged = [ranks.get(a + b) for a, b in merges]
    if None in merged or any(x >= y for x, y in zip(merged, merged[1:])) or any(ranks[bytes([b])] >= merged[0] for b in range(256)):
        return False
    for last in merges:
        parts = [bytes([b]) for b in b"".join(last)]
        while len(parts) > 2:
            pairs = [order.get((parts[i], parts[i + 1]), len(merges)) for i in range(len(parts) - 1)]
            i = pairs.index(low := min(pairs))
            if low == len(merges):
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if tuple(parts) != last:
            return False
    return True


class RankEncoder:
    """Packed ids by the byte-pair library, special strings in texts included."""

    def __init__(self, path: str, dtype: str):
        import public_tokenizers
        import tiktoken

        ranks, _, special = read_ranks(path)
        self.library = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.dtype = tuple(special), np.dtype(dtype)
        if max([*ranks.values(), *special.values()]) > np.iinfo(self.dtype).max:
            raise ValueError(f"ids of {path} don't fit {dtype}")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.library.encode_to_numpy(t, allowed_special="all").astype(self.dtype).tobytes() if any(s in t for s in self.special) else self.library.encode_to_numpy(t, disallowed_special=()).astype(self.dtype).tobytes() for t in texts]


_LOADED: dict[tuple[str, str], RankEncoder] = {}


def encoder_for(vocabulary: str, by_ranks: bool, dtype: str = "<u4"):
    """A worker's encoder; ``by_ranks`` is what ``ranks_are_equivalent`` said on the driver."""
    if not by_ranks:
        return library_encoder(vocabulary, dtype)
    if (vocabulary, dtype) not in _LOADED:
        _LOADED[vocabulary, dtype] = RankEncoder(vocabulary_path(vocabulary), dtype)
    return _LOADED[vocabulary, dtype]
