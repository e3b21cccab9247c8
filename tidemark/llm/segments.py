"""Exact tokenisation through a bounded cache of text segments.

Byte-level tokenizers with the pattern of ``public_tokenizers.PATTERN`` never let a match run across the border
between a non-space character and a white-space character behind it: a match takes one leading blank at most and white
space alone otherwise.  A text may therefore be cut before any white space that follows something else, and its ids
are the ids of the cuts in a row.  Corpora repeat their cuts, so most are looked up, not encoded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

#: Unicode's White_Space, fixed values: what \s of the tokenizers' pattern covers.
SPACES = r"\t-\r \x85\xa0  -     　"
_CUT = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_UNSAFE_BLANK = re.compile(rf"[{SPACES}] ")


def vocabulary_path(name: str) -> str:
    """A path as it is, or the name of one of the installed public vocabularies."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class SegmentEncoder:
    """ids of texts as packed little-endian bytes, by an ``encode_many`` of segments.

    The cache holds two generations of ``generation`` segments at most: when the young one is full it becomes the old
    one, so frequent segments survive and memory stays bounded.
    """

    def __init__(self, encode_many: Callable[[list[str]], list], dtype: str = "<u4", generation: int = 250_000, whole: str | None = None, encode_whole=None):
        self.encode_many, self.dtype, self.generation = encode_many, np.dtype(dtype), generation
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.whole, self.encode_whole = whole, encode_whole

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _resolve(self, segments: set[str]) -> dict[str, bytes]:
        found, missing = {}, []
        for s in segments:
            got = self.young.get(s) or self.old.get(s)
            if got is None:
                missing.append(s)
            else:
                found[s] = self.young[s] = got
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            for s, ids in zip(part, self.encode_many(part), strict=True):
                found[s] = self.young[s] = self._pack(ids)
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text."""
        young = self.young
        plans, unknown = [], set()
        for text in texts:
            if self.whole and self.whole in text:
                plans.append(None)
                continue
            if _UNSAFE_BLANK.search(text) or not text:
                keys = _CUT.findall(text)
            else:
                head, *tail = text.split(" ")
                keys = [" " + p for p in tail]
                if head:
                    keys.insert(0, head)
            values = list(map(young.get, keys))
            if None in values:
                unknown.update(k for k, v in zip(keys, values, strict=True) if v is None)
            plans.append((keys, values))
        if unknown:
            cuts = {k: _CUT.findall(k) for k in unknown}
            known = self._resolve({s for c in cuts.values() for s in c})
            for k, c in cuts.items():
                if len(c) > 1:
                    known[k] = b"".join([known[s] for s in c])
        out = []
        for text, plan in zip(texts, plans, strict=True):
            if plan is None:
                out.append(self._pack(self.encode_whole(text)))
            else:
                keys, values = plan
                if None in values:
                    values = [known[k] if v is None else v for k, v in zip(keys, values, strict=True)]
                out.append(b"".join(values))
        return out


def _plain_byte_level(spec: dict) -> bool:
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and len(added) <= 1
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
    )


class WholeTexts:
    """The same interface for tokenizers whose texts can't be cut: the library gets whole texts."""

    def __init__(self, encode_many: Callable[[list[str]], list], dtype: str = "<u4"):
        self.encode_many, self.dtype = encode_many, np.dtype(dtype)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids, dtype=self.dtype).tobytes() for ids in self.encode_many(texts)]


_LOADED: dict[tuple[str, str], SegmentEncoder | WholeTexts] = {}


def library_encoder(vocabulary: str, dtype: str = "<u4") -> SegmentEncoder | WholeTexts:
    """ids as ``tokenizers`` (.json) or ``sentencepiece`` (.model) gives them, without begin, end or added special
    tokens; special strings inside texts as the library's default treats them.  Kept for a worker's next task."""
    key = (vocabulary, dtype)
    if key not in _LOADED:
        path = vocabulary_path(vocabulary)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[key] = WholeTexts(lambda texts: [model.encode(t) for t in texts], dtype)
        else:
            import json

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()

            def many(texts: list[str]) -> list:
                return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            if _plain_byte_level(spec):
                added = spec.get("added_tokens") or []
                _LOADED[key] = SegmentEncoder(many, dtype, whole=added[0]["content"] if added else None, encode_whole=lambda t: many([t])[0])
            else:
                _LOADED[key] = WholeTexts(many, dtype)
    return _LOADED[key]


def vocabulary_digest(vocabulary: str) -> str:
    """SHA-256 of a vocabulary file: the tokenizer's version."""
    import hashlib

    with open(vocabulary_path(vocabulary), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
