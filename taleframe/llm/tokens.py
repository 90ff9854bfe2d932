"""Token ids of whole documents from a public byte-level vocabulary."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: A text with a longer run of letters, or of white space, goes to the encoder whose time does not grow with a run's square.
LONGEST_RUN = 1000
#: Fixed: the splitting rule of byte-level vocabularies, as the vocabulary file names it (ByteLevel with use_regex).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLANKS = re.compile(r"\s{%d}" % LONGEST_RUN)
_loaded: dict[str, object] = {}


def vocabulary_path(name: str) -> str:
    """``name`` itself if it is a path, else the file of the public vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_tokenizer(name: str):
    """The tokenizer of a file of the public vocabularies, or of a path; one per process."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary_path(name))
        tokenizer.encode_special_tokens = True
        _loaded[name] = tokenizer
    return _loaded[name]


def _byte_of() -> dict[str, int]:
    """The byte behind each character in which a byte-level vocabulary is written: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast_encoder(spec: dict):
    """An encoder that merges by id, for a vocabulary whose ids follow the order of its merges; else None."""
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges)
    if not plain or any(vocab.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    import tiktoken

    byte_of, added = _byte_of(), {a["content"] for a in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class DocumentEncoder:
    """Little-endian 32-bit ids of texts, as the tokenizer gives them for the whole text; nothing is kept between texts."""

    def __init__(self, name: str = VOCABULARY):
        self.tokenizer = load_tokenizer(name)
        with open(vocabulary_path(name), encoding="utf-8") as f:
            self.fast = _fast_encoder(json.load(f))

    @classmethod
    def shared(cls, name: str = VOCABULARY) -> DocumentEncoder:
        """One encoder per process."""
        if (key := f"encoder:{name}") not in _loaded:
            _loaded[key] = cls(name)
        return _loaded[key]

    def exact(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out = []
        for t in texts:
            long = self.fast is None or len(t) > LONGEST_RUN and (len(max(t.split(), key=len, default="")) > LONGEST_RUN or _BLANKS.search(t))
            out.append(self.exact([t])[0] if long else array("I", self.fast.encode_ordinary(t)).tobytes())
        return out
