"""Encoders for the public vocabulary files.

``.json`` files are ``tokenizers`` models and ``.model`` files ``sentencepiece``
models.  A plain byte-level BPE ``.json`` (no normaliser, no prefix space, the
standard split pattern) is the same function as a ``tiktoken`` encoding over the
same ranks, several times faster, so its ranks are handed to ``tiktoken``; the
tests hold the two against each other.  Its pattern matcher gives up on white
space runs of about a million characters; such a text goes to
``tokenizers`` itself.  Special strings inside texts become their special ids,
which is the default of ``tokenizers``.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _ranks(model: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens if the file is plain byte-level BPE, else None."""
    pre, bpe = model.get("pre_tokenizer") or {}, model.get("model") or {}
    plain = (
        bpe.get("type") == "BPE"
        and model.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(bpe.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    )
    added = model.get("added_tokens") or []
    if not plain or any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or not a.get("special") for a in added):
        return None
    special, letters = {a["content"]: a["id"] for a in added}, _byte_letters()
    return {bytes(letters[c] for c in k): v for k, v in bpe["vocab"].items() if k not in special}, special


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """``ids(text)`` as an unsigned numpy array, ``count(text)`` as an int."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = sp.vocab_size()
            self._ids = lambda text: sp.encode(text, num_threads=1)
            return
        with open(path, encoding="utf-8") as f:
            known = _ranks(json.load(f))
        if known:
            import public_tokenizers
            import tiktoken

            ranks, special = known
            bpe = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.size = 1 + max([*ranks.values(), *special.values()])

            def fast(text: str) -> np.ndarray | list[int]:
                try:
                    return bpe.encode_to_numpy(text, allowed_special="all")
                except ValueError:
                    return _library(path).encode(text, add_special_tokens=False).ids

            self._ids = fast
        else:
            t = _library(path)
            self.size = t.get_vocab_size()
            self._ids = lambda text: t.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> np.ndarray:
        return np.asarray(self._ids(text) if text else [], dtype=np.uint32)

    def count(self, text: str | None) -> int:
        return len(self._ids(text)) if text else 0


@functools.lru_cache(maxsize=2)
def load_encoder(path: str) -> Encoder:
    """One encoder for each path and Python worker."""
    return Encoder(path)
