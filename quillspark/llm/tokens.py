"""Token ids of whole texts: those of the tokenizers library, by a faster engine where both are sure to agree."""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np

#: Characters whose Unicode classes are old and settled, so that every engine splits texts of them alike; a text with any
#: other goes to the tokenizers library itself.
_SETTLED = re.compile("[^\x00-\x1b\x20-ͯͰ-ӿ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]")


def _letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: itself where it is printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Ids of a tokenizer file as merge ranks, or None where they aren't the same: the file has to be a plain byte-level BPE
    that numbers its tokens in the order of the merges that make them, bytes first."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], _letters()
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = spec.get("pre_tokenizer") or {}
    if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [vocab.get(t, -1) for t in made]
    if order != sorted(set(order)) or len(order) + 256 != len(vocab) or min(order, default=256) < 256 or not all(len(t) == 1 for t, i in vocab.items() if i < 256):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids, equal to tokenizers' encode(text, add_special_tokens=False).

    Where the file's ids are merge ranks, the same vocabulary runs in tiktoken, four times as fast; a text with a special
    token's mark or a character whose class engines may see differently is encoded by tokenizers, as is every text of
    a file of another kind.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.model = Tokenizer.from_file(path)
        ranks = _ranks(path)
        self.fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.marks = [t.content for t in self.model.get_added_tokens_decoder().values()]

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or _SETTLED.search(text) or any(m in text for m in self.marks):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


def shared_encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python process: a worker that runs several tasks loads it once."""
    state = sys.modules.setdefault("_quillspark_worker", types.ModuleType("_quillspark_worker")).__dict__
    key = f"encoder {path}"
    if key not in state:
        state[key] = Encoder(path)
    return state[key]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or pieces of `most` after a first one that may be shorter."""
    if n <= most:
        return [(0, n)]
    first = n % most
    return ([(0, first)] if first else []) + [(k, most) for k in range(first, n, most)]
