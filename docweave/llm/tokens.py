"""Ids of a public word tokenizer, one cache entry per white-space separated chunk.

The tokenizer lower-cases, drops white space and never merges across it, so the ids of a text are the ids of
its chunks in order. Chunks of common letters and signs are split by the tokenizer's own pattern and each part
is merged by its model; any other chunk, and any text with separators that only Python takes for white space,
goes through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import sys
import types

CACHE_ENTRIES = 200_000


class WordIds(dict):
    """chunk -> little-endian unsigned 32-bit ids, in a dictionary of bounded size."""

    # Letters of the pattern below: ASCII and the two Latin blocks up to U+017F, where case and composition need no context.
    plain = re.compile(r"[!-~À-ÖØ-öø-ſ]+\Z")
    # The tokenizer's split pattern, fixed by its file, over those letters.
    parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        # Bytes as the byte-level alphabet writes them: visible Latin-1 signs stand for themselves, the rest follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}

    def part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            spelled = part if part.isascii() else "".join(map(self.alphabet.__getitem__, part.encode()))
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])
            if len(part) <= 40:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                self.known[part] = found
        return found

    def whole(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def __missing__(self, chunk: str) -> bytes:
        if "<|" not in chunk and self.plain.match(chunk):
            found = b"".join(map(self.part, self.parts.findall(chunk.lower())))
        else:
            found = self.whole(chunk)
        if len(chunk) <= 40:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = found
        return found

    def ids(self, text: str | None, separators: bool = True) -> bytes:
        """``separators``: the text may hold the control signs 0x1C to 0x1F."""
        if not text:
            return b""
        if separators and any(sign in text for sign in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    """One cache per Python worker and tokenizer file, kept between tasks."""
    holder = sys.modules.setdefault("_docweave_word_ids", types.ModuleType("_docweave_word_ids"))
    if path not in holder.__dict__:
        setattr(holder, path, WordIds(path))
    return getattr(holder, path)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
