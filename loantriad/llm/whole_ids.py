"""Ids of whole texts from public vocabulary files, as their libraries give them.

Byte-level vocabularies whose merges come in the order of their ids are encoded by tiktoken, several times faster than the
tokenizers library and with the same ids. Libraries may differ in what they call a letter far from Latin, so texts with such
signs go through the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

from loantriad.llm.bpe import PATTERN, byte_letters

#: Beyond these letters, and for the controls that some call white space, libraries may differ.
FAR = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")


def byte_vocabulary(content: str) -> tuple[dict[bytes, int], dict[str, int], bool]:
    """Entries as bytes, special tokens, and whether merges come in the order of ids."""
    spec, letters = json.loads(content), byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    entries = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    merged = [entries[bytes(letters[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
    return entries, special, all(a < b for a, b in zip(merged, merged[1:]))


class WholeTexts:
    """Encodes whole texts by a byte-level file. ``as_text``: strings of special tokens are ordinary text."""

    def __init__(self, content: str, as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.entries, special, ordered = byte_vocabulary(content)
        self.library = Tokenizer.from_str(content)
        self.library.no_padding()
        self.library.no_truncation()
        self.library.encode_special_tokens = as_text
        self.special = None if as_text or not special else re.compile("|".join(map(re.escape, special)))
        self.fast = None
        if ordered:
            import tiktoken

            self.fast = tiktoken.Encoding("whole-texts", pat_str=PATTERN, mergeable_ranks=self.entries, special_tokens={})

    def ids(self, texts: Sequence[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for at, text in enumerate(texts):
            if self.fast is None or FAR.search(text) or self.special is not None and self.special.search(text):
                slow.append(at)
            else:
                out[at] = self.fast.encode_ordinary(text)
        for at in slow:
            out[at] = self.library.encode(texts[at], add_special_tokens=False).ids
        return out
