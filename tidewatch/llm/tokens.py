"""Token ids of whole texts, by a byte-level BPE file of the ``tokenizers`` library."""

from __future__ import annotations

import json
from array import array

#: Pattern of byte-level BPE before the merges, in the form without backtracking.
#: Fixed value.
_PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")


def _bytes_of() -> dict[str, int]:
    """Byte of each character by which byte-level BPE writes bytes: printable ones
    stand for themselves, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, as the tokenizer file gives them for the whole text.

    Where the file's merges are ranked by id, texts go through the faster of the two
    libraries that read such files. Texts with a special token, and other files, go
    through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self._special = [t["content"] for t in file.get("added_tokens", ())]
        order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        same = file.get("pre_tokenizer", {}).items() >= plain.items()
        self._ranked = None
        if same and order == sorted(order) and file.get("normalizer") is None:
            of = _bytes_of()
            ranks = {bytes(of[c] for c in token): i for token, i in vocab.items()
                     if token not in self._special}
            self._ranked = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks,
                                             special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self._ranked is None or any(s in text for s in self._special):
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self._ranked.encode_ordinary(text)
        return array("I", ids).tobytes()
