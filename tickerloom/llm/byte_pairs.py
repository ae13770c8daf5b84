"""Byte-pair encoding of single texts with a public vocabulary, whatever the text holds."""

from __future__ import annotations

import re

#: Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's ``\s`` sees it (code points).
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Runs that the pattern's look-ahead cannot walk back through.
LONG_BLANK = re.compile("[" + "".join(map(chr, BLANKS)) + "]{5000,}")


def encode_ordinary(encoding, text: str) -> list[int]:
    """Ids of a text; strings of special tokens are ordinary text.

    The pattern takes a run of white space but its last sign as one piece, or the whole run at the end of the text. Long
    runs are cut off by that rule and encoded as the piece they are, since the pattern's matcher overflows on them.
    """
    ids, at = [], 0
    for blank in LONG_BLANK.finditer(text):
        start, end = blank.span()
        end -= end < len(text)
        ids += encoding.encode_ordinary(text[at:start])
        ids += encoding._encode_single_piece(text[start:end])
        at = end
    return ids + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)
