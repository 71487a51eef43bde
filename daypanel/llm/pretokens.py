"""Splitting text into pre-tokens inside a task.

The pattern is run by the ``regex`` module. Its Unicode tables and those inside the tokenizer libraries are of different years, so
only texts made of characters on which they agree (``tests/llm`` tries each) are split here; the callers hand any other text,
whole, to the library that defines the result.
"""

from __future__ import annotations

import re
from functools import cache

import regex

#: Long-assigned scripts; digits, letters, marks and spaces in them are the same in every Unicode version in use.
AGREED = "\x00-ԯ‐-‧ぁ-ゖァ-ヺ一-龥가-힣"
_OTHER = re.compile(f"[^{AGREED}]")


def agreed(text: str) -> bool:
    return text.isascii() or _OTHER.search(text) is None


@cache
def splitter(pattern: str):
    """Function from a text to the list of its pre-tokens."""
    return regex.compile(pattern).findall
