"""Trigrams of text, and those that whatever matches a pattern must hold.

Letters are folded as the search does it, which takes two characters for one if their capitals, or
the small letters of these, are one. A trigram counts only if it is made of letters and digits of ``ALPHABET``, told
by code point on both sides, so no trigram is asked for that the index leaves out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

ALPHABET = "0-9a-zß-öø-ɏͰ-ԯ"
TRIGRAM = f"(?=([{ALPHABET}]{{3}}))"


def _folded(character: str) -> str:
    if character == "İ":  # its small letter is the plain one with a dot, as one character the plain one
        return "i"
    upper = character.upper() if len(character.upper()) == 1 else character
    return upper.lower() if len(upper.lower()) == 1 else upper


_FOLDS = {c: _folded(c) for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and _folded(c) != c}
_FROM, _TO = "".join(_FOLDS), "".join(_FOLDS.values())


def folded(text: str) -> str:
    return "".join(_FOLDS.get(c, c) for c in text)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, as an array; empty for a missing one."""
    found = F.regexp_extract_all(F.translate(text, _FROM, _TO), F.lit(TRIGRAM), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.expr("cast(array() as array<string>)")))


def required_runs(pattern: str) -> list[str]:
    """Pieces of plain text that whatever matches ``pattern``, a Java pattern, must hold.

    Only what surely is one is taken: characters up to the first group, class or repetition by number, and no
    piece at all where the pattern has alternatives or quotes. A character that may be missing is left out.
    """
    if "|" in pattern or "\\Q" in pattern:
        return []
    runs, run = [], ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c in "([{":
            # What a number repeats may be repeated no times.
            run = run[:-1] if c == "{" else run
            break
        if c in "*?":
            runs.append(run[:-1])
            run = ""
        elif c in "+.^$)]}":
            runs.append(run)
            run = ""
        elif c == "\\":
            following = pattern[i + 1 : i + 2]
            if following.isalnum() and following not in "dDsSwWbBAzZGnrtf":
                break  # it may go on in a way of its own
            if following.isalnum():
                runs.append(run)
                run = ""
            else:
                run += following
            i += 1
        else:
            run += c
        i += 1
    return [r for r in [*runs, run] if r]


def required_trigrams(pattern: str) -> list[str]:
    """The trigrams that whatever matches ``pattern`` must hold; none if there is no saying."""
    found: set[str] = set()
    for run in required_runs(pattern):
        found.update(re.findall(TRIGRAM, folded(run)))
    return sorted(found)
