"""Texts cut into units that tokenise alone, each different unit encoded once.

A unit is white space and the run after it; no match of the byte-level pattern crosses from a character that isn't
white space to white space, so the ids of a text are the ids of its units in order. Units repeat far more than
texts do: a worker keeps those it has met, up to a bound, and encodes only new ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import texts

#: Unicode's White_Space, which is \s of the byte-level pattern (Python's own \s has \x1c-\x1f besides).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: In a text with white space before a space or a new line, splitting at each of these could cut a run of white space.
DOUBLE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}][ \\n]"


def units_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a column of texts (null: empty): number of units of each, code of each unit in order, strings of the codes
    (large_string)."""
    column = texts(column)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    odd = np.flatnonzero(pc.match_substring_regex(column, DOUBLE).to_numpy(zero_copy_only=False))
    plain = column if not len(odd) else pc.if_else(pa.array(np.isin(np.arange(len(column)), odd)), "", column)
    parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
    flat = pc.list_flatten(parts).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.cumsum(counts) - counts
    words = flat.dictionary
    codes[firsts[counts > 0]] += len(words)
    used = np.flatnonzero(np.bincount(codes, minlength=2 * len(words))) if len(codes) else np.zeros(0, np.int64)
    later = words.take(pa.array(used[used < len(words)]))
    strings = pc.binary_join_element_wise(pc.if_else(pc.starts_with(later, "\n"), pa.scalar("", words.type), pa.scalar(" ", words.type)), later, pa.scalar("", words.type))
    strings = pa.concat_arrays([strings, words.take(pa.array(used[used >= len(words)] - len(words)))])
    place = np.zeros(2 * len(words), np.int64)
    place[used] = np.arange(len(used))
    codes = place[codes]
    if len(odd):
        names = strings.to_pylist()
        known = {s: i for i, s in enumerate(names)}
        pieces, at = np.split(codes, firsts[1:]) if len(firsts) else [], 0
        for k in odd.tolist():
            own = []
            for u in UNIT.findall(column[k].as_py()):
                at = known.setdefault(u, len(names))
                if at == len(names):
                    names.append(u)
                own.append(at)
            pieces[k], counts[k] = np.array(own, np.int64), len(own)
        codes, strings = np.concatenate(pieces), pa.array(names, strings.type)
    return counts, codes, strings


class Encoded:
    """What is known of units, in a worker: unit -> value, filled by encode(units) -> values."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = 300_000, at_once: int = 60_000):
        self.encode, self.most, self.at_once, self.known = encode, most, at_once, {}

    def values(self, strings: list[str]) -> list:
        found = list(map(self.known.get, strings))
        missing = [i for i, v in enumerate(found) if v is None]
        for at in range(0, len(missing), self.at_once):
            part = missing[at : at + self.at_once]
            fresh = self.encode([strings[i] for i in part])
            for i, v in zip(part, fresh):
                found[i] = v
            room = self.most - len(self.known)
            if room > 0:
                self.known.update((strings[i], v) for i, v in zip(part[:room], fresh))
        return found
