"""Overlaps of n-grams on Arrow columns: grams are numbers, counted for many rows at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are counted at a time: enough for words to repeat, few enough for a core's cache; a single longer row is one part.
PART_BYTES = 1 << 18
#: Most entries of a table that is indexed by a gram and its next unit; beyond it grams are numbered by hashing.
TABLE = 1 << 23


def parts(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in parts of ``most`` bytes or of one row."""
    waiting = [batch]
    while waiting:
        part = waiting.pop()
        if part.num_rows > 1 and part.nbytes > most:
            half = part.num_rows // 2
            waiting += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def token_codes(columns: list[pa.Array]) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """Token arrays as numbers: those of all columns one after the other, a bound of them, and each column's lengths. Null: no tokens."""
    coded = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary) + 1, sizes


def char_codes(columns: list[pa.Array]) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """Texts as code points, like ``token_codes``. Null: no characters."""
    text = "".join(x for c in columns for x in c.to_pylist() if x)
    sizes = [pc.fill_null(pc.utf8_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), 0x110000, sizes


def word_codes(sides: list[list[list[str]]]) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """Each side's texts as lists of words, like ``token_codes``."""
    number: dict[str, int] = {}
    codes = [number.setdefault(w, len(number)) for side in sides for text in side for w in text]
    return np.array(codes, np.int64), len(number) + 1, [np.array([len(t) for t in side], np.int64) for side in sides]


def bare_codes(sides: list[list[str]]) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """Each side's texts without ASCII white space as numbers of the code points that occur, like ``token_codes``."""
    points = np.frombuffer("".join(t for side in sides for t in side).encode("utf-32-le"), np.uint32)
    lengths = [np.array([len(t) for t in side], np.int64) for side in sides]
    solid = (points != 32) & ((points < 9) | (points > 13))
    upto = np.concatenate([[0], np.cumsum(solid)])
    ends = np.cumsum(np.concatenate(lengths))
    sizes = np.diff(np.concatenate([[0], upto[ends]]))
    seen = np.zeros(int(points.max(initial=0)) + 1, np.int64)
    seen[points[solid]] = 1
    bound = int(seen.sum()) + 1
    return (np.cumsum(seen) - 1)[points[solid]], bound, np.split(sizes, [len(lengths[0])])


def overlaps(codes: np.ndarray, bound: int, sizes: list[np.ndarray], orders: int) -> np.ndarray:
    """Per row: matches, hypothesis and reference totals of each order; a gram matches as often as both sides have it.

    codes: the hypotheses of all rows, then the references. A gram of a row is the pair of its first n - 1 units' number and its last unit;
    the numbers of an order are dense, so a pair fits a long.
    """
    rows, lengths = len(sizes[0]), np.concatenate(sizes)
    row = np.repeat(np.tile(np.arange(rows), 2), lengths)
    left, split = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes)), int(sizes[0].sum())
    ids, out = row.copy(), np.zeros((rows, 3 * orders), np.int64)
    place = np.empty(len(codes) * bound, np.int32) if 0 < len(codes) * bound <= TABLE and rows <= len(codes) else None
    for n in range(1, orders + 1):
        at = np.flatnonzero(left >= n)
        own = int(np.searchsorted(at, split))
        pair = ids[at] * bound + codes[at + n - 1]
        if place is not None:  # a gram's number is one of its places: below len(codes), so that pairs index the table
            place[pair] = np.arange(len(pair), dtype=np.int32)
            found, kinds = place[pair].astype(np.int64), len(pair)
        else:
            found = pa.array(pair).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            kinds = int(found.max()) + 1 if len(found) else 0
        h, r = np.bincount(found[:own], minlength=kinds), np.bincount(found[own:], minlength=kinds)
        of = np.zeros(kinds, np.int64)
        of[found] = row[at]
        out[:, n - 1] = np.bincount(of, np.minimum(h, r), rows)
        out[:, orders + n - 1], out[:, 2 * orders + n - 1] = (np.maximum(0, s - (n - 1)) for s in sizes)
        ids[at] = found
    return out


def sorted_overlaps(codes: np.ndarray, bound: int, sizes: list[np.ndarray], orders: int) -> np.ndarray:
    """What ``overlaps`` returns, from one sort for all orders.

    Each place's longest gram is one number: row, units in order (0: beyond the text), side. Sorted, equal grams of any order stand
    together, and those of an order are found among those of the next longer one. Where such a number has more than 63 bits,
    ``overlaps`` counts instead.
    """
    rows, lengths, bits = len(sizes[0]), np.concatenate(sizes), int(bound).bit_length()
    if rows.bit_length() + orders * bits + 1 > 63 or not len(codes):
        return overlaps(codes, bound, sizes, orders)
    text = np.repeat(np.arange(2 * rows), lengths)
    place = np.arange(len(codes)) + (orders - 1) * text  # zeros between the texts
    units = np.zeros(len(codes) + (orders - 1) * 2 * rows, np.int64)
    units[place] = codes + 1
    gram = units.copy()
    for k in range(1, orders):
        gram <<= bits
        gram[:-k] |= units[k:]
    split = int(sizes[0].sum())
    key = gram[place]
    text[split:] -= rows
    key |= text << (orders * bits)
    key <<= 1
    key[:split] |= 1
    key.sort()
    of_hyp = np.concatenate([[0], np.cumsum(key & 1)])
    key >>= 1
    at, out = np.arange(len(key) + 1), np.zeros((rows, 3 * orders), np.int64)
    for n in range(orders, 0, -1):  # at: where each gram's places begin, and their end
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, at = key[first], np.append(at[first], at[-1])
        hyp, both = np.diff(of_hyp[at]), np.diff(at)
        found = np.minimum(hyp, both - hyp)
        found[(key & ((1 << bits) - 1)) == 0] = 0  # cut off by the end of the text
        upto = np.concatenate([[0], np.cumsum(found)])
        out[:, n - 1] = np.diff(upto[np.searchsorted(key, np.arange(rows + 1) << (n * bits))])
        out[:, orders + n - 1], out[:, 2 * orders + n - 1] = (np.maximum(0, s - (n - 1)) for s in sizes)
        key >>= bits
    return out


def spread(of: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of each item of ``of``, one after the other; item i has ``lengths[i]`` of ``values``, which follow each other."""
    count = lengths[of]
    first = (np.cumsum(lengths) - lengths)[of] - (np.cumsum(count) - count)
    return values[np.repeat(first, count) + np.arange(int(count.sum()))]


def cut_words(sides: list[pa.Array], cut: Callable[[str], tuple[str, ...]]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
    """The tokens of each side's texts, where white space always parts tokens: numbers of tokens, the tokens, and each text's count. Each distinct word is cut once."""
    words = pc.ascii_split_whitespace(pc.fill_null(pa.concat_arrays(sides), ""))
    coded = words.flatten().dictionary_encode()
    number: dict[str, int] = {}
    cuts = [cut(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)]
    tokens = np.array([number.setdefault(t, len(number)) for c in cuts for t in c], np.int64)
    lengths = np.array([len(c) for c in cuts], np.int64)
    of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(lengths[of])])
    sizes = np.diff(upto[words.offsets.to_numpy() - words.offsets[0].as_py()])
    return spread(of, lengths, tokens), list(number), np.split(sizes, [len(sides[0])])


def point_codes(codes: np.ndarray, tokens: list[str], sizes: list[np.ndarray]) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """Texts as the numbers of their tokens' code points, like ``token_codes``."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    seen, points = np.unique(np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32), return_inverse=True)
    upto = np.concatenate([[0], np.cumsum(lengths[codes])])
    ends = np.cumsum(np.concatenate(sizes))
    return spread(codes, lengths, points.astype(np.int64)), len(seen) + 1, np.split(np.diff(np.concatenate([[0], upto[ends]])), [len(sizes[0])])


def overlap_columns(hyp: pa.Array, ref: pa.Array, orders: int) -> np.ndarray:
    """``overlaps`` of two columns of token arrays or of texts."""
    coded = char_codes if pa.types.is_string(hyp.type) or pa.types.is_large_string(hyp.type) else token_codes
    return overlaps(*coded([hyp, ref]), orders)
