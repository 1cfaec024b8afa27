"""Similarity of two texts, 0 to 100. Helpers for the scoring task of the pair search."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd


@lru_cache(maxsize=4096)
def _places(text: str) -> dict[str, int]:
    """For each character, a bit set of where it stands."""
    places: dict[str, int] = {}
    for i, char in enumerate(text):
        places[char] = places.get(char, 0) | (1 << i)
    return places


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one step of bit arithmetic per character."""
    if a == b:
        return len(a)
    places, full = _places(a), (1 << len(a)) - 1
    open_bits = full
    for char in b:
        matched = open_bits & places.get(char, 0)
        open_bits = ((open_bits + matched) | (open_bits - matched)) & full
    return len(a) - open_bits.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of both texts that lies in their longest common subsequence."""
    both = len(a) + len(b)
    return 200.0 * common_length(a, b) / both if both else 100.0


# Most characters of a text that is short: the bits of a word.
SHORT = 64
# Most characters of the other text of pairs that are scored together.
_LONGEST = 256
_PAIRS_AT_ONCE = 4096
# Entries of the table of places; beyond it pairs are scored one by one.
_MOST_PLACES = 1 << 23


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Ratios:
    """``ratio`` of pairs of two lists of texts, a step of all pairs at once.

    ``fits_a`` and ``fits_b`` tell which texts are short enough; others take no part. With
    very many characters none are.
    """

    def __init__(self, a: list[str], b: list[str]):
        self.len_a, self.len_b = (np.fromiter(map(len, texts), np.int64, len(texts)) for texts in (a, b))
        self.fits_a, self.fits_b = self.len_a <= SHORT, self.len_b <= _LONGEST
        a, b = ([t if fits else "" for t, fits in zip(texts, side)] for texts, side in ((a, self.fits_a), (b, self.fits_b)))
        len_a, len_b = np.where(self.fits_a, self.len_a, 0), np.where(self.fits_b, self.len_b, 0)
        points = np.r_[_codes(a), _codes(b)]
        present = np.zeros(int(points.max(initial=0)) + 1, bool)
        present[points] = True
        code, letters = (np.cumsum(present) - 1)[points], int(present.sum())
        if len(a) * (letters + 1) > _MOST_PLACES:
            self.fits_a, self.fits_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            return
        row_a, row_b = np.repeat(np.arange(len(a)), len_a), np.repeat(np.arange(len(b)), len_b)
        place_a, place_b = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in (len_a, len_b))
        self.letters = letters + 1
        self.places = np.zeros(len(a) * self.letters, np.uint64)
        np.bitwise_or.at(self.places, row_a * self.letters + code[: len(row_a)], np.uint64(1) << place_a.astype(np.uint64))
        # A text that has ended goes on with a character that stands nowhere.
        self.steps = np.full((int(len_b.max(initial=0)), len(b)), letters)
        self.steps[place_b, row_b] = code[len(row_a) :]

    def of(self, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """The ratios of the pairs at these places, of texts that fit and are not both empty."""
        found = np.empty(len(at_a))
        for begin in range(0, len(at_a), _PAIRS_AT_ONCE):
            a, b = at_a[begin : begin + _PAIRS_AT_ONCE], at_b[begin : begin + _PAIRS_AT_ONCE]
            first = a * self.letters
            open_bits = np.full(len(a), ~np.uint64(0))
            for step in self.steps[: self.len_b[b].max()]:
                matched = open_bits & self.places.take(first + step.take(b))
                open_bits = (open_bits + matched) | (open_bits - matched)
            common = SHORT - np.bitwise_count(open_bits).astype(np.int64)
            found[begin : begin + _PAIRS_AT_ONCE] = 200.0 * common / (self.len_a[a] + self.len_b[b])
        return found


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``ratio`` of each pair."""
    len_a, len_b = (np.fromiter(map(len, texts), np.int64, len(texts)) for texts in (a, b))
    found = np.full(len(a), -1.0)
    short = np.flatnonzero((len_a <= SHORT) & (len_b <= _LONGEST) & (len_a + len_b > 0))
    for begin in range(0, len(short), _PAIRS_AT_ONCE):
        at = short[begin : begin + _PAIRS_AT_ONCE]
        (at_a, texts_a), (at_b, texts_b) = (pd.factorize(np.array([texts[i] for i in at], object)) for texts in (a, b))
        many = Ratios(texts_a.tolist(), texts_b.tolist())
        if many.fits_a.all() and many.fits_b.all():
            found[at] = many.of(at_a, at_b)
    for i in np.flatnonzero(found < 0):
        found[i] = ratio(a[i], b[i])
    return found


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter text with any stretch of the longer, no longer than itself.

    May return 0 when the result would be below ``least``.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    if a in b:
        return 100.0
    if least >= 100.0:
        return 0.0
    best = max(_best_window(a, b), _best_window(b, a) if len(a) == len(b) else 0.0)
    return best


def _best_window(short: str, long: str) -> float:
    size = len(short)
    stretches = {long[max(end - size, 0) : end] for end in range(1, len(long) + 1)}
    stretches.update(long[start:] for start in range(len(long) - size + 1, len(long)))
    return max(ratio(short, stretch) for stretch in stretches)


@lru_cache(maxsize=4096)
def _words(text: str) -> tuple[str, frozenset[str]]:
    words = text.split()
    return " ".join(sorted(words)), frozenset(words)


def token_ratio(a: str, b: str) -> float:
    """Best of the ratio with words sorted and the ratio with shared words set apart."""
    (sorted_a, set_a), (sorted_b, set_b) = _words(a), _words(b)
    if not set_a or not set_b:
        return 0.0
    shared, only_a, only_b = set_a & set_b, set_a - set_b, set_b - set_a
    if shared and not (only_a and only_b):
        return 100.0
    best = ratio(sorted_a, sorted_b)
    head = " ".join(sorted(shared))
    with_a = " ".join(filter(None, (head, " ".join(sorted(only_a)))))
    with_b = " ".join(filter(None, (head, " ".join(sorted(only_b)))))
    if (with_a, with_b) != (sorted_a, sorted_b):
        best = max(best, ratio(with_a, with_b))
    if head:
        best = max(best, *(200.0 * len(head) / (len(head) + len(text)) for text in (with_a, with_b)))
    return best


def partial_token_ratio(a: str, b: str, least: float = 0.0) -> float:
    """100 when a word is shared, else the partial ratio with words sorted."""
    (sorted_a, set_a), (sorted_b, set_b) = _words(a), _words(b)
    if not set_a or not set_b:
        return 0.0
    if set_a & set_b:
        return 100.0
    best = partial_ratio(sorted_a, sorted_b, least)
    distinct_a, distinct_b = " ".join(sorted(set_a)), " ".join(sorted(set_b))
    if (distinct_a, distinct_b) != (sorted_a, sorted_b):
        best = max(best, partial_ratio(distinct_a, distinct_b, least))
    return best


# How much word order and length differences cost in the weighted ratio.
TOKEN_WEIGHT = 0.95
PARTIAL_WEIGHT = 0.9
LONG_PARTIAL_WEIGHT = 0.6
PARTIAL_FROM = 1.5
LONG_PARTIAL_ABOVE = 8.0


def weighted_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best of the plain, word and partial ratios, the latter two at a discount.

    Scores below ``least`` may come out lower than they are.
    """
    if not a or not b:
        return 0.0
    best = ratio(a, b)
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < PARTIAL_FROM:
        if best < 100.0 * TOKEN_WEIGHT and least <= 100.0 * TOKEN_WEIGHT:
            best = max(best, TOKEN_WEIGHT * token_ratio(a, b))
        return best
    weight = PARTIAL_WEIGHT if spread <= LONG_PARTIAL_ABOVE else LONG_PARTIAL_WEIGHT
    if least <= 100.0 * weight:
        best = max(best, weight * partial_ratio(a, b, least / weight))
    discount = weight * TOKEN_WEIGHT
    if least <= 100.0 * discount:
        best = max(best, discount * partial_token_ratio(a, b, least / discount))
    return best
