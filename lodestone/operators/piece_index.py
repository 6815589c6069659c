"""Strings that stand nearly in texts, found within one task: pieces of the strings, hashed, meet every run of the texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from ..functions.text import best_window, common, places

#: Runs of so many characters are hashed, and so many meetings of runs and pieces are looked at, at once.
STEP = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64 bits of each run of q; the high ones are the best mixed."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    points = codes.astype(np.uint64) + np.uint64(1)
    out = points[:n] * ODD
    for k in range(1, q):
        out += points[k : k + n]
        out *= ODD
    return out


def ends(strings: Sequence[str]) -> np.ndarray:
    """Where each string starts in all of them joined, and where the last ends."""
    return np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)])


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def sizes(m: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q, edits and least of strings of m characters, as matching.pieces has them."""
    edits = m * (201 - 2 * tolerance) // 100
    q = np.ones_like(m)
    for k in range(2, 9):
        q = np.where(m // k - edits >= np.maximum(1, m // k // 8), k, q)
    return q, edits, m // q - edits


class PieceIndex:
    """The pieces of some distinct, non-empty strings.  Hashes that are alike by chance only add to what is compared."""

    def __init__(self, strings: Sequence[str], tolerance: int):
        self.strings, self.tolerance = strings, tolerance
        self.m = np.array([len(s) for s in strings], np.int64)
        self.q, self.edits, self.least = sizes(self.m, tolerance)
        self.letters = [places(s) for s in strings]
        self.halves = [[s[i : i + q // 2] for i in range(0, len(s) - q // 2 + 1, q // 2)] if q > 3 else [] for s, q in zip(strings, self.q.tolist())]
        codes, start = code_points("".join(strings)), ends(strings)[:-1]
        self.tables = {}
        for q in np.unique(self.q).tolist():
            mine = np.flatnonzero(self.q == q)
            n = self.m[mine] // q
            owner = np.repeat(mine, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hashes = run_hashes(codes, q)[start[owner] + place * q]
            order = np.argsort(hashes, kind="stable")
            known, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
            bits = max(10, int(16 * len(known)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[known >> np.uint64(64 - bits)] = True
            self.tables[q] = (np.uint64(64 - bits), seen, known, first, count, owner[order], place[order])
        self.most_places = int((self.m // self.q).max()) + 1
        self.before = int((self.m // (self.edits + 1)).max()) + 3  # bands under 0

    def bands(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of text and of string, and band of shifts, where enough different pieces of the string stand in the text; in that order."""
        joined, edge, k = code_points("".join(texts)), ends(texts), len(self.strings)
        pairs, spots, held = [], [], 0
        for q, (shift, seen, known, first, count, owner, place) in self.tables.items():
            for a in range(0, len(joined), STEP):
                hashes = run_hashes(joined[a : a + STEP + q - 1], q)
                at = np.flatnonzero(seen[hashes >> shift])
                hashes = hashes[at]
                which = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                met = known[which] == hashes
                at, which = at[met] + a, which[met]
                text = np.searchsorted(edge, at, "right") - 1
                inside = at + q <= edge[text + 1]
                at, which, text = at[inside] - edge[text[inside]], which[inside], text[inside]
                n = count[which]
                part = np.cumsum(n) // STEP
                for p in np.unique(part).tolist():
                    here = part == p
                    each = n[here]
                    piece = np.repeat(first[which[here]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    string, where = owner[piece], place[piece]
                    band = (np.repeat(at[here], each) - where * q) // (self.edits[string] + 1) + self.before
                    pairs.append(np.repeat(text[here], each) * k + string)
                    spots.append(band * self.most_places + where)
                    held += len(piece)
                    if held > 8 * STEP:  # pieces that are alike met in one band of a text count once
                        pair, spot = distinct(np.concatenate(pairs), np.concatenate(spots))
                        pairs, spots, held = [pair], [spot], 0
        if not pairs:
            return (np.zeros(0, np.int64),) * 3
        pair, spot = np.concatenate(pairs), np.concatenate(spots)
        if len(texts) * k <= 1 << 24:  # most pairs meet once or twice
            enough = np.bincount(pair, minlength=1)[pair] >= self.least[pair % k]
            pair, spot = pair[enough], spot[enough]
        # The unharmed pieces' shifts against the text differ by at most edits: two bands of twice that, half overlapping, hold them.
        pair, spot = distinct(np.concatenate([pair, pair]), np.concatenate([spot - self.most_places, spot]))
        band = spot // self.most_places
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])
        at = np.flatnonzero(new)
        enough = at[np.diff(np.append(at, len(pair))) >= self.least[pair[at] % k]]
        return pair[enough] // k, pair[enough] % k, band[enough] - self.before

    def scores(self, texts: Sequence[str]) -> Iterator[tuple[int, int, int]]:
        """Number of text and of string, and score, where a string no longer than the text is like a window of it by the tolerance; a pair comes once for each place of the text, with that place's best."""
        text, string, band = (x.tolist() for x in self.bands(texts))
        i = 0
        while i < len(text):
            t, s, first = text[i], string[i], band[i]
            while i + 1 < len(text) and text[i + 1] == t and string[i + 1] == s and band[i + 1] == band[i] + 1:
                i += 1
            step, edits = int(self.edits[s]) + 1, int(self.edits[s])
            last, i = i, i + 1
            low, high = starts(first * step - edits, (band[last] + 2) * step + edits, int(self.m[s]))
            if self.m[s] <= len(texts[t]) and high > 0 and enough_stand(self.halves[s], texts[t], first * step, (band[last] + 2) * step, edits):
                score = stretch_score(self.strings[s], texts[t], low, high, self.tolerance - 0.5, self.letters[s])
                if score >= self.tolerance:
                    yield t, s, score


def enough_stand(pieces: Sequence[str], text: str, low: int, high: int, edits: int) -> bool:
    """Whether all pieces but as many as there may be edits stand in the text at shifts from low to under high: each edit harms one, and the others' shifts lie in the band of the longer ones."""
    at, left = 0, edits
    for piece in pieces:
        if text.find(piece, max(low + at, 0), max(high + at + len(piece) - 1, 0)) < 0:
            left -= 1
            if left < 0:
                return False
        at += len(piece)
    return True


def starts(low: int, high: int, m: int) -> tuple[int, int]:
    """Where windows may start: where one may start with the text, so may those cut off by its start."""
    return (1 - m if low <= 0 < high else low), high


def stretch_score(short: str, text: str, low: int, high: int, least: float, letters: dict[str, int] | None = None) -> int:
    """best_window of starts (some of them in the text) from low to under high, rounded; 0 where not even the whole stretch has enough of short's letters in their order."""
    m, letters = len(short), letters or places(short)
    if short in text[max(low, 0) : max(high - 1 + m, 0)]:
        return 100
    shared = common(letters, m, text[max(low, 0) : max(high - 1 + m, 0)])
    size = shared if low < 0 or high - 1 + m > len(text) else m  # a window that is cut off has no more letters in common than letters
    return 0 if 200.0 * shared < (m + size) * (least - 1e-9) else round(best_window(short, text, range(low, high), least, letters))
