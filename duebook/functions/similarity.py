"""Name similarity scores, computed for a whole Arrow batch at once.

Both scores rest on the length of the longest common subsequence, found with the
bit-parallel recurrence of Hyyrö (2004): one 64-bit word per pair, one numpy step
per character. Strings longer than 64 characters take the same recurrence on
Python's unbounded integers.

``token_set``  how alike two names are as sets of tokens (0-100)
``partial``    how alike the shorter name is to its best place in the longer
``held``       with spaces removed, one name contains the other
"""

from __future__ import annotations

from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# ---- fixed values: thresholds of the resolution ladder ---------------------
ACCEPT = 90.0
BORDERLINE = 72.0
MARGIN = 4.0
SUSPECT = 85.0
SHORTEST_NEEDLE = 4
SHORTEST_HELD = 5
# ---------------------------------------------------------------------------

WORD_BITS = 64
PAIRS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 2000
NEEDLES_AT_ONCE = 256
FIRST_LOOK = 4
LETTER_WIDTH, PAIR_WIDTH, TOKEN_WIDTH = 256, 512, 256      # columns of hashed counts
SLACK = 1e-3                   # for rounding; bounds may be loose, never tight
# 2*C/(m+C) >= 0.85 solved for C, the characters two names have in common.
_SHARED_FLOOR = SUSPECT / 100 / (2 - SUSPECT / 100) - 1e-9


def _long_lcs(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


class Names:
    """A list of strings encoded for the numpy recurrence. Code 0 is padding."""

    def __init__(self, texts):
        self.texts = list(texts)
        n = len(self.texts)
        points = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"),
                               dtype=np.uint32)
        alphabet, code = np.unique(points, return_inverse=True)
        code = code + 1
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        row = np.repeat(np.arange(n), self.size)
        at = np.arange(len(points)) - (np.cumsum(self.size) - self.size)[row]
        self.codes = np.zeros((n, int(self.size.max(initial=0))), dtype=np.int64)
        self.codes[row, at] = code
        self.masks = np.zeros((n, len(alphabet) + 1), dtype=np.uint64)
        fits = at < WORD_BITS
        np.bitwise_or.at(self.masks, (row[fits], code[fits]),
                         np.uint64(1) << at[fits].astype(np.uint64))

    def lcs(self, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        """LCS length of each pair (ia[k], ib[k])."""
        return self._windows(ia, ib, np.zeros(len(ia), dtype=np.int64), self.size[ib])

    def _windows(self, ia, ib, start, length) -> np.ndarray:
        """LCS of name ia with the slice [start, start+length) of name ib."""
        out = np.empty(len(ia), dtype=np.int64)
        wide = self.size[ia] > WORD_BITS
        for k in np.flatnonzero(wide):
            text = self.texts[ib[k]][start[k]:start[k] + length[k]]
            out[k] = _long_lcs(self.texts[ia[k]], text)
        rest = np.flatnonzero(~wide)
        for at in range(0, len(rest), PAIRS_AT_ONCE):
            k = rest[at:at + PAIRS_AT_ONCE]
            a, b, s0, n = ia[k], ib[k], start[k], length[k]
            ones = np.uint64(0xFFFFFFFFFFFFFFFF)
            s = np.full(len(k), ones)
            for j in range(int(n.max(initial=0))):
                pos = np.minimum(s0 + j, self.codes.shape[1] - 1)
                ch = np.where(j < n, self.codes[b, pos], 0)
                u = s & self.masks[a, ch]
                s = (s + u) | (s - u)
            size = self.size[a].astype(np.uint64)
            used = np.where(size == WORD_BITS, ones,
                            (np.uint64(1) << (size % np.uint64(WORD_BITS))) - np.uint64(1))
            out[k] = np.bitwise_count(~s & used)
        return out

    def partial(self, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        """partial score of each pair."""
        swap = self.size[ia] > self.size[ib]
        short, long = np.where(swap, ib, ia), np.where(swap, ia, ib)
        best = self._best_place(short, long)
        same = np.flatnonzero(self.size[short] == self.size[long])
        if len(same):
            best[same] = np.maximum(best[same], self._best_place(long[same], short[same]))
        return best

    def _best_place(self, short, long) -> np.ndarray:
        best = np.zeros(len(short))
        m, n = self.size[short], self.size[long]
        live = np.flatnonzero(m > 0)
        per_pair = m + n - 1                      # every prefix, window and suffix
        cuts = np.searchsorted(np.cumsum(per_pair[live]),
                               np.arange(0, per_pair[live].sum() + 1, PAIRS_AT_ONCE))
        bounds = np.unique(np.concatenate([cuts, [len(live)]]))
        for lo, hi in zip(np.concatenate([[0], bounds[:-1]]), bounds):
            k = live[lo:hi]
            if not len(k):
                continue
            row = np.repeat(np.arange(len(k)), per_pair[k])
            first = np.cumsum(per_pair[k]) - per_pair[k]
            offset = np.arange(len(row)) - first[row] - (m[k][row] - 1)
            begin = np.maximum(offset, 0)
            length = np.minimum(offset + m[k][row], n[k][row]) - begin
            got = self._windows(short[k][row], long[k][row], begin, length)
            total = m[k][row] + length
            score = (1.0 - (total - 2 * got) / total) * 100.0
            best[k] = np.maximum.reduceat(score, first)
        return best


def _joined(tokens) -> str:
    return " ".join(sorted(tokens))


def _hashed_counts(rows: list[list], width: int) -> np.ndarray:
    """Row vectors that count each row's features, by hash. A dot product of two is never
    below the number of features they share."""
    out = np.zeros((len(rows), width), dtype=np.float32)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.fromiter((crc32(f.encode("utf-8", "surrogatepass")) for r in rows for f in r),
                         np.int64, len(at)) % width
    np.add.at(out, (at, column), 1)
    return out


def _numbered(parts) -> list[str]:
    """Parts of a text, equal ones told apart by how often they came before."""
    seen: dict[str, int] = {}
    out = []
    for p in parts:
        seen[p] = n = seen.get(p, 0) + 1
        out.append(f"{p}\0{n}")
    return out


class Comparison:
    """The scores of needles against known names, for pairs (i, j) of their places, and
    bounds that tell from a few matrix products which pairs can reach a score at all.

    A pair's letters in common bound a common subsequence from above. Two texts of lengths m
    and w with a common subsequence of L letters share at least 3 L - m - w - 1 pairs of
    neighbouring letters: of the m - 1 in the first each unmatched letter spoils two, and
    each unmatched letter of the second parts one. Tokens in common bound how much of either
    name they can make up."""

    def __init__(self, left, right):
        self.left, self.right = list(left), list(right)
        self.shift = len(self.left)
        self.texts = self.left + self.right
        self.sets = [frozenset(t.split()) for t in self.texts]
        self.bare = [t.replace(" ", "") for t in self.texts]

    @cached_property
    def names(self) -> Names:
        return Names(self.texts)

    @cached_property
    def sorted_names(self) -> Names:
        return Names([_joined(s) for s in self.sets])

    # -- scores
    def token_set(self, ia, ib) -> np.ndarray:
        score = np.zeros(len(ia))
        if not len(ia):
            return score
        sets, shift = self.sets, self.shift
        overlap = np.fromiter((not sets[i].isdisjoint(sets[j + shift])
                               for i, j in zip(ia.tolist(), ib.tolist())), dtype=bool,
                              count=len(ia))

        # No token in common: plain ratio of the sorted token strings.
        names = self.sorted_names
        k = np.flatnonzero(~overlap)
        a, b = ia[k], ib[k] + shift
        total = names.size[a] + names.size[b]
        usable = (names.size[a] > 0) & (names.size[b] > 0)
        k, a, b, total = k[usable], a[usable], b[usable], total[usable]
        score[k] = 100.0 - 100.0 * (total - 2 * names.lcs(a, b)) / total

        # Some in common: the leftovers decide, seen from three sides.
        k = np.flatnonzero(overlap)
        common, rest_a, rest_b = [], [], []
        for i, j in zip(ia[k].tolist(), ib[k].tolist()):
            both = sets[i] & sets[j + shift]
            common.append(sum(map(len, both)) + len(both) - 1)
            rest_a.append(_joined(sets[i] - both))
            rest_b.append(_joined(sets[j + shift] - both))
        if len(k):
            texts = {t: n for n, t in enumerate(dict.fromkeys(rest_a + rest_b))}
            rests = Names(texts)
            a = np.array([texts[t] for t in rest_a])
            b = np.array([texts[t] for t in rest_b])
            s = np.array(common)
            la, lb = rests.size[a], rests.size[b]
            whole_a, whole_b = s + 1 + la, s + 1 + lb
            sides = [100.0 - 100.0 * (la + lb - 2 * rests.lcs(a, b)) / (whole_a + whole_b),
                     100.0 - 100.0 * (1 + la) / (s + whole_a),
                     100.0 - 100.0 * (1 + lb) / (s + whole_b)]
            score[k] = np.where((la == 0) | (lb == 0), 100.0, np.maximum.reduce(sides))
        return score

    def held(self, ia, ib) -> np.ndarray:
        bare, shift = self.bare, self.shift
        return np.fromiter(
            (len(bare[i]) >= SHORTEST_HELD and len(bare[j + shift]) >= SHORTEST_HELD
             and (bare[i] in bare[j + shift] or bare[j + shift] in bare[i])
             for i, j in zip(ia.tolist(), ib.tolist())), dtype=bool, count=len(ia))

    def partial(self, ia, ib) -> np.ndarray:
        return self.names.partial(ia, ib + self.shift)

    def related(self, ia, ib) -> np.ndarray:
        """True where a pair may not be called unrelated: some score reaches its floor."""
        out = np.zeros(len(ia), dtype=bool)
        k = np.flatnonzero(self._long_enough[ia])
        out[k] = self.token_set(ia[k], ib[k]) >= BORDERLINE
        k = k[~out[k]]
        out[k] = self.held(ia[k], ib[k])
        k = k[~out[k]]
        _, letters, pairs = self.shared(ia[k], ib[k])
        chance = self._place_chance(ia[k], ib[k], letters, pairs)
        out[k[chance]] = self.partial(ia[k[chance]], ib[k[chance]]) >= SUSPECT
        return out

    # -- bounds
    @cached_property
    def _long_enough(self) -> np.ndarray:
        return np.array([len(t) >= SHORTEST_NEEDLE for t in self.left], dtype=bool)

    @cached_property
    def _sizes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = [sum(map(len, s)) + max(len(s) - 1, 0) for s in self.sets]
        return tuple(np.array(x, dtype=np.float32) for x in (
            [len(t) for t in self.texts], whole, [len(t) for t in self.bare]))

    @cached_property
    def _features(self) -> tuple[np.ndarray, ...]:
        letters = _hashed_counts([_numbered(t) for t in self.texts], LETTER_WIDTH)
        pairs = _hashed_counts([_numbered(map("".join, zip(t, t[1:]))) for t in self.texts],
                               PAIR_WIDTH)
        tokens = _hashed_counts([list(s) for s in self.sets], TOKEN_WIDTH)
        weights = np.zeros_like(tokens)
        at = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        flat = [t for s in self.sets for t in s]
        column = np.fromiter((crc32(t.encode("utf-8", "surrogatepass")) for t in flat),
                             np.int64, len(flat)) % TOKEN_WIDTH
        np.add.at(weights, (at, column), np.array([len(t) + 1 for t in flat], dtype=np.float32))
        return weights, tokens, letters, pairs

    def shared(self, ia, ib) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upper bounds on what pairs share: letters of common tokens with a space each,
        letters, pairs of neighbouring letters."""
        weights, tokens, letters, pairs = self._features
        out = [np.empty(len(ia), dtype=np.float32) for _ in range(3)]
        for at in range(0, len(ia), ROWS_AT_ONCE * 4):
            part = slice(at, at + ROWS_AT_ONCE * 4)
            a, b = ia[part], ib[part] + self.shift
            for k, (x, y) in enumerate(((weights, tokens), (letters, letters), (pairs, pairs))):
                out[k][part] = np.einsum("ij,ij->i", x[a], y[b])
        return tuple(out)

    def shared_block(self, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for some needles against every known name, as matrices."""
        weights, tokens, letters, pairs = self._features
        n = self.shift
        return (weights[:n][rows] @ tokens[n:].T, letters[:n][rows] @ letters[n:].T,
                pairs[:n][rows] @ pairs[n:].T)

    def _place_chance(self, ia, ib, letters, pairs) -> np.ndarray:
        size = self._sizes[0]
        m = np.minimum(size[ia], size[ib + self.shift])
        least = (1.5 * SUSPECT / 100 - 1) * (1 + _SHARED_FLOOR) * m - 1
        return (m > 0) & (letters >= _SHARED_FLOOR * m - SLACK) & (pairs >= least - SLACK)

    def candidates(self, rows: slice) -> np.ndarray:
        """Which known names each of some needles may be related to; no related pair is
        left out."""
        common, letters, pairs = self.shared_block(rows)
        size, whole, bare = self._sizes
        i, j = np.arange(len(self.left))[rows][:, None], np.arange(len(self.right))[None, :]
        wa, wb = whole[i], whole[j + self.shift]
        t = BORDERLINE / 100
        by_token = (common > 0) & (common - 1 >= t / (2 - t) * np.minimum(wa, wb) - SLACK)
        by_letters = letters + (common > 0) >= t / 2 * (wa + wb) - SLACK
        inside = np.minimum(bare[i], bare[j + self.shift])
        by_inside = (inside >= SHORTEST_HELD) & (letters >= inside - SLACK)
        return ((by_token | by_letters | by_inside | self._place_chance(i, j, letters, pairs))
                & self._long_enough[rows][:, None])

    def token_bound(self, common, letters, i, j) -> np.ndarray:
        """What token_set cannot exceed."""
        whole = self._sizes[1]
        wa, wb = whole[i], whole[j + self.shift]
        least = np.minimum(wa, wb)
        s = common - 1
        by_token = np.where(common > 0, np.where(s >= least - SLACK, 1.0,
                                                 2 * s / np.maximum(s + least, 1)), 0)
        by_letters = 2 * (letters + (common > 0)) / np.maximum(wa + wb, 1)
        return 100 * np.minimum(np.maximum(by_token, by_letters), 1) + SLACK

    def partial_bound(self, letters, pairs, i, j) -> np.ndarray:
        """What partial cannot exceed: a place of w letters holds at most w of the common
        ones, and at most (pairs + m + w + 1) / 3."""
        size = self._sizes[0]
        m = np.minimum(size[i], size[j + self.shift])
        x = np.minimum(np.minimum(letters, (m + pairs + 1) / 2), m)
        return np.where(m > 0, 200 * x / np.maximum(m + x, 1), 0) + SLACK

    # -- searches
    def flags(self, allowed=None) -> np.ndarray:
        """Which needles are related to some known name; `allowed(rows)` gives the pairs
        that count. A needle's candidates are looked at until one is related."""
        out = np.zeros(len(self.left), dtype=bool)
        for at in range(0, len(self.left), NEEDLES_AT_ONCE):
            rows = slice(at, at + NEEDLES_AT_ONCE)
            maybe = self.candidates(rows)
            if allowed is not None:
                maybe &= allowed(rows)
            place = np.cumsum(maybe, axis=1)
            done, most = 0, FIRST_LOOK
            while done < place.shape[1]:
                ia, ib = np.nonzero(maybe & (place > done) & (place <= most)
                                    & ~out[rows][:, None])
                if not len(ia) and not (maybe & (place > most) & ~out[rows][:, None]).any():
                    break
                out[at + ia[self.related(at + ia, ib)]] = True
                done, most = most, most * 4
        return out

    def best(self, score, bound: np.ndarray, rows: np.ndarray, limit: int):
        """For each of the needles `rows` its `limit` best known names by `score(ia, ib)`
        (ties to the smaller place): (ia, ib, scores). `bound` has a row for each of them,
        and -inf where a pair does not count; pairs are scored from the highest bound on,
        until the next cannot be among the best."""
        order = np.argsort(-bound, axis=1, kind="stable")
        limits = np.take_along_axis(bound, order, axis=1)
        found = np.full(bound.shape, -np.inf)
        active = np.arange(len(rows))
        done, to = 0, 2 * limit
        while len(active) and done < bound.shape[1]:
            r, c = np.nonzero(np.isfinite(limits[active, done:to]))
            r, c = active[r], order[active[r], done + c]
            found[r, c] = score(rows[r], c)
            done, to = to, to * 3
            if done < bound.shape[1]:
                kth = -np.partition(-found[active], min(limit, bound.shape[1]) - 1,
                                    axis=1)[:, min(limit, bound.shape[1]) - 1]
                # An equal score may still win by its place.
                active = active[limits[active, done] >= kth]
                active = active[np.isfinite(limits[active, done])]
        r, c = np.nonzero(np.isfinite(found))
        value = found[r, c]
        at = np.lexsort((c, -value, r))
        r, c, value = r[at], c[at], value[at]
        first = np.arange(len(r)) - np.searchsorted(r, r) < limit
        return rows[r[first]], c[first], value[first]


def token_set(left, right, ia, ib) -> np.ndarray:
    """token_set score of each pair (left[ia[k]], right[ib[k]])."""
    return Comparison(left, right).token_set(ia, ib)


def held(left, right, ia, ib) -> np.ndarray:
    """Despaced containment of each pair; both must have real length."""
    return Comparison(left, right).held(ia, ib)


def partial(left, right, ia, ib) -> np.ndarray:
    return Comparison(left, right).partial(ia, ib)


def related(left, right, ia, ib) -> np.ndarray:
    return Comparison(left, right).related(ia, ib)


def _columnwise(score):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(a), ROWS_AT_ONCE):
            left = a.iloc[k:k + ROWS_AT_ONCE].fillna("").tolist()
            right = b.iloc[k:k + ROWS_AT_ONCE].fillna("").tolist()
            at = np.arange(len(left))
            out.append(score(left, right, at, at))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))
    return run


@F.pandas_udf(DoubleType())
def token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """token_set as a column function of two name columns."""
    return _columnwise(token_set)(a, b)


@F.pandas_udf(DoubleType())
def partial_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """partial as a column function of two name columns."""
    return _columnwise(partial)(a, b)


def held_column(a, b):
    """Despaced containment, native."""
    x, y = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    return ((F.length(x) >= SHORTEST_HELD) & (F.length(y) >= SHORTEST_HELD)
            & (y.contains(x) | x.contains(y)))
