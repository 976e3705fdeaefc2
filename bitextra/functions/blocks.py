"""Scores of all pairs of a block of queries and a block of texts, vectorised over the pairs.

``scored`` takes two lists of comparison forms and gives the pairs that reach a score.  Lengths and character counts
rule out most pairs; what is left is decided by the exact distance, for many pairs at once: by characters with
bit-parallel columns (64 rows a machine word), by words with an alignment over a table of token costs.
The scores equal those of ``strings.fuzzy_score``.
"""

from __future__ import annotations

import numpy as np

from bitextra.functions import strings as S

#: pairs that one vectorised pass works on, and token pairs whose costs are held at once
PASS, TOKEN_PAIRS = 16_384, 8_000_000
#: bytes of the table that tells which bigrams stand near each place, at most, but for a single query
WINDOWS = 200_000_000
_ONE = np.uint64(1)


class Texts:
    """Strings as code points in one array, with lengths and starts."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1].astype(np.int64)
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _dense(alphabet: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Place of each point in the sorted ``alphabet``; its size where absent."""
    at = np.searchsorted(alphabet, points)
    at[at == len(alphabet)] = 0
    return np.where(alphabet[at] == points, at, len(alphabet)) if len(alphabet) else np.zeros(len(points), np.int64)


def _counts(alphabet: np.ndarray, t: Texts) -> np.ndarray:
    """How often each character of ``alphabet`` occurs in each text, of shape (characters, texts)."""
    owner = np.repeat(np.arange(len(t.texts)), t.length)
    at = _dense(alphabet, t.points)
    known = at < len(alphabet)
    flat = np.bincount(at[known] * len(t.texts) + owner[known], minlength=len(alphabet) * len(t.texts))
    kind = np.uint8 if not len(flat) or flat.max() < 256 else np.uint32
    return flat.astype(kind).reshape(len(alphabet), len(t.texts))


def distances(q: Texts, iq: np.ndarray, t: Texts, it: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Edit distance of each pair (iq, it); where it exceeds ``budget`` any value above that."""
    out = np.where(q.length[iq] == 0, t.length[it], budget + 1)
    words = (q.length[iq] + 63) // 64
    # pairs of one query size together, long texts first
    order = np.lexsort((-t.length[it], iq // 64, words))
    order = order[words[order] > 0]
    cuts = np.flatnonzero(np.diff(words[order] * (len(q.texts) + 1) + iq[order] // 64)) + 1
    for part in np.split(order, cuts):
        for lo in range(0, len(part), PASS):
            some = part[lo : lo + PASS]
            some = some[np.argsort(-t.length[it[some]], kind="stable")]
            out[some] = _columns(q, iq[some], t, it[some], budget[some], int(words[some[0]]))
    return out


def _columns(q: Texts, iq: np.ndarray, t: Texts, it: np.ndarray, budget: np.ndarray, words: int) -> np.ndarray:
    """Bit-parallel edit distance, one text character of every pair at a time; texts in falling length."""
    asked, own = np.unique(iq, return_inverse=True)
    chars = [q.points[q.start[i] : q.start[i] + q.length[i]] for i in asked]
    alphabet = np.unique(np.concatenate(chars))
    a = len(alphabet) + 1
    # masks[word, query * a + character]: where in the query the character stands; the last is for all others
    masks = np.zeros((words, len(asked) * a), np.uint64)
    for k, c in enumerate(chars):
        place = np.arange(len(c))
        np.bitwise_or.at(masks, (place // 64, k * a + np.searchsorted(alphabet, c)), _ONE << (place % 64).astype(np.uint64))
    n, m = t.length[it], q.length[iq]
    points = np.zeros((int(n[0]) if len(n) else 0, len(it)), np.int64)
    for k in range(len(it)):
        points[: n[k], k] = t.points[t.start[it[k]] : t.start[it[k]] + n[k]]
    points = _dense(alphabet, points.ravel()).reshape(points.shape)
    base = own * a
    out = budget + 1
    live = np.arange(len(it))
    score = m.copy()
    bit = ((m - 1) % 64).astype(np.uint64)
    plus, minus = np.full((words, len(it)), ~np.uint64(0)), np.zeros((words, len(it)), np.uint64)
    out[n == 0] = m[n == 0]
    for j in range(points.shape[0]):
        ended = int(np.searchsorted(-n, -j, "left"))  # texts of more than j characters come first
        if ended < len(live):
            out[live[ended:]] = np.where(n[ended:] == j, score[ended:], out[live[ended:]])
            live, score, bit, base, n = live[:ended], score[:ended], bit[:ended], base[:ended], n[:ended]
            plus, minus = plus[:, :ended], minus[:, :ended]
        if j and j % 16 == 0:
            keep = np.flatnonzero(score - (n - j) <= budget[live])
            if len(keep) < 0.85 * len(live):
                live, score, bit, base, n = live[keep], score[keep], bit[keep], base[keep], n[keep]
                plus, minus = np.ascontiguousarray(plus[:, keep]), np.ascontiguousarray(minus[:, keep])
        if not len(live):
            return out
        at = base + points[j, live]
        up, down = _ONE, np.uint64(0)
        for w in range(words):
            eq, pv, mv = masks[w, at], plus[w], minus[w]
            xv = eq | mv
            eq |= down
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if w == words - 1:
                score = score + ((ph >> bit) & _ONE).astype(np.int64) - ((mh >> bit) & _ONE).astype(np.int64)
            up2, down2 = ph >> np.uint64(63), mh >> np.uint64(63)
            ph = (ph << _ONE) | up
            mh = (mh << _ONE) | down
            plus[w] = mh | ~(xv | ph)
            minus[w] = ph & xv
            up, down = up2, down2
    out[live] = score
    return out


class _Windows:
    """Which bigrams stand near each place of the texts, for queries of ``low`` to ``high`` characters.

    Within d edits the place of an untouched bigram shifts by at most (d + difference of lengths) / 2, and each edit
    touches two bigrams, an insertion one.  So all of a query's bigrams but 2 d, less what the text is longer, stand in
    the text, each within its window.
    """

    def __init__(self, queries: list[np.ndarray], t: Texts, some: np.ndarray, least: float):
        low, high = min(map(len, queries)), max(map(len, queries))
        size = t.length[some]
        h = np.maximum(size, high)
        d = h - np.floor(h * least).astype(np.int64)
        first, last = (size - high - d) // 2, (size - low + d + 1) // 2
        self.width = max(8, -(-high // 24))
        blocks = -(-high // self.width)
        self.known = np.unique(np.concatenate([self.grams(x) for x in queries]))
        runs = np.maximum(size - 1, 0)
        owner = np.repeat(np.arange(len(some)), runs)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = t.start[some][owner] + place
        gram = _dense(self.known, (t.points[at].astype(np.int64) << 21) | t.points[at + 1])
        met = np.flatnonzero(gram < len(self.known))
        owner, place, gram = owner[met], place[met], gram[met]
        k0 = np.maximum((place - last[owner]) // self.width, 0)
        k1 = np.minimum((place - first[owner]) // self.width, blocks - 1)
        self.held = np.zeros((blocks * len(self.known), len(some)), np.uint8)
        flat = self.held.reshape(-1)
        for o in range(int((k1 - k0).max()) + 1 if len(k0) else 0):
            on = k0 + o <= k1
            flat[((k0[on] + o) * len(self.known) + gram[on]) * len(some) + owner[on]] = 1

    @staticmethod
    def grams(points: np.ndarray) -> np.ndarray:
        return (points[:-1].astype(np.int64) << 21) | points[1:]

    def missing(self, points: np.ndarray) -> np.ndarray:
        """How many of a query's bigrams each text lacks."""
        gram = np.searchsorted(self.known, self.grams(points))
        rows = np.arange(len(gram)) // self.width * len(self.known) + gram
        return len(gram) - self.held[rows].sum(0, dtype=np.int64)


def _fitting(q: Texts, t: Texts, least: float, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose lengths and characters allow ``least``; equal forms are left out.

    Queries of ``chars`` are compared by characters, so that the places of their bigrams count too.
    """
    alphabet = np.unique(q.points)
    rank = np.argsort(t.length, kind="stable")
    size = t.length[rank]
    counts = np.ascontiguousarray(_counts(alphabet, t)[:, rank])
    forms = np.array(t.texts, object)[rank]
    iq, it = [], []

    def band(shortest: int, longest: int) -> tuple[int, int]:
        if least <= 0:
            return 0, len(size)
        return int(np.searchsorted(size, int(shortest * least) - 1)), int(np.searchsorted(size, int(longest / least) + 2))

    # queries of about one length share their windows
    order = np.lexsort((q.length, chars))
    step = (np.log(np.maximum(q.length[order], 1)) / np.log(1.06)).astype(np.int64)
    groups = []
    for group in np.split(order, np.flatnonzero((np.diff(step) != 0) | (np.diff(chars[order]) != 0)) + 1) if len(order) else []:
        base, end = band(int(q.length[group[0]]), int(q.length[group[-1]]))
        many = max(1, WINDOWS // max(1, int(q.length[group[-1]]) * 25 * (end - base)))
        groups += [group[k : k + many] for k in range(0, len(group), many)]
    for group in groups:
        points = [q.points[q.start[i] : q.start[i] + q.length[i]] for i in group]
        base, end = band(len(points[0]), len(points[-1]))
        near = _Windows(points, t, rank[base:end], least) if chars[group[0]] and least > 0.5 and len(points[0]) > 8 and base < end else None
        for i, own in zip(group, points):
            n = len(own)
            lo, hi = band(n, n)
            if lo >= hi:
                continue
            h = np.maximum(size[lo:hi], n)
            budget = h - np.floor(h * least).astype(np.int64)
            some, times = np.unique(own, return_counts=True)
            block = counts[np.searchsorted(alphabet, some), lo:hi]
            common = np.minimum(block, np.minimum(times, np.iinfo(block.dtype).max).astype(block.dtype)[:, None]).sum(0, dtype=np.int64)
            fits = (np.minimum(size[lo:hi], n) >= least * h) & (h - common <= budget)
            if near is not None:
                fits &= near.missing(own)[lo - base : hi - base] <= 2 * budget - np.maximum(size[lo:hi] - n, 0)
            got = lo + np.flatnonzero(fits)
            got = got[forms[got] != q.texts[i]]
            if len(got):
                iq.append(np.full(len(got), i))
                it.append(rank[got])
    none = np.zeros(0, np.int64)
    return (np.concatenate(iq), np.concatenate(it)) if iq else (none, none)


def _by_char(q: Texts, t: Texts, iq: np.ndarray, it: np.ndarray, least: float) -> np.ndarray:
    h = np.maximum(q.length[iq], t.length[it])
    budget = h - np.floor(h * least).astype(np.int64)
    d = distances(q, iq, t, it, budget)
    return np.where(d > budget, 0.0, np.where(h > 0, (h - d) / np.maximum(h, 1), 1.0))


def _token_floors(x: Texts, y: Texts) -> np.ndarray:
    """Lower bound of 1 - edit score of every pair of tokens, of shape (x, y): characters that one lacks cannot stay."""
    alphabet = np.unique(x.points)
    counts = _counts(alphabet, y)
    out = np.empty((len(x.texts), len(y.texts)), np.float32)
    for i in range(len(x.texts)):
        some, times = np.unique(x.points[x.start[i] : x.start[i] + x.length[i]], return_counts=True)
        block = counts[np.searchsorted(alphabet, some)]
        common = np.minimum(block, np.minimum(times, np.iinfo(block.dtype).max).astype(block.dtype)[:, None]).sum(0, dtype=np.int64)
        out[i] = 1 - common / np.maximum(y.length, x.length[i])
    return out


def _by_words(q: Texts, t: Texts, iq: np.ndarray, it: np.ndarray, least: float) -> np.ndarray:
    """Scores by alignment of tokens for the pairs given, 0 where ``least`` is out of reach."""
    out = np.zeros(len(iq))
    asked, own = np.unique(iq, return_inverse=True)
    held, at = np.unique(it, return_inverse=True)
    tokens = [S.tokenize(q.texts[i]) for i in asked], [S.tokenize(t.texts[i]) for i in held]
    names = [sorted({w for x in side for w in x}) for side in tokens]
    if len(names[0]) * len(names[1]) > TOKEN_PAIRS and (len(asked) > 1 or len(held) > 1):
        side, ids = (own, asked) if len(asked) > 1 and (len(names[0]) > len(names[1]) or len(held) < 2) else (at, held)
        for half in (side < len(ids) // 2, side >= len(ids) // 2):
            out[half] = _by_words(q, t, iq[half], it[half], least)
        return out
    code = [{w: k for k, w in enumerate(x)} for x in names]
    ids = [[np.array([c[w] for w in x], np.int64) for x in side] for c, side in zip(code, tokens)]
    count = [np.fromiter(map(len, x), np.int64, len(x)) for x in ids]
    m, n = count[0][own], count[1][at]
    h = np.maximum(m, n)
    most = h * (1 - least) + 1e-9
    live = np.flatnonzero((np.abs(m - n) <= most) & (np.minimum(m, n) > 0))
    for k in np.flatnonzero(np.minimum(m, n) == 0):
        out[k] = S.edit_score(q.texts[iq[k]], t.texts[it[k]], least)
    if not len(live):
        return out
    words = Texts(names[0]), Texts(names[1])
    cost = _token_floors(*words)
    # least cost of each query token against any token of each text: a bound of the alignment's cost
    full = np.flatnonzero(count[1])
    ends = np.concatenate([[0], np.cumsum(count[1][full])])[:-1]
    flat = np.concatenate([ids[1][k] for k in full])
    near = np.ones((len(names[0]), len(held)), np.float32)
    for v in range(len(names[0])):
        near[v, full] = np.minimum.reduceat(cost[v][flat], ends)
    order = live[np.argsort(own[live], kind="stable")]
    kept = []
    for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        bound = near[ids[0][own[part[0]]]].sum(0)[at[part]]
        kept.append(part[bound <= most[part] + 1e-3])
    live = np.concatenate(kept)
    live = live[np.lexsort((n[live], m[live]))]
    wide = len(names[1])
    floor = cost.ravel()
    # then the alignment itself over the bounds, and over the exact costs of the tokens that meet in what is left
    kept = [np.zeros(0, np.int64)]
    for lo in range(0, len(live), PASS):
        some = live[lo : lo + PASS]
        bound = _aligned([ids[0][k] * wide for k in own[some]], [ids[1][k] for k in at[some]], floor.take, most[some] + 1e-3)
        kept.append(some[bound <= most[some] + 1e-3])
    live = np.concatenate(kept)
    for lo in range(0, len(live), PASS):
        some = live[lo : lo + PASS]
        x, y = [ids[0][k] * wide for k in own[some]], [ids[1][k] for k in at[some]]
        met = np.unique(np.concatenate([np.unique(u[:, None] + v[None, :]) for u, v in zip(x, y)]))
        a, b = met // wide, met % wide
        longer = np.maximum(words[0].length[a], words[1].length[b])
        exact = 1 - (longer - distances(words[0], a, words[1], b, longer)) / longer
        # places beyond a list's end may have no cost; what is computed there is never read
        total = _aligned(x, y, lambda k: exact[np.minimum(np.searchsorted(met, k.ravel()), len(met) - 1)].reshape(k.shape), most[some])
        out[some] = np.maximum(0.0, np.minimum(1.0, (h[some] - total) / h[some]))
    return out


def _aligned(x: list[np.ndarray], y: list[np.ndarray], cost, most: np.ndarray) -> np.ndarray:
    """Least cost of aligning each pair of token lists, infinite beyond ``most``; ``cost`` gives that of replacing, by the sum of two codes."""
    m, n = np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y))
    a, b = np.full((m.max(), len(x)), x[0][0]), np.full((n.max(), len(y)), y[0][0])
    for k, (u, v) in enumerate(zip(x, y)):
        a[: len(u), k] = u
        b[: len(v), k] = v
    row = np.repeat(np.arange(len(a) + 1, dtype=np.float64)[:, None], len(x), 1)
    out = np.full(len(x), np.inf)
    live = np.arange(len(x))
    for j in range(len(b)):
        if j % 3 == 2:
            keep = np.flatnonzero((row.min(0) <= most[live]) & (n[live] > j))
            if len(keep) < 0.85 * len(live):
                live, row, a, b = live[keep], row[:, keep], a[:, keep], b[:, keep]
                if not len(live):
                    return out
        last = row[0].copy()
        row[0] = j + 1
        here = cost(a + b[j])
        for i in range(len(a)):
            step = last + here[i]
            last = row[i + 1].copy()
            np.minimum(step, last + 1, out=step)
            np.minimum(step, row[i] + 1, out=step)
            row[i + 1] = step
        done = np.flatnonzero(n[live] == j + 1)
        out[live[done]] = row[m[live[done]], done]
    return out


def scored(queries: list[str], texts: list[str], least: float, mode: str = "auto") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in queries, place in texts, score) of the pairs of different forms that reach ``least``."""
    q, t = Texts(queries), Texts(texts)
    least = max(float(least), 0.0)
    chars = np.ones(len(queries), bool) if mode == "char" else np.fromiter(map(S.by_char, queries), bool, len(queries))
    iq, it = _fitting(q, t, least, chars)
    score = np.zeros(len(iq))
    by = chars[iq]
    score[by] = _by_char(q, t, iq[by], it[by], least)
    score[~by] = _by_words(q, t, iq[~by], it[~by], least)
    keep = score >= least
    return iq[keep], it[keep], score[keep]
