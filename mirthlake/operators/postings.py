"""Documents of one task, searched for the k best by BM25 of many queries: rows of bits for usual words, lists for the rest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from ..functions import patterns as P

#: Words of a task that have a row of bits, at most, and the share of its documents that a word must be in for one.
ROWS, SHARE = 1024, 1 / 1024


def counted(rows: list[np.ndarray], spare: list[np.ndarray]) -> list[np.ndarray]:
    """How many of the rows have each bit: binary digits, lowest first, in arrays of spare, by full adders over whole rows."""
    digits, rows, free = [], [(r, False) for r in rows], list(spare)
    while rows:
        carried = []
        while len(rows) > 1:
            (a, a_ours), (b, b_ours) = rows.pop(0), rows.pop(0)
            one, two = free.pop(), free.pop()
            np.bitwise_xor(a, b, out=one)
            np.bitwise_and(a, b, out=two)
            if rows:
                c, c_ours = rows.pop(0)
                both = free.pop()
                np.bitwise_and(one, c, out=both)
                np.bitwise_or(two, both, out=two)
                np.bitwise_xor(one, c, out=one)
                free += [both, c] if c_ours else [both]
            free += [x for x, ours in ((a, a_ours), (b, b_ours)) if ours]
            carried.append((two, True))
            rows.append((one, True))
        digits.append(rows[0][0])
        rows = carried
    return digits


def at_least(digits: list[np.ndarray], n: int) -> np.ndarray:
    """Bits that n (1 or more) of the counted rows have, or more."""
    if n >> len(digits):
        return np.zeros_like(digits[0])
    same = more = None
    for i in range(len(digits) - 1, -1, -1):
        if n >> i & 1:
            same = digits[i] if same is None else same & digits[i]
        else:
            x = digits[i] if same is None else same & digits[i]
            more = x if more is None else more | x
            if n & ((1 << i) - 1):
                same = ~digits[i] if same is None else same & ~digits[i]
            else:
                break
    return same if more is None else more if same is None else more | same


def places(mask: np.ndarray) -> np.ndarray:
    """Where bits are set: words are sifted first, then bytes, then bits."""
    some = np.flatnonzero(mask != 0)
    part = mask[some].view(np.uint8)
    full = np.flatnonzero(part != 0)
    at = np.flatnonzero(np.unpackbits(part[full], bitorder="little").view(bool))
    full = full[at >> 3]
    return (some[full >> 3] << 6) + ((full & 7) << 3) + (at & 7)


class Postings:
    """What is known of the documents of one task.

    A part is (words, counts, documents, codes, frequencies and lengths by code, number of documents): words are places
    in the vocabulary, or -1. Documents stand in the order of their lengths, so that a posting of a word that stands once
    weighs the same, or less, the further back it is. Such postings of usual words are bits; all others, those of
    documents with a second length among them, are listed with their weights.
    """

    def __init__(self, parts: list[tuple], n_words: int, mean: float):
        weight = lambda tf, n: tf * (P.BM25_K1 + 1) / (tf + P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * n / mean))
        n_docs = sum(p[-1] for p in parts)
        total, long, begin = np.zeros(n_words, np.int64), np.full(n_docs, 1 << 40), 0
        for words, counts, docs, code, _, n, size in parts:
            np.add.at(total, words[words >= 0], counts[words >= 0])
            long[begin + docs.astype(np.int64)] = n[code]
            begin += size
        self.order = np.argsort(long, kind="stable")
        place = np.empty(n_docs, np.int32)
        place[self.order] = np.arange(n_docs, dtype=np.int32)
        # weights of a word that stands once fall in steps, to each the documents up to a word of bits
        one = weight(1, long[self.order])
        steps = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
        ends = np.r_[steps[1:], n_docs]
        self.levels, self.stops = one[steps], (-(-ends // 64)).tolist()
        self.level = np.repeat(np.arange(len(steps)), ends - steps).astype(np.min_scalar_type(len(steps)))
        usual = np.argsort(-total, kind="stable")[:ROWS]
        usual = usual[total[usual] > max(n_docs * SHARE, 1)]
        self.row = np.full(n_words, -1, np.int64)
        self.row[usual] = np.arange(len(usual))
        self.bits = np.zeros((len(usual), -(-n_docs // 64) * 8), np.uint8)
        rest, begin = [], 0
        for words, counts, docs, code, tf, n, size in parts:
            docs, word = begin + docs.astype(np.int64), np.repeat(words, counts)
            begin += size
            plain = (self.row[word] >= 0) & (tf[code] == 1) & (n[code] == long[docs])
            mine = np.flatnonzero(plain & (word >= 0))
            at = place[docs[mine]]
            np.bitwise_or.at(self.bits.reshape(-1), self.row[word[mine]] * self.bits.shape[1] + (at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
            mine = np.flatnonzero(~plain & (word >= 0))
            rest.append((word[mine].astype(np.int32), place[docs[mine]], weight(tf, n)[code[mine]]))
        word, at, weights = [np.concatenate(x) for x in zip(*rest)]
        mine = np.lexsort((at, word))
        self.at, self.weights, self.ends = at[mine], weights[mine], np.searchsorted(word[mine], np.arange(n_words + 1))

    def search(self, texts: Iterable[list[int]], idf: np.ndarray, number: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text (different places in the vocabulary) its k best documents and scores; equal scores go by number.

        Documents in a list of one of the words are looked at first. Of all others only the ones with so many of the usual
        words that, with the heaviest of these and at their length, they could reach the k best found: none is left out.
        """
        bits, wide, tie = self.bits.reshape(-1), self.bits.view(np.uint64), number[self.order]
        texts = [np.asarray(ws, np.int64) for ws in texts]
        spare = [np.empty(wide.shape[1], np.uint64) for _ in range(min(max(map(len, texts), default=0), len(wide)) + 4)]
        slot = np.full(len(self.order), -1, np.int32)
        nothing, none = np.empty(0, np.int64), np.empty(0)

        def better(docs: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The k best of the documents so far and of others, with the sums of their lists."""
            least = score[-1] if len(score) == k else 0.0
            if len(rows):
                byte, bit, f = docs >> 3, (docs & 7).astype(np.uint8), self.levels.take(self.level.take(docs))
                if len(docs) > max(512, 2 * k):  # bounds by the number of usual words, before these are looked up
                    n = np.zeros(len(docs), np.min_scalar_type(len(rows)))
                    for i, d in enumerate(digits):
                        n |= (d.view(np.uint8).take(byte) >> bit & 1).astype(n.dtype, copy=False) << i
                    low = sums + f * lightest.take(n)
                    least = max(least, np.partition(low, len(low) - k)[len(low) - k])
                    keep = np.flatnonzero(sums + f * heaviest.take(n) >= least - 2e-6)
                    docs, byte, bit, f, sums = docs[keep], byte[keep], bit[keep], f[keep], sums[keep]
                sums = sums + f * (weights @ (bits.take(starts + byte) >> bit & 1))
            keep = np.flatnonzero(sums >= least - 1e-6)
            docs, v = docs[keep], sums[keep]
            if len(v) > 4 * k:  # rounding may make two scores one
                keep = v >= np.partition(v, len(v) - k)[len(v) - k] - 1e-6
                docs, v = docs[keep], v[keep]
            docs, v = np.concatenate([best, docs]), np.concatenate([score, np.floor(v * 1e6 + 0.5) / 1e6])
            first = np.lexsort((tie[docs], -v))[:k]
            first = first[v[first] > 0]
            return docs[first], v[first]

        for ws in texts:
            best, score = nothing, none
            usual = ws[self.row[ws] >= 0]
            usual = usual[np.argsort(-idf[usual])]
            rows, weights = self.row[usual], idf[usual]
            heaviest, lightest = np.zeros((2, len(rows) + 1))
            np.cumsum(weights, out=heaviest[1:])
            np.cumsum(weights[::-1], out=lightest[1:])
            starts, digits = rows[:, None] * self.bits.shape[1], counted([wide[r] for r in rows.tolist()], spare)
            lists = [(a, b, w) for a, b, w in zip(self.ends[ws].tolist(), self.ends[ws + 1].tolist(), idf[ws].tolist()) if b > a]
            seen = []
            if lists:
                at = np.concatenate([self.at[a:b] for a, b, _ in lists])
                count = np.arange(len(at), dtype=np.int32)
                slot[at] = count  # the last of several stays
                own = slot[at]
                first = np.flatnonzero(own == count)
                seen = [at[first].astype(np.int64)]
                best, score = better(seen[0], np.bincount(own, np.concatenate([self.weights[a:b] * w for a, b, w in lists]), len(at))[first])
            if len(rows):
                if len(score) < k:
                    n = len(rows)
                    while n > 1 and np.bitwise_count(at_least(digits, n)).sum(dtype=np.int64) < k:
                        n -= 1
                    more = places(at_least(digits, n))
                    more = more[slot[more] < 0]
                    best, score = better(more, np.zeros(len(more)))
                    slot[more] = 0
                    seen.append(more)
                least = score[-1] - 2e-6 if len(score) == k else 0.0
                begin, masks = 0, []
                for n, steps in enumerate(np.searchsorted(-self.levels, -least / heaviest[1:], side="right").tolist(), 1):
                    end = self.stops[steps - 1] if steps else 0
                    if end > begin:
                        masks.append(at_least([d[begin:end] for d in digits], n))
                        begin = end
                        if end == len(digits[0]):
                            break
                if masks:
                    more = places(np.concatenate(masks))
                    more = more[slot[more] < 0]
                    best, score = better(more, np.zeros(len(more)))
            for x in seen:
                slot[x] = -1
            yield self.order[best], score
