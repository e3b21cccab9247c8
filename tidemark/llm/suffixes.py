"""Suffix arrays by the difference-cover algorithm, in arrays."""

from __future__ import annotations

import numpy as np

#: Longest text of one call: keys of three names, of 21 bits each, must fit 64 bits.
MAX_LENGTH = 2_000_000


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Places of the keys (unsigned, of ``bits`` bits) in ascending order, equal ones by place.

    Keys and places are sorted as one integer, in two rounds where both don't fit 64 bits: several times as fast as an
    argsort.
    """
    place_bits = np.uint64(max(1, (len(key) - 1).bit_length()))
    places, mask = np.arange(len(key), dtype=np.uint64), (np.uint64(1) << place_bits) - np.uint64(1)
    low = np.uint64(64) - place_bits
    both = (key << place_bits) | places  # the upper bits of a long key fall out
    both.sort()
    order = both & mask
    if bits > low:
        both = ((key[order] >> low) << place_bits) | places
        both.sort()
        order = order[both & mask]
    return order.view(np.int64)


def _dense(text: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols' places among all symbols, from 1 on, and the largest of them."""
    largest = int(text.max())
    if largest <= MAX_LENGTH:
        place = np.cumsum(np.bincount(text) > 0, dtype=np.uint64)
        return place[text], int(place[-1])
    symbols, dense = np.unique(text, return_inverse=True)
    return dense.astype(np.uint64) + np.uint64(1), len(symbols)


def suffix_array(text: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Start of every suffix in order, or of those that the mask ``wanted`` names.  ``text`` holds integers of at least 1.

    Suffixes at positions 1 and 2 mod 3 are sorted by their first three symbols (more where they fit the key); equal keys
    share a name and the string of names is sorted by recursion until names are distinct.  The suffixes at 0 mod 3
    follow from one symbol and a rank, and both lists are merged by the place each of the latter takes among the former.
    """
    n = len(text)
    if n > MAX_LENGTH:
        raise ValueError(f"at most {MAX_LENGTH} symbols at once")
    if n < 3:
        found = np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
        return found if wanted is None else found[wanted[found]]
    s, largest = _dense(text)
    bits = largest.bit_length()
    # With n = 1 mod 3 the empty suffix joins the sample, so that the names of mod 1 end before those of mod 2 begin.
    m_1, m_2 = len(range(1, n + (n % 3 == 1), 3)), len(range(2, n, 3))
    per_key = max(3, (64 - (m_1 + m_2).bit_length()) // bits)
    s = np.concatenate((s, np.zeros(per_key + 3, np.uint64)))
    key = s[: n + 1].copy()
    for k in range(1, per_key):
        key <<= np.uint64(bits)
        key |= s[k : k + n + 1]
    key = np.concatenate((key[1 : n + (n % 3 == 1) : 3], key[2:n:3]))
    order = _order(key, per_key * bits)
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    name = np.empty(m_1 + m_2, np.int64)
    name[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(name)
        name[order] = np.arange(1, m_1 + m_2 + 1)
    rank = np.zeros(n + 5, np.uint64)
    rank[1 : 1 + 3 * m_1 : 3] = name[:m_1]
    rank[2 : 2 + 3 * m_2 : 3] = name[m_1:]
    rank_bits = np.uint64((m_1 + m_2).bit_length())

    def after(at: slice | np.ndarray, symbols: int) -> np.ndarray:
        """The first symbols of suffixes and the rank of what follows, as one integer."""
        if isinstance(at, slice):
            at_k = lambda x, k: x[at.start + k : at.stop + k : 3]
        else:
            at_k = lambda x, k: x[at + k]
        out = at_k(s, 0)
        for k in range(1, symbols):
            out = (out << np.uint64(bits)) | at_k(s, k)
        return (out << rank_bits) | at_k(rank, symbols)

    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))[order]
    if wanted is None:
        sample = sample[sample < n]
        at_0, at_1, at_2 = slice(0, n, 3), slice(1, n, 3), slice(2, n, 3)
        zeros = np.arange(0, n, 3)
    else:
        sample = sample[np.append(wanted, False)[sample]]
        zeros, at_1, at_2 = (np.flatnonzero(wanted[k::3]) * 3 + k for k in range(3))
        at_0 = zeros
    order = _order(after(at_0, 1), bits + int(rank_bits)) if len(zeros) else np.empty(0, np.int64)
    zeros = zeros[order]
    below = np.searchsorted(np.sort(after(at_1, 1)), after(at_0, 1)[order])
    below += np.searchsorted(np.sort(after(at_2, 2)), after(at_0, 2)[order])
    result = np.empty(len(sample) + len(zeros), np.int64)
    at_zero = below + np.arange(len(zeros))
    taken = np.zeros(len(result), bool)
    taken[at_zero] = True
    result[at_zero] = zeros
    result[~taken] = sample
    return result


def _hashes(text: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every string of ``length`` symbols."""
    power, size, have = 0x9E3779B97F4A7C15, 1, text.astype(np.uint64)
    out, done = None, 0
    while True:
        if length & size:  # the string so far is followed by one of ``size`` symbols
            out = have if out is None else out[: len(have) - done] * np.uint64(power) + have[done:]
            done += size
        if done == length:
            out = out ^ (out >> np.uint64(33))
            return out * np.uint64(0xFF51AFD7ED558CCD)
        have = have[:-size] * np.uint64(power) + have[size:]
        power, size = power * power % (1 << 64), 2 * size


def _shared(text: np.ndarray, starts: np.ndarray, room: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """For each start the largest of ``lengths`` up to which its strings have hashes that other starts have as well, or 0:
    equal strings have equal hashes, so no longer one repeats."""
    reach, may = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    for length in lengths:
        at = np.flatnonzero(may & (room >= length))
        may = np.zeros(len(starts), bool)
        if len(at) > 1:
            h = _hashes(text, length)[starts[at]]
            ordered = np.sort(h)
            again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            if len(again):
                may[at] = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h
        reach[may] = length
    return reach


def repeated_starts(text: np.ndarray, starts: np.ndarray, room: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length (ascending), which of ``starts`` (ascending) begin a string of so many symbols that begins at another
    of them as well; a start counts only for lengths within its ``room``.

    Symbols that no string of a start with a shared hash covers leave the text before it is sorted.  Then neighbours in
    suffix order are compared: all suffixes of one prefix stand together.
    """
    reach = _shared(text, starts, room, lengths)
    able = np.flatnonzero(reach)
    found = [np.zeros(len(starts), bool) for _ in lengths]
    if not len(able):
        return found
    edge = np.zeros(len(text) + 1, np.int64)
    edge[starts[able]] += 1
    np.subtract.at(edge, starts[able] + reach[able], 1)
    inside = np.cumsum(edge[:-1]) > 0
    begins, room = (np.cumsum(inside) - 1)[starts[able]], reach[able]
    text = text[inside]
    place = np.full(len(text), -1)
    place[begins] = np.arange(len(begins))
    order = place[suffix_array(text, place >= 0)]
    # Symbols are compared by words of as many as fit 63 bits.
    bits = int(text.max()).bit_length()
    per_word = min(min(lengths), 63 // bits)
    word = text
    for k in range(1, per_word):
        word = (word[:-1] << bits) | text[k:]
    for length, repeated in zip(lengths, found, strict=True):
        fit = order[room[order] >= length]
        a, b = fit[:-1], fit[1:]
        at_a, at_b = begins[a], begins[b]
        same = np.arange(len(a))
        for at in (length - per_word, (length - per_word) // 2, *range(0, length - per_word, per_word)):  # nearly all pairs part at the first
            if not len(same):
                break
            same = same[word[at_a[same] + at] == word[at_b[same] + at]]
        repeated[able[a[same]]] = True
        repeated[able[b[same]]] = True
    return found
