"""Word and line scans over Arrow string columns: pieces as byte strings, known by 128-bit names."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step handles; bounds the temporary arrays.
STEP_BYTES = 1 << 19
#: Words of more bytes are named by a cryptographic digest.
LONG_WORD = 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: The first n bytes of a little-endian word, n from 0 to 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def mix_other(h: np.ndarray) -> np.ndarray:
    """Another one, of other shifts and factors."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


def digest(piece: bytes, key: int = 0) -> bytes:
    """A 128-bit cryptographic digest."""
    return hashlib.blake2b(piece, digest_size=16, key=key.to_bytes(16, "little")).digest()


def text_steps(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, UTF-8 texts) in steps of about STEP_BYTES; a null text counts as empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = memoryview(column.buffers()[2] or b"")
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
        end = min(end, n)
        cuts = offsets[at : end + 1].tolist()
        yield at, end, [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        at = end


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, maximal runs of bytes other than \\x20 and \\x09-\\x0D, in lists of bounded size."""
    at, n = 0, len(text)
    while at < n:
        end = at + STEP_BYTES
        if end < n:
            found = _SPACE.search(text, end)
            end = found.start() if found else n
        yield (text if at == 0 and end >= n else text[at:end]).split()  # bytes split at exactly these
        at = end


def words(texts: list[bytes], lower: bool = False, key: int = 0) -> Pieces:
    """Words of texts, each named by 128 bits: two hashes of its bytes that share no constants, under a 128-bit key, or a
    digest if the word is long. lower folds A-Z."""
    joined = b" ".join(texts)
    if lower:
        joined = joined.lower()
    names, places, at = [], [], 0
    while at < len(joined):
        end = at + STEP_BYTES
        found = _SPACE.search(joined, end) if end < len(joined) else None
        end = found.start() if found else len(joined)
        part = joined[at:end]
        starts, name = _named(part, key)
        names.append(name.tobytes())
        places.append(starts + at)
        at = end
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    owner = np.searchsorted(begins, np.concatenate(places), "right") - 1 if places else np.empty(0, np.int64)
    return Pieces(b"".join(names), np.bincount(owner, minlength=len(texts)).tolist())


def _named(part: bytes, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the words of a part begin, their names as two columns). Bytes are taken eight at a time: each step mixes
    the next eight of all words that still have some."""
    data = np.frombuffer(part, np.uint8)
    edge = np.diff(~_IS_SPACE[data], prepend=False, append=False)
    bounds = np.flatnonzero(edge)
    starts, sizes = bounds[::2], bounds[1::2] - bounds[::2]
    eight = np.ndarray((len(part),), "<u8", part + b"\0" * 8, strides=(1,))
    low, high = U64(key & (1 << 64) - 1), U64(key >> 64)
    h = mix(sizes.astype(U64) * U64(0x9E3779B97F4A7C15) + low)
    g = mix_other(sizes.astype(U64) * U64(0xD6E8FEB86659FD93) + high)
    live = np.flatnonzero(sizes <= LONG_WORD)
    done = 0
    while len(live):
        lane = eight[starts[live] + done] & _FIRST[np.minimum(sizes[live] - done, 8)]
        h[live] = mix(h[live] ^ lane)
        g[live] = mix_other(g[live] ^ lane * U64(0xA0761D6478BD642F))
        done += 8
        live = live[sizes[live] > done]
    name = np.stack((h, g), axis=1).astype("<u8")
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        name[k] = np.frombuffer(digest(part[starts[k] : starts[k] + sizes[k]], key), "<u8")
    return starts, name


def lines(texts: list[bytes]) -> Pieces:
    """Texts split at \\n, as str.split does: a text with k line feeds has k + 1 lines, an empty text one empty line."""
    names, counts = [], []
    for text in texts:
        own = text.split(b"\n")
        names += map(digest, own)
        counts.append(len(own))
    return Pieces(b"".join(names), counts)


class Pieces:
    """Words or lines of a run of texts: the 128-bit name of each, and how many each text has."""

    __slots__ = ("counts", "first", "names", "owner")

    def __init__(self, names: bytes, counts: list[int]) -> None:
        self.names = names
        self.counts = np.array(counts, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.owner = np.repeat(np.arange(len(counts)), self.counts)

    def __len__(self) -> int:
        return len(self.owner)

    def windows(self, width: int) -> np.ndarray:
        """Where runs of `width` pieces begin that lie in one text."""
        return np.flatnonzero(self.owner[: max(0, len(self) - width + 1)] == self.owner[width - 1 :])

    def hashes(self, width: int, at: np.ndarray, half: int = 0) -> np.ndarray:
        """64 bits of the windows that begin at `at`, from one half of their pieces' names; equal windows have equal
        ones. Halves of a run are mixed in turn. Both halves together are 128 bits, as good as independent ones."""
        known = {1: np.frombuffer(self.names, "<u8")[half::2].astype(U64)}
        return _run(known, width)[at]

    def digests(self, width: int, at: np.ndarray) -> np.ndarray:
        """(windows, 2) 64-bit halves of the 128-bit digest of each window that begins at `at`."""
        names, size = memoryview(self.names), 16 * width
        raw = b"".join([hashlib.blake2b(names[i : i + size], digest_size=16).digest() for i in (at * 16).tolist()])
        return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _run(known: dict[int, np.ndarray], width: int) -> np.ndarray:
    """The hash of each run of `width` pieces, from those of its halves. Not a closure: one that calls itself would hold
    the arrays until the next collection of cycles."""
    if width not in known:
        left, right = _run(known, width // 2), _run(known, width - width // 2)
        size = max(0, len(known[1]) - width + 1)
        known[width] = mix(left[:size] * U64(0x9E3779B97F4A7C15) + (right[width // 2 : width // 2 + size] ^ U64(width)))
    return known[width]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n positions lie in a window of `width` that begins at one of `starts`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def kept_words(text: bytes, gone: np.ndarray) -> bytes:
    """The words of a text that are not gone, joined by one space."""
    out, at, stay = [], 0, ~gone
    for part in word_parts(text):
        mine = stay[at : at + len(part)]
        out += part if mine.all() else [w for w, s in zip(part, mine.tolist()) if s]
        at += len(part)
    return b" ".join(out)


def kept_lines(text: bytes, gone: np.ndarray) -> bytes:
    """The lines of a text that are not gone, joined by line feeds."""
    return b"\n".join([line for line, g in zip(text.split(b"\n"), gone.tolist()) if not g])
