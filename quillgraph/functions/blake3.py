"""BLAKE3 by whole arrays: the chunks of many texts go through the compression together, and chaining values are paired level by level."""

from __future__ import annotations

import numpy as np

# Initial chaining value, order of words from round to round, flags, bytes of a chunk and a block.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = np.array([2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8])
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values [n, 8] of n blocks: values [n, 8], words [n, 16], and for each its counter, bytes and flags."""
    n = len(words)
    v = np.empty((16, n), np.uint32)
    v[:8], v[8:12] = cv.T, IV[:4, None]
    v[12], v[13] = (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32)
    v[14], v[15] = size, flags
    m = words.T.copy()
    for _ in range(7):
        # columns, then diagonals: four mixings at a time
        for shift, half in ((0, m[:8]), (1, m[8:])):
            a, b, c, d = v[0:4], v[[4 + (k + shift) % 4 for k in range(4)]], v[[8 + (k + 2 * shift) % 4 for k in range(4)]], v[[12 + (k + 3 * shift) % 4 for k in range(4)]]
            for word, r, s in ((half[0::2], 16, 12), (half[1::2], 8, 7)):
                a = a + b + word
                d = _turn(d ^ a, r)
                c = c + d
                b = _turn(b ^ c, s)
            v[0:4] = a
            for k in range(4):
                v[4 + (k + shift) % 4], v[8 + (k + 2 * shift) % 4], v[12 + (k + 3 * shift) % 4] = b[k], c[k], d[k]
        m = m[ORDER]
    return (v[:8] ^ v[8:]).T


def leaves(texts: list[bytes], first: list[int] | None = None, root: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Chaining values of the chunks of all texts, one text after the other, and how many each has; a text's first chunk is number ``first`` of its file, or 0.

    With ``root`` the only chunk of a text of one chunk is the root of its tree.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    many = np.maximum(1, -(-sizes // CHUNK))
    ends = np.cumsum(many)
    n = int(ends[-1])
    room = bytearray(n * CHUNK)
    for x, at in zip(texts, ((ends - many) * CHUNK).tolist(), strict=True):
        room[at : at + len(x)] = x
    grid = np.frombuffer(room, "<u4").reshape(n, 16, 16)
    place = np.arange(n) - np.repeat(ends - many, many)
    size = np.clip(np.repeat(sizes, many) - place * CHUNK, 0, CHUNK)
    top = np.repeat((many == 1) & root, many)
    blocks = np.maximum(1, -(-size // BLOCK))
    cv, counter = np.tile(IV, (n, 1)), (place + (0 if first is None else np.repeat(np.array(first, np.int64), many))).astype(np.uint64)
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        last = blocks[on] == k + 1
        flags = np.where(last, CHUNK_END | np.where(top[on], ROOT, 0), 0).astype(np.uint32) | np.uint32(CHUNK_START if k == 0 else 0)
        cv[on] = compress(cv[on], grid[on, k], counter[on], np.minimum(size[on] - k * BLOCK, BLOCK).astype(np.uint32), flags)
    return cv, many


def merged(cv: np.ndarray, many: np.ndarray, root: bool) -> np.ndarray:
    """The chaining value [len(many), 8] over each text's ``many`` values: pairs level by level, an odd last one goes up as it is; all texts together."""
    while (many > 1).any():
        start = np.cumsum(many) - many
        pairs, up = many // 2, -(-many // 2)
        at = np.cumsum(up) - up
        place = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left = np.repeat(start, pairs) + 2 * place
        out = np.empty((int(up.sum()), 8), np.uint32)
        flags = np.where(np.repeat(many == 2, pairs) & root, PARENT | ROOT, PARENT).astype(np.uint32)
        words = np.concatenate([cv[left], cv[left + 1]], axis=1)
        out[np.repeat(at, pairs) + place] = compress(np.tile(IV, (len(left), 1)), words, np.zeros(len(left), np.uint64), np.full(len(left), BLOCK, np.uint32), flags)
        odd = many % 2 == 1
        out[(at + up - 1)[odd]] = cv[(start + many - 1)[odd]]
        cv, many = out, up
    return cv


def _rows(cv: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in cv.astype("<u4")]


def digests(texts: list[bytes]) -> list[bytes]:
    return _rows(merged(*leaves(texts, root=True), True)) if texts else []


def digest(data: bytes) -> bytes:
    return digests([data])[0]


def pieces(parts: list[bytes], first: list[int]) -> list[bytes]:
    """The chaining values of pieces of larger files, each of a power of two of chunks or the last of its file, by the numbers of their first chunks."""
    return _rows(merged(*leaves(parts, first), False)) if parts else []


def piece(data: bytes, first: int) -> bytes:
    return pieces([data], [first])[0]


def of_pieces(values: list[bytes]) -> bytes:
    """The digest of a file from those of its pieces, two or more, in order."""
    return _rows(merged(np.frombuffer(b"".join(values), "<u4").reshape(-1, 8).astype(np.uint32), np.array([len(values)]), True))[0]
