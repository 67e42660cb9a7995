"""Words and shingle hashes of texts, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of size words joined by spaces, repeats included; of all words where there are fewer."""
    own = words(text)
    if not own:
        return np.empty(0, np.uint64)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(own))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(own) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(own) - size + 1)
