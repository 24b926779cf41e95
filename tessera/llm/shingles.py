"""Word-shingle sets and their MinHash signatures, vectorised over a slice of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 4
SYMBOLS = 64  # MinHash symbols of a signature
LANE = 15  # bits of a symbol; four symbols share a long, whose top four bits stay 0
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


_SEEDS = _mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (parted by ASCII white space), and how many each text has.

    ``fold`` lower-cases A-Z first.
    """
    import xxhash

    low = pc.fill_null(texts.cast(pa.large_string()), "")
    low = pc.ascii_lower(low) if fold else low
    parts = pc.ascii_split_whitespace(low)
    coded = parts.flatten().dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.large_binary()).to_pylist()
    of = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    code = coded.indices.to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = next((k for k, w in enumerate(vocabulary) if not w), None)
    if blank is not None:  # around leading and trailing white space
        real = code != blank
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
        code = code[real]
    return (of[code] if len(code) else np.zeros(0, np.uint64)), counts


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words are one shingle, no words none."""
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    rolled = hashes.copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):  # a window that begins at each word
            if len(hashes) <= k:
                break
            rolled[:len(hashes) - k] = rolled[:len(hashes) - k] * _B + hashes[k:]
        rolled = _mix(rolled)
        for n in counts.tolist():
            if n >= size:
                out.append(np.unique(rolled[at:at + n - size + 1]))
            elif n:
                short = np.uint64(n)
                for h in hashes[at:at + n]:
                    short = short * _B + h
                out.append(_mix(np.array([short])))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist())


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS MinHash symbols of LANE bits, four to a long."""
    with np.errstate(over="ignore"):
        least = np.concatenate([(shingles[None, :] * _SEEDS[k:k + 16, None]).min(1) for k in range(0, SYMBOLS, 16)])
        symbol = (_mix(least) >> np.uint64(64 - LANE)).reshape(-1, 4)
    shift = np.arange(4, dtype=np.uint64) * np.uint64(LANE)
    return (symbol << shift).sum(1).astype(np.int64)
