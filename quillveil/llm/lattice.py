"""Subword lattice likelihood over an existing piece vocabulary.

A word is written as one space byte (the piece vocabularies' word mark) and its
UTF-8 bytes; every way to cut it into pieces is a path of the lattice, and the
forward recursion adds the paths' probabilities in log space.  Words are worked
in blocks of equal length, so the recursion runs over whole numpy columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = -np.inf
#: lattice cells (words x positions) worked on at once
BLOCK_CELLS = 1 << 19


@dataclass(frozen=True)
class Pieces:
    """A piece vocabulary: byte strings, hashed and sorted, and the existing scores."""

    hashes: np.ndarray  # sorted uint64
    ids: np.ndarray  # piece number of each hash
    byte_ids: np.ndarray  # piece number of each single-byte fallback
    prior: np.ndarray  # natural log probability of each piece, from the existing scores
    longest: int

    @property
    def size(self) -> int:
        return len(self.prior)


def _hash_bytes(value: bytes) -> int:
    h, mult, mask = 0, int(_MULT), (1 << 64) - 1
    for b in value:
        h = (h * mult + b + 1) & mask
    return h


def load_pieces(model_file: str) -> Pieces:
    """Pieces of a sentencepiece model.

    Pieces that hold a word mark anywhere but at their start can't occur in a
    word and are left out.  Merge-order scores (-1, -2, ...) are ranks rather
    than log probabilities; they become weights by Zipf's law, 1 / (rank + 2).
    True unigram scores are kept as they are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(n)])
    ranks = bool((scores[scores > -1e8] < -200).any())
    surface: dict[bytes, int] = {}
    byte_ids, prior = np.full(256, -1), []
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = len(prior)
            prior.append(-np.log(n + 2.0) if ranks else scores[i])
        elif "▁" not in piece[1:]:
            key = piece.replace("▁", " ").encode()
            if key in surface or scores[i] < -1e8:
                continue
            surface[key] = len(prior)
            prior.append(-np.log(2.0 - scores[i]) if ranks else scores[i])
    for b in np.flatnonzero(byte_ids < 0):
        byte_ids[b] = len(prior)
        prior.append(-np.log(n + 2.0))
    log_p = np.asarray(prior)
    log_p = log_p - np.logaddexp.reduce(log_p)
    hashes = np.array([_hash_bytes(k) for k in surface], dtype=np.uint64)
    order = np.argsort(hashes)
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two pieces share a hash")
    return Pieces(hashes[order], np.array(list(surface.values()))[order], byte_ids, log_p, max(map(len, surface)))


def _blocks(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, byte matrix with the word mark in front) for words of one length each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        n = int(lengths[same[0]])
        step = max(1, BLOCK_CELLS // (n + 1))
        for at in range(0, len(same), step):
            part = same[at : at + step]
            raw = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)
            yield part, np.concatenate([np.full((len(part), 1), 32, np.uint8), raw], axis=1)


def _arcs(matrix: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, piece numbers) of every piece found, by rising end."""
    n = matrix.shape[1]
    wide = matrix.astype(np.uint64) + np.uint64(1)
    running: list[np.ndarray] = []  # hash of matrix[:, start:end], for the starts in reach
    with np.errstate(over="ignore"):
        for end in range(1, n + 1):
            col = wide[:, end - 1]
            running = [h * _MULT + col for h in running[-(pieces.longest - 1) :]] + [col.copy()]
            first = end - len(running)
            for start, h in enumerate(running, first):
                at = np.searchsorted(pieces.hashes, h)
                at[at == len(pieces.hashes)] = 0
                rows = np.flatnonzero(pieces.hashes[at] == h)
                if len(rows):
                    yield start, end, rows, pieces.ids[at[rows]]
            yield end - 1, end, np.arange(len(matrix)), pieces.byte_ids[matrix[:, end - 1]]


def log_likelihood(words: list[bytes], pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
    """Natural log of the summed probability of all segmentations of each word."""
    out = np.zeros(len(words))
    for part, matrix in _blocks(words):
        alpha = np.full((matrix.shape[1] + 1, len(part)), _NONE)
        alpha[0] = 0.0
        for start, end, rows, ids in _arcs(matrix, pieces):
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + log_p[ids])
        out[part] = alpha[-1]
    return out


def expected_counts(words: list[bytes], weights: np.ndarray, pieces: Pieces, log_p: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted expected use of each piece over all segmentations, and the weighted log likelihood."""
    total, fit = np.zeros(pieces.size), 0.0
    for part, matrix in _blocks(words):
        n = matrix.shape[1]
        alpha = np.full((n + 1, len(part)), _NONE)
        beta = np.full((n + 1, len(part)), _NONE)
        alpha[0], beta[n] = 0.0, 0.0
        arcs = list(_arcs(matrix, pieces))
        for start, end, rows, ids in arcs:
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + log_p[ids])
        for start, end, rows, ids in reversed(arcs):
            beta[start, rows] = np.logaddexp(beta[start, rows], beta[end, rows] + log_p[ids])
        w, z = weights[part], alpha[n]
        fit += float(w @ z)
        for start, end, rows, ids in arcs:
            share = w[rows] * np.exp(alpha[start, rows] + log_p[ids] + beta[end, rows] - z[rows])
            total += np.bincount(ids, weights=share, minlength=pieces.size)
    return total, fit
