"""Randomness that does not depend on partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions import quantiles


def hash_uniform(*keys: Column | str) -> Column:
    """A uniform in (0, 1) that is a function of its keys alone: 48 bits of their MD5."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def hash_normal(*keys: Column | str) -> Column:
    """A standard normal from two hash uniforms (Box-Muller)."""
    u = hash_uniform(*keys, F.lit("r"))
    v = hash_uniform(*keys, F.lit("phi"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)


def generator(seed: int, *keys) -> np.random.Generator:
    """A counter-based generator for one group: its stream depends on seed and keys, not on the task."""
    digest = hashlib.blake2b(repr((int(seed), *map(str, keys))).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


class Hashed:
    """Draws that any engine with 64-bit integers can replay: uniforms are hashes of the keys, the draw's number and the particle's.

    Normals are Box-Muller pairs of two draws; counts and gammas invert one uniform.
    """

    def __init__(self, seed: int, *keys):
        text = "|".join(map(str, (int(seed), *keys)))
        self.key, self.draws = int(hashlib.md5(text.encode()).hexdigest()[:8], 16), 0

    def random(self, n: int | None = None):
        call = np.uint64((self.key + self.draws * 0x9E3779B1) & 0xFFFFFFFF)
        self.draws += 1
        u = (_mix32((_mix32(call) + np.arange(n or 1, dtype=np.uint64) * np.uint64(0x85EBCA6B)) & _MASK32) + 0.5) / 2.0**32
        return float(u[0]) if n is None else u

    def standard_normal(self, n: int | None = None):
        return np.sqrt(-2 * np.log(self.random(n))) * np.cos(2 * np.pi * self.random(n))

    def standard_gamma(self, shape) -> np.ndarray:
        return quantiles.gamma(self.random(np.size(shape)).reshape(np.shape(shape)), shape)

    def poisson(self, lam) -> np.ndarray:
        return quantiles.poisson(self.random(np.size(lam)).reshape(np.shape(lam)), lam)

    def binomial(self, n, p) -> np.ndarray:
        return quantiles.binomial(self.random(np.size(n)).reshape(np.shape(n)), n, p)

    def integers(self, top: int) -> int:
        return int(self.random() * top)


_MASK32 = np.uint64(0xFFFFFFFF)


def _mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit integer hash in 64-bit integers; products stay below 2 ** 64."""
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x7FEB352D)) & _MASK32
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x846CA68B)) & _MASK32
    return x ^ (x >> np.uint64(16))


class Expected:
    """Expectations in place of draws: a model's deterministic skeleton."""

    def random(self, n: int | None = None):
        return 0.5 if n is None else np.full(n, 0.5)

    def standard_normal(self, n: int | None = None):
        return 0.0 if n is None else np.zeros(n)

    def standard_gamma(self, shape) -> np.ndarray:
        return np.asarray(shape, float)

    def poisson(self, lam) -> np.ndarray:
        return np.asarray(lam, float)

    def binomial(self, n, p) -> np.ndarray:
        return np.asarray(n, float) * p


def stream(draws: str, seed: int, *keys):
    """The source of a job's randomness: ``philox`` (the default, fastest) or ``hash`` (replayable anywhere)."""
    return {"philox": generator, "hash": Hashed}[draws](seed, *keys)
