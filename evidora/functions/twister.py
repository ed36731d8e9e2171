"""Python's generator in blocks: states far ahead of a seed, so that one sequence of draws is made by many tasks.

The Mersenne Twister is linear over bits: with P the characteristic polynomial of its step, the state after J steps is the combination
of the first states that the coefficients of x**J mod P name. P is found from the generator's own bits (Berlekamp and Massey), and
polynomials are Python integers, a bit a coefficient.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np

# The generator's size in words, and the degree of its polynomial.
WORDS, DEGREE = 624, 19937


def generator(state: np.ndarray) -> np.random.MT19937:
    """Numpy's generator of the same words, about to make its next WORDS outputs from state."""
    g = np.random.MT19937()
    g.state = {"bit_generator": "MT19937", "state": {"key": state, "pos": WORDS}}
    return g


def seeded(seed: int) -> np.ndarray:
    """The state that Python's random.Random(seed) begins with."""
    return np.array(random.Random(seed).getstate()[1][:WORDS], np.uint32)


def remainder(a: int, p: int) -> int:
    """a mod p over bits."""
    while (n := a.bit_length()) >= DEGREE + 1:
        a ^= p << (n - DEGREE - 1)
    return a


def squared(a: int) -> int:
    """a * a over bits: a zero between any two coefficients."""
    return int("0".join(format(a, "b")), 2)


@cache
def polynomial() -> int:
    """The shortest recurrence of the outputs' lowest bits, as the characteristic polynomial."""
    bits = (generator(seeded(1)).random_raw(2 * DEGREE + 64) & 1).tolist()
    now, before, degree, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = seen << 1 | bit
        if (now & seen).bit_count() & 1:
            kept = now
            now ^= before << gap
            if 2 * degree <= n:
                degree, before, gap = n + 1 - degree, kept, 0
        gap += 1
    if degree != DEGREE:
        raise ArithmeticError("the recurrence of the generator was not found")
    return int(format(now, "b").zfill(DEGREE + 1)[::-1], 2)


def doublings(stride: int, n: int) -> list[int]:
    """x**(stride * 2**i) mod P for i < n."""
    p, out = polynomial(), 1
    for bit in format(stride, "b"):
        out = remainder(squared(out) << int(bit), p)
    all_ = [out]
    while len(all_) < n:
        all_.append(remainder(squared(all_[-1]), p))
    return all_


def jump(state: np.ndarray, power: int) -> np.ndarray:
    """The state after as many outputs as the power of x says; power: x**J mod P."""
    g = generator(state)
    words = [state]
    for _ in range(-(-DEGREE // WORDS)):
        g.random_raw(WORDS)
        words.append(g.state["state"]["key"].astype(np.uint32))
    words = np.concatenate(words)
    out = np.zeros(WORDS, np.uint32)
    for i, c in enumerate(reversed(format(power, "b"))):
        if c == "1":
            out ^= words[i : i + WORDS]
    return out


def block_state(state: np.ndarray, block: int, strides: list[int]) -> np.ndarray:
    """The state at the start of a block, from the doublings of a block's length."""
    for i, power in enumerate(strides):
        if block >> i & 1:
            state = jump(state, power)
    return state


def following(g: np.random.MT19937, n: int) -> np.ndarray:
    """The generator's next n outputs: whole words of 32 bits are its outputs as they come."""
    return np.random.Generator(g).integers(0, 1 << 32, n, dtype=np.uint32)


def outputs(state: np.ndarray, n: int) -> np.ndarray:
    return following(generator(state), n)


def below(n: int, raw: np.ndarray) -> np.ndarray:
    """The draws of randrange(n) that outputs give, without those that it rejects; n of at most 32 bits."""
    draw = raw >> np.uint32(32 - n.bit_length())
    return draw[draw < n]
