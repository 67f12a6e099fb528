"""SuperMinHash signatures (Ertl 2017), a layer of all elements at a time.

Every element draws a random permutation of the slots and one random number per
step; in step j it offers ``j + random`` to the j-th slot of its permutation, and
a slot keeps the smallest offer. Step j never improves a slot that an earlier
step has reached, so all elements may take step 0, then all step 1 and so on, and
the set is done as soon as every slot is filled: the early stop, which for sets
larger than the signature comes after very few steps.
"""

from __future__ import annotations

import numpy as np

from marquee.llm.words import U64, mix

STEP = U64(0x9E3779B97F4A7C15)


def draws(elements: np.ndarray, step: int) -> np.ndarray:
    """One random 64-bit number per element and step."""
    return mix(elements + U64((int(STEP) * (step + 1)) & (2**64 - 1)))


def signature(elements: np.ndarray, slots: int, block: int = 1 << 13) -> np.ndarray:
    """Signature of a non-empty set of 64-bit hashes, as 64-bit numbers.

    The upper 16 bits are the step, the rest the random number. Equal numbers in
    a slot occur with a probability of the sets' Jaccard similarity.
    """
    out = np.full(slots, np.iinfo(np.uint64).max, dtype=U64)
    layer = np.empty_like(out)
    perms: list[np.ndarray | None] = [None] * (-(-len(elements) // block))
    for step in range(slots):
        layer.fill(np.iinfo(np.uint64).max)
        for b in range(len(perms)):
            part = elements[b * block : (b + 1) * block]
            random = draws(part, step)
            # The next place of the permutation: one Fisher-Yates swap.
            other = step + ((random & U64(0xFFFFFFFF)) % U64(slots - step)).astype(np.int64)
            if step == 0:
                slot = other
            else:
                if perms[b] is None:
                    # Step 0 is made up for: it swapped place 0 with its draw.
                    perm = np.tile(np.arange(slots, dtype=np.int16), (len(part), 1))
                    zero = (draws(part, 0) & U64(0xFFFFFFFF)) % U64(slots)
                    rows = np.arange(len(part))
                    perm[rows, zero.astype(np.int64)] = 0
                    perms[b] = perm
                perm = perms[b]
                rows = np.arange(len(part))
                slot = perm[rows, other].astype(np.int64)
                perm[rows, other] = perm[:, step]
            np.minimum.at(layer, slot, (U64(step) << U64(48)) | (random >> U64(16)))
        np.minimum(out, layer, out=out)
        if out.max() < np.iinfo(np.uint64).max:
            break
    return out


def bands(sign: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` slots, the band's number included."""
    grid = sign.reshape(-1, rows)
    total = np.arange(1, len(grid) + 1, dtype=U64)
    for i in range(rows):
        total = mix(total * STEP + grid[:, i])
    return total
