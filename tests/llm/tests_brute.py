"""Brute-force near-duplicate groups for the pipeline's tests."""

from gridloom.llm.simhash import fingerprint


def groups_of(texts: dict[int, str]) -> set[int]:
    """Smallest ids of the groups of texts whose fingerprints differ in at most three bits."""
    ids = sorted(texts)
    fps = [fingerprint(texts[i]) for i in ids]
    up = list(range(len(ids)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {ids[i] for i in range(len(ids)) if root(i) == i}
