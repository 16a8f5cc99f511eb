"""Texts for the tests of this folder."""

WORDS = "alpha bravo carbon delta ember fjord garnet harbor indigo jungle kernel lumen mosaic nectar orbit".split()


def sentence(seed: int, n: int) -> str:
    """n words from a small generator, different for each seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 97))
    return " ".join(out)
