"""Texts for the tests."""

import re


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(n, seed=0):
    """``n`` words that repeat no sequence of three."""
    return " ".join(f"w{(seed * 7919 + i * i + 31 * i) % 100003}" for i in range(n))
