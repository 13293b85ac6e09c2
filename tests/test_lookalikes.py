"""Letters of different scripts that look alike come out as one."""

from __future__ import annotations

import pytest

from segloom.llm.lookalikes import LOOKALIKES, Rewriter, rewriting

# Written down apart from the table: by code points, as the names of Unicode give the letters.
PAIRS = [
    (0x393, 0x413), (0x3A0, 0x41F), (0x3A6, 0x424), (0x4C0, 0x49), (0x474, 0x56), (0x3B1, 0x61), (0x3B1, 0x430),
    (0x3B9, 0x69), (0x3B9, 0x456), (0x3BA, 0x43A), (0x3C5, 0x75), (0x3C5, 0x57D), (0x13AA, 0x41), (0x13AA, 0x410),
    (0x13B3, 0x57), (0x13A0, 0x44), (0x13B1, 0x413), (0x2C94, 0x4B), (0xA4D3, 0x44), (0x41E, 0x555), (0x39F, 0x41E),
]


@pytest.mark.parametrize(("a", "b"), PAIRS)
def test_pairs(a, b):
    rewrite = Rewriter(rewriting({chr(a): 1, chr(b): 2}))
    assert rewrite(f"x{chr(a)}z") == rewrite(f"x{chr(b)}z")


def test_table():
    for script, (letters, others) in LOOKALIKES.items():
        assert len(letters) == len(others), script
    plain = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert len(set(map(Rewriter(rewriting(dict.fromkeys(plain, 1))), plain))) == 52
