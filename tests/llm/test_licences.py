"""One licence, the right one, for each published text and notice, also edited; and runs of words against all of them."""

import re

import numpy as np
import pytest

from foliant.llm import licenses

EVERY = licenses.every_template()
FULL = EVERY[-len(licenses.FULL_TEXTS) :]


@pytest.fixture(scope="module")
def known():
    return licenses.Templates(EVERY, 0.8)


def edited(text, every=12):
    """The text with each twelfth word changed."""
    n = iter(range(10**9))
    return re.sub(r"\S+", lambda m: f"zq{k}" if (k := next(n)) % every == every - 1 else m[0], text)


@pytest.mark.parametrize(("name", "text"), EVERY, ids=[f"{n}-{i}" for i, (n, _) in enumerate(EVERY)])
def test_each_text(known, name, text):
    assert [(n, d) for n, d, *_ in known.found(text)] == [(name, 1.0)]
    assert [n for n, *_ in known.found(f"Some prose stands here.\n\n# {text}\n\nAnd other prose behind it.")] == [name]


@pytest.mark.parametrize(("name", "text"), FULL, ids=[n for n, _ in FULL])
def test_edited_texts(known, name, text):
    assert [n for n, *_ in known.found(edited(text))] == [name]
    assert [n for n, *_ in known.found(("Prose of its own. " * 40 + edited(text)) * 3)] == [name]


def plain_run(ids, own, size):
    """The best coefficient of all runs."""
    best, mine = 0.0, own[ids]
    for a in range(len(ids)):
        seen, held = set(), 0
        for b in range(a, len(ids)):
            if ids[b] not in seen:
                seen.add(ids[b])
                held += mine[b]
            best = max(best, 2 * held / (len(seen) + size))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_runs_of_words(known, seed):
    """Steps over starts lose no run that is near enough: texts with whole, cut, repeated and edited parts of a template."""
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    own = np.arange(size)
    parts = []
    for _ in range(rng.integers(1, 5)):
        part = own[rng.integers(0, 3) : size - rng.integers(0, 3)].copy()
        hit = rng.random(len(part)) < rng.choice([0, 0.03, 0.1, 0.2])
        part[hit] = rng.integers(size, size + 200, hit.sum())
        parts += [rng.integers(size, size + 200, rng.integers(0, 60)), part, rng.choice(own, rng.integers(0, 8))]
    words = np.concatenate(parts)
    _, ids = np.unique(words, return_inverse=True)
    mine = np.zeros(ids.max() + 1, bool)
    mine[ids[words < size]] = True
    dice, a, b = known.best_run(ids, mine, size)
    want = plain_run(ids, mine, size)
    if want >= 0.8:
        assert dice == pytest.approx(want)
    if dice:
        seen = set(ids[a : b + 1].tolist())
        assert dice == pytest.approx(2 * sum(mine[i] for i in seen) / (len(seen) + size))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("All rights reserved.", ["Proprietary"]),
        ("Copyright (c) 2020 A Company. All rights reserved.", ["Proprietary"]),
        ("All rights reserved by the author of this poem", []),
        ("They had all rights reserved", []),
        ("Released under the MIT License.\nAll rights reserved.", ["MIT"]),
        ("", []),
    ],
)
def test_reserved_rights(known, text, found):
    assert [n for n, *_ in known.found(text)] == found
