"""Licence expressions: only known names, whole names, exceptions, linear time; against plain evaluation on random expressions."""

import random
import time

import pytest

from folioflow.llm import licenses
from folioflow.llm.queries import QUERIES

NAMES = {"MIT": 0.1, "Apache-2.0": 0.1, "BSD-3-Clause": 0.1, "GPL-3.0-or-later": 0.6, "LGPL-2.1+": 0.4, "MPL-2.0": 0.4, "CC-BY-SA-4.0": 0.5, "CC-BY-NC-ND-4.0": 0.8, "CC0-1.0": 0.0, "LicenseRef-Ours": 0.9}


def labels(text):
    return {x for x, base, _ in licenses.Scanner().scan(text.encode())[1] if not base}


@pytest.mark.parametrize(
    "text",
    [
        "the SPDX license identifier tells machines what applies",
        "SPDX-License-Identifier: see the file COPYING",
        "SPDX-License-Identifier: https://example.org/licence",
        "SPDX-License-Identifier: mitzvah",
        "SPDX-License-Identifier: GPLfoo",
        "SPDX-License-Identifier: mit-style",
        "SPDX-License-Identifier:",
        "SPDX-License-Identifier:\nMIT",
    ],
)
def test_prose_gives_no_labels(text):
    assert labels(text) == set() and licenses.Scanner().scan(text.encode())[2] == 0


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("SPDX-License-Identifier: MIT.", {"mit"}),
        ("SPDX-License-Identifier: Apache-2.0 -->", {"apache-2.0"}),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) is what holds", {"mit", "apache-2.0"}),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", {"gpl-2.0-only", "linux-syscall-note"}),
        ("SPDX-License-Identifier: MIT AND", {"mit"}),
        ("SPDX-License-Identifier: LicenseRef-acme-1", {"licenseref-acme-1"}),
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC", {"mit", "isc"}),
        ("SPDX-License-Identifier: MIT AND SPDX-License-Identifier: ISC", {"mit", "isc"}),
        ("SPDX-License-Identifier: MIT WITH nothing-known", {"mit"}),
    ],
)
def test_names_that_count(text, wanted):
    assert labels(text) == wanted


def random_expression(rng, depth=0):
    """(text, value by recursion, precedence of its top)."""
    pick = rng.random()
    if depth > 3 or pick < 0.4:
        name = rng.choice(list(NAMES))
        if rng.random() < 0.2:
            return f"{name} WITH Classpath-exception-2.0", NAMES[name] / 2, 3
        return name, NAMES[name], 4
    word, way, binds = ("OR", min, 1) if pick < 0.7 else ("AND", max, 2)
    (a, x, p), (b, y, q) = random_expression(rng, depth + 1), random_expression(rng, depth + 1)
    a, b = (f"({t})" if r < binds or (t is b and r == binds) else t for t, r in ((a, p), (b, q)))
    return f"{a} {word} {b}", way(x, y), binds


def test_random_expressions_by_recursion():
    rng = random.Random(3)
    for _ in range(300):
        text, value, _ = random_expression(rng)
        assert licenses.evaluate(text)[1] == pytest.approx(value), text


def test_a_line_of_tags_takes_linear_time():
    line = b"SPDX-License-Identifier: MIT AND " * 150_000
    start = time.process_time()
    n, found, score = licenses.Scanner().scan(line)
    assert (n, len(found), score) == (750_000, 150_000, 0.1)
    assert time.process_time() - start < 15
    start = time.process_time()
    assert licenses.Scanner().scan(b"SPDX-License-Identifier: " + b"(" * 1_000_000 + b"MIT")[2] == 0.1
    assert time.process_time() - start < 15


def test_query_labels_hold_the_base(spark, small):
    for r in QUERIES["op4_aho_corasick"](spark, small).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


@pytest.mark.parametrize(
    "text,names,score",
    [
        ("MIT AND CECILL-2.1", {"mit", "cecill-2.1"}, 0.6),
        ("CECILL-2.1 OR MIT", {"cecill-2.1", "mit"}, 0.1),
        ("GPL-2.0-only WITH Bootloader-exception OR UPL-1.0", {"gpl-2.0-only", "bootloader-exception", "upl-1.0"}, 0.1),
        ("AGPL-3.0-only OR (MIT AND Vim)", {"agpl-3.0-only", "mit", "vim"}, 0.1),
        # Names of no list: as restricted as what isn't known.
        ("Frobnicate-1.0 AND MIT", {"frobnicate-1.0", "mit"}, 0.9),
        ("MIT OR Frobnicate-1.0", {"mit", "frobnicate-1.0"}, 0.1),
        ("(Frobnicate-1.0 OR Other-2) AND ISC", {"frobnicate-1.0", "other-2", "isc"}, 0.9),
        ("MPL-2.0 WITH Frobnicate-exception-3", {"mpl-2.0", "frobnicate-exception-3"}, 0.2),
        # Prose is none.
        ("MIT and other things", {"mit"}, 0.1),
        ("Frobnicate-1.0", set(), 0.0),
        ("MIT WITH pleasure", {"mit"}, 0.1),
        ("MIT OR else", {"mit"}, 0.1),
    ],
)
def test_names_of_no_list(text, names, score):
    tag = f"SPDX-License-Identifier: {text}"
    assert labels(tag) == names and licenses.Scanner().scan(tag.encode())[2] == pytest.approx(score)
