"""Edit matching on repetitive and long texts, repeated items, several blocks, null ids, against brute force."""

import random
import time

import numpy as np
import pytest

from folioflow.llm import decontaminate


def best_places(pattern, text):
    """Least edits that turn the pattern into a part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def distance_of(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_repetitive_texts_equal_brute_force():
    rng = np.random.default_rng(8)
    hits = 0
    for k in range(60):
        unit = "".join(rng.choice(list("ab"), int(rng.integers(1, 4))))
        end = " ".join("".join(rng.choice(list("abc"), int(rng.integers(1, 5)))) for _ in range(4))
        item = f"{f'{unit} ' * int(rng.integers(8, 20))}{end}"
        changed = list(end)
        for _ in range(int(rng.integers(0, 14))):
            changed[int(rng.integers(len(changed)))] = str(rng.choice(list("abcd")))
        text = f"{f'{unit} ' * int(rng.integers(40, 200))}{''.join(changed)} {f'{unit} ' * 30}"
        matcher = decontaminate.Matcher([item.encode()], 0.15)
        true = best_places(matcher.items[0].text, decontaminate.normalised(text.encode()))
        found = matcher.matches(text.encode())
        assert bool(found) == bool(matcher.matches(text.encode(), first_only=True)) == (true <= matcher.items[0].budget)
        if found:
            hits += 1
            assert found[0][1] == true
    assert 10 < hits < 60


def test_places_have_the_distance_they_say():
    rng = np.random.default_rng(9)
    for _ in range(40):
        item = f"{'la ' * 40}and then the song is over"
        edited = list("and then the song is over")
        for _ in range(int(rng.integers(0, 6))):
            edited[int(rng.integers(len(edited)))] = "x"
        text = f"{'la ' * 300}{''.join(edited)}{' la' * 50}"
        matcher = decontaminate.Matcher([item.encode()])
        for _, edits, start, end in matcher.matches(text.encode()):
            assert abs(distance_of(item, text[start:end]) - edits) <= 2  # a word is taken whole where the place ends inside it


def test_a_megabyte_of_one_phrase_takes_seconds():
    matcher = decontaminate.Matcher([f"{'la ' * 60}and then the song is over for good".encode()])
    start = time.process_time()
    assert matcher.matches(b"la " * 333_333) == []
    assert time.process_time() - start < 20  # minutes if every hit were verified by itself


def test_ranges_unite_and_stay_inside():
    got = list(decontaminate.ranges({0: [0, 1], 10: [30]}, 5, 20, 2000))
    assert got == [(0, 148), (1905, 1994)]
    assert list(decontaminate.ranges({}, 5, 20, 2000)) == []


def test_blocks_repeated_items_and_null_ids(spark):
    passage = "seven green bottles stood upon the old stone wall until the morning came"
    items = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, "no such passage stands in any text that is looked at here"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"Once, {passage.upper()}!"), (None, f"{passage} and {passage}"), (8, None), (9, "")], "doc_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 60):
        found = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, items, block_bytes=size).collect()), key=repr)
        assert found == sorted([(d, i, 0) for d in (7, None) for i in (1, 1, None)], key=repr)
        assert sorted(r["doc_id"] for r in decontaminate.without_matches(docs, items, block_bytes=size).collect()) == [8, 9]


def test_bands_equal_the_whole_table(monkeypatch):
    """Patterns with a part in common with a text, on any diagonal, by bands of any first width."""
    rng = random.Random(8)
    for _ in range(300):
        monkeypatch.setattr(decontaminate, "BAND", rng.choice([1, 3, 64]))
        monkeypatch.setattr(decontaminate, "COLUMNS", rng.choice([1, 4, 1000]))
        pattern = "".join(rng.choice("abcd ") for _ in range(rng.randrange(5, 60)))
        copy = list(pattern)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        before = "".join(rng.choice("abcd ") for _ in range(rng.randrange(6)))
        text = before + "".join(copy) + "".join(rng.choice("abcd ") for _ in range(rng.randrange(6)))
        most = rng.randrange(6, 12)
        where = decontaminate.bits(pattern)
        whole = decontaminate.distance(where, len(pattern), text, most)
        # Every way of at most `most` edits stays in a band of that many about the diagonal that it begins on.
        near = [decontaminate.banded(where, len(pattern), text, most, d) for d in range(len(text) + 1)]
        assert min(n for n in near if n[1] >= 0)[0] == whole[0] if whole[1] >= 0 else all(n[1] < 0 for n in near)
        assert decontaminate.banded(where, len(pattern), text, len(pattern) + len(text), 0, True)[0] == decontaminate.distance(where, len(pattern), text, len(pattern) + len(text), True)[0]


@pytest.mark.parametrize("size, seconds", [(12_000, 1.5), (200_000, 10)])
def test_long_items(size, seconds):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(size // 6)]
    item = " ".join(words)
    text = list(item)
    text[size // 3] = "Q"
    del text[size // 2]
    text.insert(2 * size // 3, "Q")
    text = "before it " + "".join(text) + " behind it"
    start = time.perf_counter()
    (found,) = decontaminate.Matcher([item.encode()]).matches(text.encode())
    assert time.perf_counter() - start < seconds
    assert found[1] <= 3 and text[found[2] : found[3]].startswith(words[0]) and text[found[2] : found[3]].endswith(words[-1])
    if size < 20_000:
        assert decontaminate.Matcher([item.encode()]).matches(" ".join(reversed(words)).encode()) == []
