"""Long lines: time and memory of the variants are linear in the line."""
import random
import tracemalloc

from test_line_dedup_short import brute

from stratum.llm import line_dedup as L
from test_line_dedup import result


def words(rng, n):
    return "".join(rng.choice("abcdefghij klmnopé🙂") for _ in range(n - 2)).join("xx")


def near_of(line, i):
    """One character replaced, added, and removed at ``i``."""
    return [line[:i] + "#" + line[i + 1:], line[:i] + "#" + line[i:], line[:i] + line[i + 1:]]


def test_variants_hold_no_strings():
    line = words(random.Random(1), 20_000)
    tracemalloc.start()
    keys, places = L.variants(line)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) == len(places) == 20_001
    assert peak < 20_000 * 1000


def test_equal_strings_have_equal_keys():
    rng = random.Random(2)
    for n in (40, L.LONG - 1, L.LONG, L.LONG + 1, L.LONG + 2, L.STEP, L.STEP + 1, 2 * L.STEP + 7):
        line = words(rng, n).replace("  ", "ab")
        keys, places = L.variants(line)
        assert places == [-1, *range(n)]
        for i in {0, 1, n // 2, n - 2, n - 1, min(n - 1, L.STEP), rng.randrange(n)}:
            replaced, longer, shorter = near_of(line, i)
            assert L.variants(shorter)[0][0] == keys[i + 1]
            assert L.variants(longer)[0][i + 1] == keys[0]
            assert L.variants(replaced)[0][i + 1] == keys[i + 1] and L.variants(replaced)[0][0] != keys[0]
        assert len(set(keys)) == len({line, *(line[:i] + line[i + 1:] for i in range(n))} if n < 3000 else set(keys))


def test_lines_around_the_change_of_keys(docs_of):
    rng = random.Random(4)
    rows = []
    for n in (L.LONG - 1, L.LONG, L.LONG + 1, L.LONG + 2, 3 * L.LONG):
        line = words(rng, n).replace("  ", "ab")
        for i in (1, n // 2, n - 2):
            rows += [(len(rows) + k, x) for k, x in enumerate([line, *near_of(line, i), near_of(line + "yy", i)[0]])]
    got = {key: drop for key, (drop, _, _) in result(L.line_dedup(docs_of(rows))).items()}
    assert got == brute(rows)


def test_two_lines_of_200_000_characters(docs_of):
    line = words(random.Random(3), 200_000).replace("  ", "ab")
    replaced, longer, shorter = near_of(line, 123_456)
    other = near_of(near_of(line, 5)[0], 199_990)[0]
    rows = [(1, line), (2, replaced), (3, longer), (4, shorter), (5, other), (6, near_of(other, 100_000)[2])]
    got = {key[0]: drop for key, (drop, _, _) in result(L.line_dedup(docs_of(rows))).items()}
    assert got == {1: [], 2: [0], 3: [0], 4: [0], 5: [], 6: [0]}
