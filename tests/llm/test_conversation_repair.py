import hashlib
import heapq
import random
import re
import zlib

import pytest
from stratum.llm import conversation_repair as C
from stratum.llm.queries import op13_conversation_repair

GOOD = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """Plain Python: conversation -> rows (turn, role, text) after the damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    return out


def brute(rows):
    """The best repair by a best-first search over whole edit strings."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                      else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    out = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
           "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))}
    out |= {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        roles = "".join(m[0][:1] or "-" for m in made)
        if (i, roles[-1:]) in done and i < len(rows):
            continue
        if i == len(rows) and GOOD.fullmatch(roles):
            out |= {"cost": cost, "audit": audit,
                    "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()}
            return out
        if not re.fullmatch(r"s?(ua)*u?", roles) or len(made) > len(rows) + 3:
            continue
        done.add((i, roles[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, (*made, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*made, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, (*made, (new, text))))


def made_up(rng, n):
    rows = []
    for conv in [*range(n), None]:
        for turn in rng.sample(range(9), rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin"])
            text = rng.choice(["Yes.", "No", "  \t", "", "A b?", "What! ", None, "long. " * 40, "tail.\n \v", "é…"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text))
    return rows


@pytest.mark.parametrize("bits", [12, 1])
def test_equals_brute_force(spark, tmp_path, monkeypatch, bits):
    """Also with segments of two rows, so that conversations go over many of them."""
    monkeypatch.setattr(C, "SEGMENT_BITS", bits)
    rows = made_up(random.Random(5), 150)
    spark.createDataFrame([(*r, 1.5) for r in rows], "conv_id long, turn long, role string, text string, place double") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r.asDict() for r in op13_conversation_repair(spark, str(tmp_path)).collect()}
    want = damaged(rows)
    assert found.keys() == want.keys()
    for conv, own in want.items():
        assert {k: v for k, v in found[conv].items() if k != "conv_id"} == brute(own), (conv, own)


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: r.asDict() for r in op13_conversation_repair(spark, sf).collect()}
    want = damaged(rows)
    assert found.keys() == want.keys()
    for conv, own in want.items():
        assert {k: v for k, v in found[conv].items() if k != "conv_id"} == brute(own)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """All rows in one conversation, equal rows in the thousands: pieces join to what one piece gives."""
    rng = random.Random(3)
    steps = [(rng.choice("uasx"), rng.choice([0, 0, 0, 1, 2, 3]), 1) for _ in range(3000)]
    whole = C.solve(steps, 0)
    best = min((whole[q] for q in C.ENDS if whole[q]), key=lambda x: (x[0], x[1].since(0)))
    texts = {0: "Fine {}.", 1: " ", 3: "open {}"}
    role = {"u": "user", "a": "assistant", "s": "system", "x": "x"}
    rows = [(7, i, role[s], texts[f].format(i), 1) if f != 2 else (7, i, "user", "again.", 1)
            for i, (s, f, _) in enumerate(steps)] + [(8, 1, "user", "Same.", 50_000), (8, 2, "assistant", "Yes.", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long")
    first = next(i for i, s in enumerate(steps) if s[1] == 2)
    steps = [("u", 0, 1) if i == first else s for i, s in enumerate(steps)]
    whole = C.solve(steps, 0)
    best = min((whole[q] for q in C.ENDS if whole[q]), key=lambda x: (x[0], x[1].since(0)))
    monkeypatch.setattr(C, "SEGMENT_BITS", 6)
    found = {r.conv_id: r for r in C.repair(frame).collect()}
    assert (found[7].cost, found[7].audit) == (best[0], best[1].since(0))
    assert found[8].audit == "K" + "D" * 49_999 + "K" and found[8].cost == 2 * 49_999


def test_prefixes():
    rng = random.Random(1)
    nodes = [C.Prefix(None, "")]
    for _ in range(400):
        nodes.append(C.Prefix(rng.choice(nodes[-20:]), rng.choice(["D", "K", "DK", "KKKK", ""])))
    for _ in range(800):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert C.less(a, b) == (a.since(0) < b.since(0))
        assert a.upto(a.length // 2) == C.piece_hash(0, a.since(0)[:a.length // 2])


def test_a_hash_collision_does_not_decide(monkeypatch):
    monkeypatch.setattr(C, "MOD", 2)
    test_prefixes()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_conversation_repair(spark, str(tmp_path)).collect() == []
