import hashlib
import heapq
import random
import zlib

import pytest

from corpusmill.llm import repair

WS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return out


def search(rows):
    """Cheapest edits by best-first search over (row, state), ties by audit: (cost, audit, lines)."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if done.setdefault((i, state), (cost, audit)) < (cost, audit):
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines, faults
        after = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, after, (*lines, {"u": "user", "a": "assistant"}[after] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, after, (*lines, {"u": "user:", "a": "assistant:"}[after] + text)))
                if role[:1] == after or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


def brute(rows):
    out = {}
    for conv, after in damage(rows).items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        cost, audit, lines, faults = search(after)
        turns = [t for t, _, _ in after if t is not None]
        initials = [r[:1] for _, r, _ in after]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, audit string, code int, gone string")
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair.repair(repair.damaged(df)).collect()}


def drawn(seed, n):
    rng = random.Random(seed)
    says = ["yes.", "no!", "why?", "so", " ", "", "long one. and", "ok.\n", "é…", None]
    return [(rng.randrange(n // 6), turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(says) if rng.random() < 0.6 else f"text {turn}.")
            for turn in range(n)]


def test_against_search(spark):
    rows = drawn(5, 900)
    assert made(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "user", "b."), (1, 2, "user", "c."), (1, 2, "user", "c."), (1, 2, "assistant", "d."), (2, None, "user", "x."), (2, None, "user", "y.")]
    rows += [(3, i, "user" if i % 2 else "assistant", "same.") for i in range(50)] + [(4, 0, "assistant", "z" * 200_000)] + [(5, 10**12, "system", "only.")]
    gone = next(c for c in range(100, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "dropped."))
    got = made(spark, rows)
    assert got == brute(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert made(spark, []) == {}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 100, 101, 500])
def test_checkpoints_change_nothing(n):
    rng = random.Random(n)
    codes = bytes(rng.choice([0, 3, 4, 4, 4, 5, 6, 7, 8, 8, 8, 11, 12, 13, 15]) for _ in range(n))
    names, fault = ["system", "user", "assistant", "tool"], {0: "fine {}.", 3: "cut {}"}
    if all(c % 4 in fault for c in codes):
        rows = [(i, names[c // 4], fault[c % 4].format(i)) for i, c in enumerate(codes)]
        assert repair.cheapest(codes) == search(rows)[:2]
    costs = repair.END
    for c in reversed(codes):
        costs = repair.backward(c, costs)
    assert repair.cheapest(codes)[0] == costs[0]


def test_given_conversations(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair.op13(spark, path).collect()}
    assert got == brute(rows)
