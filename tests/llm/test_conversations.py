import hashlib
import random
import zlib
from functools import lru_cache

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm.conversations import Costs, Steps, backpointers, damage, damaged_report, repair, report

SCHEMA = "conv_id long, turn long, role string, text string, key int, pos string, kind int"


def rows(seed=1, n=60):
    r = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(r.choice([1, 2, 3, 5, 9, 14])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "unknown"])
            text = r.choice(["Yes.", "No!", "half", "", " \t", None, "Why? ", "end.\n", "é?", f"text {r.random()}."])
            out.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, text))
    out += [(5, 1, "user", "same."), (5, 1, "user", "same."), (None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, None, None, None)]
    out += [(900, k, "user" if k % 2 else "assistant", f"turn {k}." if k % 7 else "again.") for k in range(700)]  # one long conversation
    return [(*x, 0, "p", 1) for x in out]


def spoil(conv, turn, role, text):
    """The rows that one row becomes."""
    space = lambda v: " " if v is None else v
    kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
    role, text = space(role), space(text)
    if kind == 0:
        return []
    if kind == 1:
        text = ""
    if kind == 2:
        text = "".join(c for c in text if c not in ".!?")
    if kind == 4:
        role = "user"
    return [(turn, role, text)] * (2 if kind == 3 else 1)


def order(turns):
    return sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, lines) by trying every edit; legal prefixes of s?(ua)+ are followed as text."""
    found = faults(turns)

    def follows(so_far, letter):
        if so_far in ("", "s"):
            return letter == "u" or (letter == "s" and not so_far)
        return letter == ("a" if so_far == "u" else "u")

    @lru_cache(None)
    def best(i, so_far, inserted):  # so_far: "", "s", or the last initial
        ways = []
        if i == len(turns):
            if so_far in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, role, text = turns[i]
            cost, audit, lines = best(i + 1, so_far, 0)
            ways.append((cost + 4, "D" + audit, lines))
            if found[i] not in ("blank", "duplicate"):
                extra = 3 if found[i] == "truncated" else 0
                for letter, new, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if new and follows(so_far, new[0]):
                        cost, audit, lines = best(i + 1, new[0], 0)
                        ways.append((cost + price + extra, letter + audit, (f"{new}:{text}", *lines)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if follows(so_far, new[0]):
                    cost, audit, lines = best(i, new[0], inserted + 1)
                    ways.append((cost + 3, "I" + audit, (f"{new}:", *lines)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def expected(given):
    convs = {}
    for conv, turn, role, text, *_ in given:
        convs.setdefault(conv, []).extend(spoil(conv, turn, role, text))
    out = []
    for conv, turns in convs.items():
        turns = order(turns)
        found = faults(turns)
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(tuple(turns))
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_same_as_trying_every_edit(spark, block):
    data = rows(block % 5)
    short = [x for x in data if x[0] != 900]
    got = damaged_report(spark.createDataFrame(short, SCHEMA).repartition(5), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(short)


def test_a_long_conversation_in_blocks(spark):
    data = [x for x in rows() if x[0] == 900]
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    small, large = (damaged_report(frame, block=b).collect() for b in (11, 1 << 16))
    assert small == large and len(small) == 1
    assert list(map(tuple, small)) == expected(data)


def test_a_task_holds_one_block():
    """Blocks leave while a conversation goes on, each before ``block`` more rows have been read."""
    read = 0

    def batches():
        nonlocal read
        for last in range(100_000, 0, -1000):
            at = range(last, last - 1000, -1)
            read += 1000
            yield pa.RecordBatch.from_arrays([pa.array([1] * 1000), pa.array(at), pa.array([p % 2 * 4 for p in at])], ["conv_id", "pos", "kind"])

    held, places = 0, []
    for out in backpointers(batches(), Costs(), 4096):
        held += sum(map(len, out["moves"].to_pylist()))
        places += out["pos"].to_pylist()
        assert read - held < 4096 + 1000
    assert held == 100_000 and places == sorted((1 + 4096 * k for k in range(25)), reverse=True)


def test_steps_are_remembered():
    steps, state = Steps(Costs()), Steps(Costs()).last
    r = random.Random(3)
    for _ in range(20_000):
        state, _, _ = steps.before(state, r.randrange(16))
    assert len(steps.known) < 500


def test_edits_are_real_rows(spark):
    data = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "More"), (2, 0, "assistant", "So."), (2, 5, "user", "And?")]
    edits = repair(spark.createDataFrame([(*x, 0, "p", 1) for x in data], SCHEMA), spark.createDataFrame([(7,), (1,)], "conv_id long"))
    got = {}
    for e in sorted(edits.collect(), key=lambda e: (e.conv_id, e.place)):
        got.setdefault(e.conv_id, []).append((e.edit, e.old_role, e.role, e.text, e.fault))
    assert got[1] == [("K", "user", "user", "Hi.", None), ("D", "user", None, None, "duplicate"), ("R", "user", "assistant", "More", "truncated")]
    assert got[2] == [("I", None, "user", "", None), ("K", "assistant", "assistant", "So.", None), ("K", "user", "user", "And?", None), ("I", None, "assistant", "", None)]
    assert got[7] == [(None, None, None, None, None)]
    rows_ = sorted(map(tuple, report(edits).collect()))
    assert [x[:8] for x in rows_] == [(1, 0, 0, 1, 1, 2, 10, "KDR"), (2, 4, 0, 0, 0, 0, 6, "IKKI"), (7, 0, 0, 0, 0, 0, 0, "")]
    assert rows_[2][8] == hashlib.sha256(b"").hexdigest()


def test_empty_costs_and_all_dropped(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    assert damaged_report(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        Costs(insert=0)
    dropped = [x for x in rows() if not spoil(*x[:4])]
    assert {(r.cost, r.audit) for r in damaged_report(spark.createDataFrame(dropped, SCHEMA)).collect()} == {(0, "")}
    assert damage(frame).where("dropped").count() == len(dropped)
    dear = report(repair(frame, costs=Costs(delete=1, insert=9, rerole=9)), Costs(delete=1, insert=9, rerole=9))
    assert dear.where(F.col("audit").contains("R")).count() < report(repair(frame)).where(F.col("audit").contains("R")).count()
