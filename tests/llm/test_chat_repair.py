"""Conversation repair against exhaustive search and a plain minimum over all states."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from foliant.llm import chat_repair
from foliant.llm.queries import damaged, repaired_digests

QUERY_ROWS = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
FORM = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = BLANK.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def choices(row, fault):
    """(cost, letter, row kept) of each edit of a turn."""
    role, text = row
    yield 2, "D", None
    if fault not in ("blank", "duplicate"):
        extra = 5 * (fault == "truncated")
        yield extra, "K", row
        for new in NAMES.values():
            yield 1 + extra, "R", (new, text)


def exhaustive(rows, most=2):
    """The least (cost, audit) and the turns it leaves, of all edits with up to ``most`` insertions in each gap."""
    found, best = faults(rows), None
    inserts = [(5 * n, "I" * n, list(x)) for n in range(most + 1) for x in itertools.product([(r, "") for r in NAMES.values()], repeat=n)]
    slots = [inserts]
    for row, fault in zip(rows, found):
        slots += [[(c, letter, [kept] if kept else []) for c, letter, kept in choices(row, fault)], inserts]
    for pick in itertools.product(*slots):
        left = [r for p in pick for r in p[2]]
        if FORM.fullmatch("".join(r[0][:1] or "?" for r in left)):
            new = (sum(p[0] for p in pick), "".join(p[1] for p in pick), left)
            best = new if best is None or new[:2] < best[:2] else best
    return best


def plain(rows):
    """The same by dynamic programming over whole audits."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def opened(states):
        for _ in range(3):
            for state, (cost, audit, left) in list(states.items()):
                for i, name in NAMES.items():
                    after = moves.get((state, i))
                    new = (cost + 5, audit + "I", (left, (name, "")))
                    if after and (after not in states or new[:2] < states[after][:2]):
                        states[after] = new
        return states

    states = {"": (0, "", None)}
    for row, fault in zip(rows, faults(rows)):
        after = {}
        for state, (cost, audit, left) in opened(states).items():
            for c, letter, kept in choices(row, fault):
                to = state if kept is None else moves.get((state, kept[0][:1]))
                new = (cost + c, audit + letter, left if kept is None else (left, kept))
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        states = after
    cost, audit, left = min((x for s, x in opened(states).items() if s in ("", "a")), key=lambda x: x[:2])
    out = []
    while left:
        left, row = left
        out.append(row)
    return cost, audit, out[::-1]


def expected(conv_rows):
    """The query's row of one conversation from its damaged (turn, role, text) rows in order."""
    rows = [(r, t) for _, r, t in conv_rows]
    found = faults(rows)
    cost, audit, left = plain(rows) if rows else (0, "", [])
    turns = [t for t, _, _ in conv_rows if t is not None]
    pairs = ["".join(r[:1] for r in (a, b)) for (a, _), (b, _) in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
    )


def model(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]  # noqa: B018
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {conv: expected(sorted(own, key=key)) for conv, own in out.items()}


def digests_of(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names) for r in frame.collect()}


TEXTS = ["Hi.", "Yes!", "no end", "", " \t\n", "Hi.", "Long? ", "x. \r\n", "é!", None]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Ubuntu"]


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(most)):
            rows.append((conv, rng.choice([turn, turn, turn * 3, None]), rng.choice(ROLES), rng.choice(TEXTS)))
    return rows


def test_automaton():
    p = chat_repair.Parser()
    assert p.terminals == ["a", "s", "u"] and len(p.nodes) <= 10
    for n in range(7):
        for word in map("".join, itertools.product("sua", repeat=n)):
            at = {0}
            for c in word:
                at = {x for node in at for x in p.moves[node][c]}
            assert any(p.accepting[node] for node in at) == bool(FORM.fullmatch(word)), word
    with pytest.raises(ValueError):
        chat_repair.Parser((("S", ""), ("S", "uS")))


def test_models_agree():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B!", "c", "", "A."])) for _ in range(rng.randrange(4))]
        assert exhaustive(rows) == plain(rows), rows


@pytest.mark.parametrize("stretch", [1 << 16, 3])
def test_conversations_equal_the_model(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat_repair, "STRETCH", stretch)
    rows = random_rows(1, 300, 9) + [(None, 1, "user", "Hi."), (None, None, None, None), (-5, 2, "user", "t" * 50_000 + "."), (-5, 3, "assistant", "ok.")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], QUERY_ROWS + ", place long, edit string")
    assert digests_of(repaired_digests(table)) == model(rows)


def test_one_long_conversation_is_spread(spark):
    rng = random.Random(9)
    rows = [(4, i, rng.choice(["user", "assistant", "user", "system"]), f"{rng.choice(['A', 'B', i])}{rng.choice('.. !x')}") for i in range(3000)]
    rows += [(5, 0, "user", "Q?"), (5, 1, "assistant", "A."), (3, 0, "assistant", "only")]
    table = spark.createDataFrame(rows, QUERY_ROWS).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = chat_repair.placed(damaged(table))
        assert len({r[0] >> 33 for r in turns.where("conv_id = 4").select("place").collect()}) > 1
        assert digests_of(repaired_digests(table)) == model(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    assert repaired_digests(spark.createDataFrame([], QUERY_ROWS)).count() == 0
