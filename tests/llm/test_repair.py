"""Conversation repair against a plain search, small segments and hard rows included."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from msgscreen.llm import queries, structure_repair as sr

SOUND = re.compile(r"(s?(ua)+)?")


def cheapest_by_hand(kinds, faults, entry=0, exits=None):
    """Least (cost, audit) by relaxing the whole lattice until nothing changes."""
    exits = sr.DONE if exits is None else exits
    best = {(0, entry): (0, "")}
    changed = True
    while changed:
        changed = False
        for (i, s), (cost, audit) in list(best.items()):
            for letter, more, j, t in sr.following(kinds, faults, i, s):
                new = (cost + more, audit + letter)
                if (j, t) not in best or new < best[j, t]:
                    best[j, t] = new
                    changed = True
    ends = [(best[len(kinds), s][0] + c, best[len(kinds), s][1]) for s, c in exits.items() if (len(kinds), s) in best]
    return min(ends) if ends else None


def test_lattice_of_all_short_conversations():
    for n in range(4):
        for kinds in itertools.product("sua-", repeat=n):
            for faults in itertools.product(".bt", repeat=n):
                kinds, faults = "".join(kinds), "".join(faults)
                assert sr.cheapest(kinds, faults, 0, sr.DONE) == cheapest_by_hand(kinds, faults)


def test_random_lattices_entries_and_exits():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randint(0, 14)
        kinds = "".join(rng.choice("suuaa-") for _ in range(n))
        faults = "".join(rng.choice("....bdt") for _ in range(n))
        entry = rng.randrange(4)
        exits = {s: rng.randrange(8) for s in rng.sample(range(4), rng.randint(1, 4))}
        assert sr.cheapest(kinds, faults, entry, exits) == cheapest_by_hand(kinds, faults, entry, exits)


def test_audits_give_sound_roles_by_enumeration():
    """Every edit script of short conversations, without the lattice's own edges."""
    cost_of = {"K": 0, "R": 2, "D": 3, "I": 2}

    def scripts(n, inserts):
        for letters in itertools.product("KRD", repeat=n):
            for places in itertools.combinations_with_replacement(range(n + 1), inserts):
                yield "".join("I" * places.count(i) + (letters[i] if i < n else "") for i in range(n + 1))

    def outcomes(kinds, script):
        """Whether some choice of made roles is sound."""
        options, i = [], 0
        for letter in script:
            if letter == "K":
                options.append(kinds[i])
            elif letter in "RI":
                options.append("ua")
            i += letter != "I"
        return any(SOUND.fullmatch("".join(c)) for c in itertools.product(*options))

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(0, 4)
        kinds = "".join(rng.choice("sua-") for _ in range(n))
        faults = "".join(rng.choice("..bt") for _ in range(n))
        best = None
        for inserts in range(4):
            for script in scripts(n, inserts):
                edits = script.replace("I", "")
                if any(f == "b" and e != "D" for f, e in zip(faults, edits)) or not outcomes(kinds, script):
                    continue
                cost = sum(cost_of[e] for e in script) + sum(f == "t" and e != "D" for f, e in zip(faults, edits))
                best = min(best, (cost, script)) if best else (cost, script)
        assert sr.cheapest(kinds, faults, 0, sr.DONE) == best


def by_hand(rows):
    """The contract in plain Python over ``conv_id, turn, role, text`` rows."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        spoken = lambda x: " " if x is None else str(x)
        dice = zlib.crc32(f"{spoken(conv)}:{spoken(turn)}".encode()) % 20
        if dice == 0:
            continue
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        role = "user" if dice == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if dice == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1][:100], x[2][:100], digest(x[1], x[2])))
        kinds = "".join(r[0] if r[:1] in ("s", "u", "a") else "-" for _, r, _ in turns)
        faults, seen = "", set()
        for _, role, text in turns:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "."
            seen.add((role, text))
        cost, audit = cheapest_by_hand(kinds, faults)
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        lines, state, i = [], 0, 0
        for letter in audit:
            if letter == "K":
                lines.append(f"{turns[i][1]}:{turns[i][2]}")
                state = {"s": 1, "u": 2, "a": 3}[kinds[i]]
            elif letter in "RI":
                role = "assistant" if state == 2 else "user"
                lines.append(f"{role}:{turns[i][2] if letter == 'R' else ''}")
                state = 3 if state == 2 else 2
            i += letter != "I"
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), pairs, cost, audit, sha)
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found_by(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in rows}


@pytest.fixture(scope="module")
def hard_rows():
    rng = random.Random(8)
    texts = ["Yes.", "No", "", " \t\n", "What now?", "Go!\n", "x" * 3000, "Ünï", None, "a.b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = [(c, t, rng.choice(roles[:5]), f"{rng.choice(texts)} {t}.") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(c, rng.choice([None, 0, 1, 2, 5]), rng.choice(roles), rng.choice(texts)) for c in range(100, 140) for _ in range(rng.randint(1, 12))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in (0, 1, None)]
    rows += [(-7, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(400)]
    return rows


def test_query_against_plain_python(spark, tmp_path, hard_rows):
    shape = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(hard_rows, shape).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found_by(queries.op13_repair(spark, str(tmp_path))) == by_hand(hard_rows)


def test_segments_do_not_change_results(spark, hard_rows):
    rows = spark.createDataFrame(hard_rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = sr.conversation_reports(sr.repaired(sr.damaged(rows), segment_rows=3))
    expected = {c: v for c, v in by_hand(hard_rows).items() if v[6] or v[0] or c in {r.conv_id for r in sr.damaged(rows).collect()}}
    assert found_by(found) == expected


def test_given_table(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_by(queries.op13_repair(spark, small_dir)) == by_hand(rows)


def test_repaired_turns_and_other_columns(spark):
    rows = [(1, 0, "user", "Hi.", 5, "x"), (1, 1, "user", "And?", 6, "y"), (1, 2, "assistant", "cut off", 7, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, report string")
    out = [(r.pos, r.edit, r.role, r.text) for r in sr.repaired(df).collect() if r.report is None]
    assert out == [(0, "K", "user", "Hi."), (1, "I", "assistant", ""), (2, "K", "user", "And?"), (3, "K", "assistant", "cut off")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_repair(spark, str(tmp_path)).count() == 0
