"""Structure repair and the prefix trie against plain versions, and on rows with everything that may go wrong."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from siftlake.llm import prefix_trie, repair

COLUMNS = "conv_id long, turn long, role string, text string, copies string, seg string"
#: Nulls everywhere, ties, repeats, other roles, blank and long texts; the last two columns have the operators' own names.
ODD = [
    (1, 0, "system", "Be kind."),
    (1, 1, "user", "Hi!"),
    (1, 2, "assistant", "Hello"),
    (1, 2, "assistant", "Hello"),
    (1, 2, "user", "tie."),
    (2, None, None, None),
    (2, None, "user", "x" * 70_000 + "."),
    (2, 9, "", "no role."),
    (None, 1, "user", "of nobody?"),
    (None, None, "assistant", "of nobody."),
    (3, 0, "assistant", " \n\t "),
    (3, 5, "tool", "ÄÖ 日本!"),
    (-100, 0, "user", "a."),
    (-7, 0, "user", "a."),
    (100, 0, "user", "b."),
    (101, 0, "user", "b."),
    (101, 1, "user", "b."),
    (101, 2, "assistant", "b."),
]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS)


def made(n, seed, convs=60):
    rnd = random.Random(seed)
    texts = ["One.", "Two!", "three", "", "Four?", "f i v e.", " "]
    roles = ["user", "user", "assistant", "assistant", "system", "tool"]
    return [(rnd.randrange(convs), rnd.randrange(12), rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


def after_damage(rows):
    """conv_id -> (turn, role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        order = (turn is not None, turn or 0, role, text)
        after = (turn, "user" if fault == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text))
        out.setdefault(conv, []).extend([(order, after)] * {0: 0, 3: 2}.get(fault, 1))
    return {c: [a for _, a in sorted(v, key=lambda x: x[0])] for c, v in out.items()}


def faults_of(turns):
    seen, out = set(), ""
    for _, role, text in turns:
        bare = text.strip(" \t\n\v\f\r")
        out += "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
        seen.add((role, text))
    return out


def by_all_edits(turns):
    """The cheapest repair of a few turns out of all."""
    best = None
    for edits in itertools.product("DRK", repeat=len(turns)):
        for added in itertools.product(range(3), repeat=len(turns) + 1):
            audit, roles, cost = "I" * added[0], ["?"] * added[0], 2 * sum(added)
            for (_, role, _), fault, edit, more in zip(turns, faults_of(turns), edits, added[1:]):
                if edit != "D" and fault in "bd":
                    break
                cost += {"D": 3, "R": 2, "K": 0}[edit] + (edit != "D" and fault == "t")
                roles += [role[:1] or "-"] if edit == "K" else ["?"] if edit == "R" else []
                audit += edit + "I" * more
                roles += ["?"] * more
            else:
                if any(re.fullmatch("(s?(ua)+)?", "".join(r)) for r in itertools.product(*[["u", "a"] if x == "?" else [x] for x in roles])):
                    best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def written(turns, audit):
    lines, at, initials = [], 0, ""
    rows = iter(turns)
    for edit in audit:
        turn = next(rows) if edit != "I" else (None, "", "")
        if edit != "D":
            role = turn[1] if edit == "K" else "assistant" if initials[-1:] == "u" else "user"
            initials += role[0]
            lines.append(f"{role}:{turn[2]}")
    assert re.fullmatch("(s?(ua)+)?", initials)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def whole(turns):
    known = [t for t, _, _ in turns if t is not None]
    faults = faults_of(turns)
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = repair.cheapest(repair.passed([i if i and i in "sua" else "-" for i in initials], faults))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, written(turns, audit))


def repaired_rows(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_cheapest_edits_are_those_of_all_edits():
    rnd = random.Random(5)
    for _ in range(120):
        turns = [(0, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["a.", "b.", "c", ""])) for _ in range(rnd.randrange(5))]
        initials = "".join(r[0] if r[0] in "sua" else "-" for _, r, _ in turns)
        assert repair.cheapest(repair.passed(initials, faults_of(turns))) == by_all_edits(turns)


@pytest.mark.parametrize("segment,fan", [(512, 64), (1, 2), (3, 2)])
def test_repair_by_segments(spark, segment, fan):
    rows = ODD + made(500, segment, 9)
    got = repaired_rows(repair.repaired(repair.damaged(conversations(spark, rows)), role_order="role0", text_order="text0", segment=segment, fan=fan))
    want = {c: whole(t) for c, t in after_damage(rows).items()}
    assert got == want and None in got


def test_repair_keeps_conversations_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repaired_rows(repair.repaired(repair.damaged(conversations(spark, [(gone, 0, "user", "x")]))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repaired(repair.damaged(conversations(spark, []))).count() == 0


def plain_trie(rows):
    """A row for each node, from lists of turns."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(conv, []).append((role or "", text or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        block = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(block, [])[:h] + own[c][h:])
    members, ends = {}, {}
    for c, turns in sorted(whole.items()):
        ends.setdefault(turns, []).append(str(c))
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        kids = sum(len(m) == len(node) + 1 for m in below)
        digest = hashlib.sha256(",".join(ends.get(node, [])).encode()).hexdigest()
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), kids, len(childless), saved, digest))
    return sorted(map(str, out))


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(str(tuple(r[n] for n in names)) for r in df.collect())


def copies(seed):
    """Conversations of which many share their first turns or are the same."""
    rnd = random.Random(seed)
    pools = [[("user", f"t{i} " + "é" * i) for i in range(9)], [("assistant", f"t{i}") for i in range(9)]]
    return [(c, t, *rnd.choice(pools)[min(8, t + (rnd.random() < 0.2))]) for c in range(-150, 350, 7) for t in range(rnd.randrange(1, 9))]


@pytest.mark.parametrize("chunk,prime", [(512, prefix_trie.PRIME), (2, prefix_trie.PRIME), (3, 5)])
def test_trie_by_chunks_and_with_collisions(spark, chunk, prime):
    rows = ODD + copies(chunk)
    got = trie_rows(prefix_trie.conversation_trie(conversations(spark, rows), chunk=chunk, prime=prime))
    assert got == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(conversations(spark, [(None, 0, "user", "x")])).count() == 0


@pytest.mark.parametrize("name", ["op12_structure_repair", "op13_prefix_trie"])
def test_query_equals_its_sql(spark, small, name):
    from siftlake.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{small}/conversations.parquet')")
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, want))
