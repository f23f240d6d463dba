import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from fiscalis.llm import prefix_trie as pt

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, words string, pos int, band int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "other", 7, 9) for r in rows], SCHEMA).repartition(3)


def plain(rows):
    """Nodes from all prefixes, one by one; ties of turns must be equal rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len([w for w in p[-1][1].replace(" ", "x").split(None) if w]) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(p))
        out.add((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows):
    nodes, ends = pt.prefix_trie(*pt.rebuilt_turns(pt.ordered_turns(table(spark, rows))))
    digests = {(r.pos, r.x1, r.x2): r.ends_sha256 for r in pt.end_digests(ends).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, digests.get((r.pos, r.x1, r.x2), none))
            for r in nodes.collect()]


def small(n=70):
    rows = []
    for c in range(n):
        for t in range(c % 6):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if c % 3 else c} of\tsome  words"))
    return rows


@pytest.mark.parametrize("band", [2, 3, 32])
def test_equals_plain(spark, monkeypatch, band):
    monkeypatch.setattr(pt, "BAND", band)
    got = found(spark, small())
    assert len(got) == len(set(got)) and set(got) == plain(small())


def test_deep_chains_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(pt, "BAND", 4)  # 90 turns: three levels of bands
    rows = [(c, t, "u", f"w{t} x" if t < 20 + 13 * (c % 5) else f"w{t} {c}") for c in (0, 1, 2, 3, 4, 5, 25, 26) for t in range(90 - c % 7)]
    assert set(found(spark, rows)) == plain(rows)


def test_hot_first_turn_and_copies(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE_IDS", 3)
    rows = [(c, t, "u", f"hello {t}") for c in range(100, 180) for t in range(2)] + [(c, 0, "u", "hello 0") for c in range(300, 330)]
    got = found(spark, rows)
    assert set(got) == plain(rows) and max(r[3] for r in got) == 110


def test_odd_input(spark):
    rows = [(None, 0, "u", "lost"), (0, None, None, None), (0, 1, "u", ""), (0, 1, "u", ""), (7, 5, "a", "x " * 50_000), (-5, 0, "u", "below zero"), (-25, 3, None, "y"),
            (1, 0, "u", "ein wort ñandú"), (41, 2, "u", "no base"), (2, None, "u", "null first"), (2, 0, "u", "then")]
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert found(spark, []) == []
