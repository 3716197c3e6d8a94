import json
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import Row
from pyspark.sql import functions as F

from corvidex.llm.conversations import connected_components, rank_lines, rebuild_conversations

SCHEMA = "record_no long, type string, message struct<role string, content string>, promptid string, uuid string, parentuuid string, timestamp string, sessionid string, version string, issidechain boolean, operation string, session string"


def has_text(content):
    if content is None:
        return False
    try:
        parts = json.loads(content) if content.lstrip().startswith("[") else None
    except ValueError:
        parts = None
    if isinstance(parts, list) and all(isinstance(p, dict) for p in parts):
        content = "".join(p.get("text") or "" for p in parts if p.get("type") == "text")
    return bool(re.search(r"[^\s​﻿]", content))


def brute(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r["record_no"]):
        if r["uuid"]:
            o = first.setdefault(r["uuid"], dict(r, text=False))
            o["text"] |= has_text(r["content"])
            for k in ("parentuuid", "sessionid", "timestamp"):
                o[k] = o[k] or r[k]
    msgs = {u: r for u, r in first.items() if r["type"] in ("user", "assistant") and not r["issidechain"]}
    ctl = {u: r for u, r in first.items() if r["type"] not in ("user", "assistant")}
    for r in msgs.values():
        seen = set()
        while r["parentuuid"] in ctl and r["parentuuid"] not in seen:
            seen.add(r["parentuuid"])
            r["parentuuid"] = ctl[r["parentuuid"]]["parentuuid"]
        if r["parentuuid"] in seen:
            r["parentuuid"] = None
    home = {}
    for u in msgs:
        path, x = [], u
        while x in msgs and not msgs[x]["sessionid"] and x not in path:
            path.append(x)
            x = msgs[x]["parentuuid"]
        home[u] = msgs[x]["sessionid"] if x in msgs and msgs[x]["sessionid"] else None
    lost = defaultdict(set)
    for u, h in home.items():
        if h is None:  # no conversation in these tests lives without any identifier
            lost[u].add(u)
    by = defaultdict(list)
    for u, h in home.items():
        by[h].append(u)
    out = []
    for s, us in by.items():
        if s is None:
            continue
        links = [msgs[u]["parentuuid"] for u in us if msgs[u]["parentuuid"]]
        if links:
            if len(links) != len(us) - 1 or any(home.get(p) != s for p in links) or max(Counter(links).values()) > 1:
                continue
            nxt = {msgs[u]["parentuuid"]: u for u in us}
            line, u = [], nxt.get(None)
            while u:
                line.append(u)
                u = nxt.get(u)
            if len(line) != len(us):
                continue
        else:
            if any(not msgs[u]["timestamp"] for u in us):
                continue
            line = sorted(us, key=lambda u: (msgs[u]["timestamp"], msgs[u]["record_no"]))
        line = [u for u in line if msgs[u]["text"]]
        kinds = [msgs[u]["type"] for u in line] + ["end"]
        if not line or kinds[0] != "user" or any(a == "user" and b != "assistant" for a, b in zip(kinds, kinds[1:])):
            continue
        out += [(s, i, msgs[u]["type"], u) for i, u in enumerate(line, 1)]
    return sorted(out)


def made(rng, n_sessions):
    rows, no = [], 0
    for s in range(n_sessions):
        prev, kind, k = None, "user", rng.choice([1, 2, 3, 4, 6, 40])
        linked = rng.random() < 0.85
        for i in range(k):
            no += 1
            u = f"s{s:03d}-{i:03d}"
            r = dict(record_no=no, type=kind, uuid=u, parentuuid=prev if linked else None, timestamp=f"2024-02-05T10:{i:02d}:00.000Z", sessionid=f"S{s:03d}", issidechain=rng.choice([False, None]))
            r["content"] = rng.choice(["hello", '[{"type":"text","text":"x"}]', "[ORB-1] go"])
            if rng.random() < 0.05:
                r["content"] = rng.choice(["", "  \n", "[]", '[{"type":"text","text":""}]', None, '[{"type":"tool","text":"t"}]'])
            dice = rng.random()
            if dice < 0.02 and linked:
                r["parentuuid"] = rng.choice([None, "missing", f"s{s:03d}-000", f"s{max(0, s - 1):03d}-000"])
            elif dice < 0.06 and linked and prev:
                r["sessionid"] = None
            elif dice < 0.08:
                r["issidechain"] = True
            elif dice < 0.09:
                r["type"] = rng.choice(["user", "assistant"])
            rows.append(r)
            if rng.random() < 0.1:
                no += 1
                rows.append(dict(r, record_no=no))
            prev = u
            if rng.random() < 0.1 and linked:
                no += 1
                rows.append(dict(record_no=no, type="system", uuid=f"c{no}", parentuuid=prev, timestamp=None, sessionid=None, issidechain=False, content=None))
                prev = f"c{no}"
            kind = "assistant" if kind == "user" or rng.random() < 0.2 else "user"
    rows.append(dict(record_no=no + 1, type="mode", uuid=None, parentuuid=None, timestamp=None, sessionid="S000", issidechain=None, content=None))
    # a line and, beside it, a ring of links
    for i, (u, p, t) in enumerate([("r0", None, "user"), ("r1", "r0", "assistant"), ("r2", "r3", "user"), ("r3", "r2", "assistant")]):
        rows.append(dict(record_no=no + 2 + i, type=t, uuid=u, parentuuid=p, timestamp=None, sessionid="RING", issidechain=None, content="x"))
    return rows


def frame(spark, rows):
    cells = [(r["record_no"], r["type"], Row(role=None, content=r["content"]), None, r["uuid"], r["parentuuid"], r["timestamp"], r["sessionid"], None, r["issidechain"], None, "clash") for r in rows]
    return spark.createDataFrame(cells, SCHEMA)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = made(rng, 150)
    want = brute([dict(r) for r in rows])
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in rebuild_conversations(frame(spark, rows)).collect())
    assert got == want and len(want) > 100
    assert rebuild_conversations(frame(spark, []).limit(0)).count() == 0


def test_conversation_without_any_identifier(spark):
    base = dict(timestamp=None, sessionid=None, issidechain=None, content="x")
    rows = [dict(base, record_no=1, type="user", uuid="b", parentuuid=None), dict(base, record_no=2, type="assistant", uuid="a", parentuuid="b")]
    assert sorted(tuple(r) for r in rebuild_conversations(frame(spark, rows)).collect()) == [("a", 1, "user", "b"), ("a", 2, "assistant", "a")]


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)] + [("q", None), ("z", "z")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    for hub_links in (10**6, 2):  # with nearly every node a hub the result is the same
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string"), hub_links).collect()}
        assert got == {x: find(x) for x in root}
    star = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(star, "u long, v long"), 500).collect()}
    assert len(got) == 3041 and all(c == (0 if x < 3000 else 10_000) for x, c in got.items())


def test_quotes_tie_a_message_to_its_session(spark):
    base = dict(timestamp=None, issidechain=None, content="x", quote=None)
    rows = [
        dict(base, record_no=1, type="user", uuid="a", parentuuid=None, sessionid=None, quote="b"),
        dict(base, record_no=2, type="assistant", uuid="b", parentuuid="a", sessionid="S"),
        dict(base, record_no=3, type="user", uuid="c", parentuuid="b", sessionid="S", quote="nothing"),
        dict(base, record_no=4, type="assistant", uuid="d", parentuuid="c", sessionid="S"),
    ]
    df = frame(spark, rows).withColumn("quoted", F.when(F.col("uuid") == "a", "b").when(F.col("uuid") == "c", "nothing"))
    assert rebuild_conversations(df).count() == 0  # the first message is in no session
    assert [(r.sessionid, r.turn_no, r.uuid) for r in rebuild_conversations(df, "quoted").orderBy("turn_no").collect()] == [("S", i, u) for i, u in enumerate("abcd", 1)]


def test_replaced_state_is_deleted(spark):
    import glob

    from corvidex.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    chain = spark.range(300).selectExpr("id as u", "id + 1 as v")
    before = set(glob.glob(f"{folder}/rdd-*"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert len(set(glob.glob(f"{folder}/rdd-*")) - before) == 1


def test_long_line_in_blocks(spark, monkeypatch):
    import corvidex.llm.conversations as c

    n = 2000
    order = list(range(n))
    random.Random(5).shuffle(order)
    rows = [("g", f"i{k}", f"i{k - 1}" if k else None, 1 if k % 3 else 0, j) for j, k in enumerate(order)]
    df = spark.createDataFrame(rows, "grp string, id string, prev string, w long, hint long")
    got = {r.id: (r.pos, r.wpos) for r in rank_lines(df.repartition(7)).collect()}
    assert got == {f"i{k}": (k + 1, sum(1 for x in range(k + 1) if x % 3)) for k in range(n)}
