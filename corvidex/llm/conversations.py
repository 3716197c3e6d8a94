"""Conversations from single message records (problem 3).

1. Records are reduced to one row per ``uuid``, which gets a number once; links become
   numbers in one join, so nothing after that moves texts. Control records only pass
   links on.
2. Messages without a session are grouped with what they link to (replies and, where a
   column for them is named, quotes): connected components of their links, by alternating
   large-star and small-star joins.
3. A session is sound if its links form one unbroken line. Counting decides most of that
   (one first message, every link inside the session, no message followed twice); the
   ranking of the line decides the rest (a separate ring of links is never reached).
4. The line is ranked in two levels: stretches inside a block of rows are contracted
   first, then the few stretches are ranked by pointer doubling. No session is ever
   gathered in one task.

State that a step replaces is deleted from the checkpoint folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.operators.ordering import blocked_row_number
from corvidex.operators.timestamps import normalise_timestamps
from corvidex.session import cut_lineage, forget

#: Rows contracted together; bounds the memory of a task, not the length of a line.
BLOCK_ROWS = 65_536
#: Links of a node from which it is a hub, whose links are joined where they lie.
HUB_LINKS = 1_000_000


def _with_least(edges: DataFrame, least: DataFrame, hub_links: int) -> DataFrame:
    """``edges`` (``u``, ``v``) with the smallest neighbour ``m`` of ``u``.

    ``least`` has ``u``, ``m``, ``d`` (links). The links of hubs stay in the tasks that have
    them: there are at most (links / ``hub_links``) hubs, a small table that travels instead.
    """
    hubs = least.where(F.col("d") >= hub_links).select("u", "m")
    n = hubs.count()
    if not n:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(hubs) if n <= 100_000 else hubs
    rest = edges.join(hubs.select("u"), "u", "left_anti")
    return edges.join(hubs, "u").unionByName(rest.join(least.where(F.col("d") < hub_links).select("u", "m"), "u"))


def connected_components(edges: DataFrame, hub_links: int = HUB_LINKS) -> DataFrame:
    """(``node``, ``component``) of an undirected edge list (``u``, ``v``).

    The component is its smallest node. Alternates large-star and small-star until no
    edge changes; every step is a grouped minimum joined back to the edges, hubs apart.
    NULL ends are ignored, loops make their node known, repeated edges count once, no edges
    give an empty table.
    """
    given = edges.where("u is not null and v is not null").select("u", "v")
    nodes = given.select(F.col("u").alias("node")).union(given.select("v")).distinct()
    now = cut_lineage(given.where("u <> v").distinct())

    def mark(e: DataFrame):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = _with_least(both.where(F.col("v") > F.col("u")), least, hub_links).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        small = _with_least(down, least, hub_links).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        before, now = now, cut_lineage(small.where("u <> v").distinct())
        forget(before)
        if (mark_now := mark(now)) == seen:
            break
        seen = mark_now
    return nodes.join(now, nodes.node == now.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def _contract(t: pa.Table, groups: list[str]) -> pa.RecordBatch:
    """Stretches of the line inside one block: each row's stretch, offset and weight so far.

    Pointer doubling over the rows of the block; rows of a ring are left out.
    """
    ids, prev = t.column("id").combine_chunks(), t.column("prev").combine_chunks()
    back = np.asarray(pc.fill_null(pc.index_in(prev, value_set=ids, skip_nulls=True), -1), dtype=np.int64)
    weight = np.asarray(t.column("w"), dtype=np.int64)
    has_next = np.zeros(len(back), dtype=bool)
    has_next[back[back >= 0]] = True
    first = back < 0
    head, off, acc = np.where(first, np.arange(len(back)), back), (~first).astype(np.int64), np.where(first, 0, weight)
    for _ in range(max(1, len(back)).bit_length()):
        off, acc, head = off + off[head], acc + acc[head], head[head]
    keep = pa.array(np.flatnonzero(first[head]))
    at = pa.array(head)
    made = {
        **{g: t.column(g).combine_chunks() for g in groups}, "id": ids, "seg": ids.take(at), "off": pa.array(off), "acc": pa.array(acc + weight[head]),
        "last": pa.array(~has_next), "outer": prev.take(at),
    }
    return pa.RecordBatch.from_pydict(made).take(keep)


def _contract_blocks(groups: list[str]):
    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield _contract(pa.Table.from_batches(held), groups)
                held, n = [], 0
        if n:
            yield _contract(pa.Table.from_batches(held), groups)

    return run


def rank_lines(nodes: DataFrame, groups: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Position along unbroken lines.

    ``nodes``: group columns, ``id`` (unique), ``prev`` (id of the row before, NULL for the
    first), ``w`` (weight), ``hint`` (any value that mostly follows the line). No two rows
    may have the same ``prev``. Returns the groups, ``id``, ``pos`` (1, 2, ...) and ``wpos``
    (sum of weights up to the row). Rows of rings are not returned.
    """
    own = list(groups)
    kind = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    blocks = nodes.repartitionByRange(*own, "hint").sortWithinPartitions(*own, "hint").select(*own, "id", "prev", "w")
    schema = ", ".join(f"{g} {kind[g]}" for g in own) + f", id {kind['id']}, seg {kind['id']}, off long, acc long, last boolean, outer {kind['id']}"
    parts = cut_lineage(blocks.mapInArrow(_contract_blocks(own), schema))
    tails = parts.where("last").select("seg", F.col("id").alias("tail"), "outer", (F.col("off") + 1).alias("len"), F.col("acc").alias("weight"))
    before = tails.select(F.col("tail").alias("outer"), F.col("seg").alias("ptr"), F.col("len").alias("d"), F.col("weight").alias("dw"))
    leads = tails.where("outer is not null").select("seg", "outer").join(before, "outer", "left")
    # lost: what the stretch follows is in no stretch
    following = leads.select("seg", "ptr", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("dw", F.lit(0)).alias("dw"), F.col("ptr").isNull().alias("lost"))
    leading = tails.where("outer is null").select("seg", F.lit(None).cast(kind["id"]).alias("ptr"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("dw"), F.lit(False).alias("lost"))
    state = cut_lineage(leading.unionByName(following))
    total, open_ = state.agg(F.count(F.lit(1)), F.count("ptr")).first()
    for _ in range(math.ceil(math.log2(total + 1)) + 1):
        if not open_:
            break
        step = state.select(F.col("seg").alias("ptr"), F.col("ptr").alias("p2"), F.col("d").alias("d2"), F.col("dw").alias("dw2"), F.col("lost").alias("l2"))
        # stretches that have arrived are not joined again
        done, going = state.where("ptr is null"), state.where("ptr is not null")
        moved = going.join(step, "ptr", "left").select(
            "seg",
            F.col("p2").alias("ptr"),
            (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"),
            (F.col("dw") + F.coalesce("dw2", F.lit(0))).alias("dw"),
            F.coalesce("l2", F.lit(True)).alias("lost"),
        )
        old, state = state, cut_lineage(done.unionByName(moved))
        forget(old)
        open_ = state.where("ptr is not null").count()
    ranked = state.where("ptr is null and not lost").select("seg", "d", "dw")
    return parts.join(ranked, "seg").select(*own, "id", (F.col("d") + F.col("off") + 1).alias("pos"), (F.col("dw") + F.col("acc")).alias("wpos"))


def _visible(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[^\s\p{Z}\p{C}]"), F.lit(False))


def message_text(content: Column) -> Column:
    """Plain text of a message: the content itself, or its parts of type ``text`` by line."""
    parts = F.from_json(F.when(F.ltrim(content).startswith("["), content), "array<struct<type:string,text:string>>")
    sound = F.coalesce(F.forall(parts, lambda p: p.isNotNull()), F.lit(False))
    texts = F.filter(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), lambda t: _visible(t))
    return F.when(sound, F.array_join(texts, "\n")).otherwise(content)


SESSION = ["s1", "s2"]


def session_digest(c: Column) -> list[Column]:
    """128 bits of a session's identifier as two numbers; NULL stays NULL."""
    return [F.when(c.isNotNull(), F.xxhash64(c)).alias("s1"), F.when(c.isNotNull(), F.xxhash64(F.lit("second"), c)).alias("s2")]


def prepare_messages(records: DataFrame, quote: str | None = None) -> DataFrame:
    """One numbered row per ``uuid``: ``id, uuid, parent, quote, session, kind, side, at, has_text, arrival``.

    Of a message that was delivered again, the earliest delivery counts, and gaps in it are
    filled from the later ones. Records without ``uuid`` cannot be told apart and are left
    out. The numbers are given once and written with the rows.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    rows = records.select(
        blank("uuid").alias("uuid"),
        blank("parentuuid").alias("parent"),
        (blank(quote) if quote else F.lit(None).cast("string")).alias("quote"),
        blank("sessionid").alias("session"),
        F.lower(F.trim("type")).alias("kind"),
        F.coalesce("issidechain", F.lit(False)).alias("side"),
        F.col("timestamp").alias("at"),
        _visible(message_text(F.col("message.content"))).alias("has_text"),
        F.col("record_no").alias("arrival"),
    ).where("uuid is not null")
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c)
    one = rows.groupBy("uuid").agg(
        *[earliest(c) for c in ("parent", "quote", "session", "at")],
        F.min_by("kind", "arrival").alias("kind"),
        F.max("side").alias("side"),
        F.max("has_text").alias("has_text"),
        F.min("arrival").alias("arrival"),
    )
    return cut_lineage(one.withColumn("id", F.monotonically_increasing_id()))


#: What a link that leads nowhere points at.
NOWHERE = -1


def link_numbers(one: DataFrame, column: str) -> DataFrame:
    """``id, <column>``: the number of what each row of ``one`` links to, ``NOWHERE`` if it is no message or control record."""
    known = one.where("not (kind in ('user', 'assistant') and side)").select(F.col("uuid").alias("to"), F.col("id").alias("no"))
    own = one.where(F.col(column).isNotNull()).select("id", F.col(column).alias("to"))
    return own.join(known, "to", "left").select("id", F.coalesce("no", F.lit(NOWHERE)).alias(column))


def pass_controls(links: DataFrame, controls: DataFrame) -> DataFrame:
    """``links`` (``id``, ``parent``) that lead through control records lead to what those link to.

    A control record without a link ends the way: the row is left out, as it then has no
    link. A ring of control records leads nowhere either.
    """
    state = cut_lineage(controls.join(links, "id", "left").select("id", "parent"))
    n = state.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        step = state.select(F.col("id").alias("parent"), F.col("parent").alias("next"), F.lit(True).alias("through"))
        joined = state.where("parent is not null").join(step, "parent", "left")
        if not joined.where("through").limit(1).count():
            break
        moved = joined.select("id", F.when(F.col("through"), F.col("next")).otherwise(F.col("parent")).alias("parent"))
        old, state = state, cut_lineage(moved.unionByName(state.where("parent is null")))
        forget(old)
    ring = controls.select(F.col("id").alias("parent"))
    ends = state.where("parent is not null").join(ring, "parent", "left_anti")
    ends = ends.select(F.col("id").alias("parent"), F.col("parent").alias("end"))
    out = links.join(controls.select(F.col("id").alias("parent"), F.lit(True).alias("through")), "parent", "left").join(ends, "parent", "left")
    return out.where("through is null or end is not null").select("id", F.when(F.col("through"), F.col("end")).otherwise(F.col("parent")).alias("parent"))


def lost_sessions(one: DataFrame, links: DataFrame) -> DataFrame:
    """``id, found``: the session of each message that names none.

    The edges are the links of messages without a session. The session found is the smallest
    one in the component; a component without any gets its smallest uuid as identifier.
    """
    lost = one.where("kind in ('user', 'assistant') and not side and session is null").select("id")
    edges = lost.join(links, "id", "left").select(F.col("id").alias("u"), F.when(F.col("to") >= 0, F.col("to")).otherwise(F.col("id")).alias("v"))
    labels = cut_lineage(connected_components(edges))
    named = labels.join(one.select(F.col("id").alias("node"), "session", "uuid"), "node")
    per = named.groupBy("component").agg(F.min("session").alias("s"), F.min("uuid").alias("u"))
    return labels.join(per, "component").select(F.col("node").alias("id"), F.coalesce("s", "u").alias("found"))


def rebuild_conversations(records: DataFrame, quote: str | None = None) -> DataFrame:
    """Ordered listed messages of the sound conversations.

    ``sessionid, turn_no, speaker, uuid``. A conversation is dropped if its links are not
    one unbroken line, if it lists no message, does not begin with the user, or has a user
    message that no assistant message follows. If no message of a session links anywhere,
    time decides (then arrival); such a session is dropped if a message has no readable
    time. ``quote`` names a column with the uuid of a quoted message, a further link by
    which a message without a session finds one. NULLs in any column, repeated records,
    rings of links, empty tables and sessions of any length are handled; nothing is
    collected per session.
    """
    one = prepare_messages(records, quote)
    is_message = "kind in ('user', 'assistant') and not side"
    links = link_numbers(one, "parent")
    controls = one.where("coalesce(kind not in ('user', 'assistant'), true)").select("id")
    if controls.limit(1).count():
        links = pass_controls(cut_lineage(links), controls)
    links = cut_lineage(links)
    messages = one.where(is_message).select("id", "session", "arrival", (F.col("kind") == "user").alias("asks"), F.coalesce("has_text", F.lit(False)).alias("listed")).join(links, "id", "left")
    name = F.col("session")
    found = None
    if one.where(f"{is_message} and session is null").limit(1).count():
        ways = links.select("id", F.col("parent").alias("to"))
        if quote:
            ways = ways.unionByName(link_numbers(one, "quote").select("id", F.col("quote").alias("to")))
        found = cut_lineage(lost_sessions(one, ways))
        lost = messages.where("session is null").drop("session").join(found.withColumnRenamed("found", "session"), "id")
        messages = messages.where("session is not null").unionByName(lost)
    messages = cut_lineage(messages.select("id", "parent", "arrival", "asks", "listed", *session_digest(name)))

    children = messages.where("parent is not null").groupBy("parent", *SESSION).agg(F.count(F.lit(1)).alias("n"))
    homes = messages.select(F.col("id").alias("parent"), F.col("s1").alias("h1"), F.col("s2").alias("h2"))
    at_home = (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))
    wrong = children.join(homes, "parent", "left").where((F.col("n") > 1) | ~F.coalesce(at_home, F.lit(False)))
    faults = wrong.select(*SESSION, F.lit(1).alias("faults"), *[F.lit(0).cast("long").alias(c) for c in ("n", "linked")], F.lit(False).alias("listed"))
    sums = messages.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"), F.count("parent").alias("linked"), F.max("listed").alias("listed"))
    both = sums.withColumn("faults", F.lit(0)).unionByName(faults)
    fit = both.groupBy(*SESSION).agg(F.sum("faults").alias("faults"), F.sum("n").alias("n"), F.sum("linked").alias("linked"), F.max("listed").alias("listed"))
    # one message alone is no talk: a question without a reply, or a reply to nothing
    fit = cut_lineage(fit.where("faults = 0 and listed and n > 1 and (linked = 0 or linked = n - 1)").select(*SESSION, "n", "linked"))

    lined = messages.join(fit.where("linked > 0").select(*SESSION), SESSION, "left_semi")
    ranked = rank_lines(lined.select(*SESSION, "id", F.col("parent").alias("prev"), F.col("listed").cast("long").alias("w"), F.col("arrival").alias("hint")), tuple(SESSION))
    turns = ranked.select(*SESSION, "id", F.col("wpos").alias("turn_no"))
    seen = ranked.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("seen"))
    whole = fit.where("linked > 0").join(seen.withColumnRenamed("seen", "n"), [*SESSION, "n"], "left_semi").select(*SESSION)
    if fit.where("linked = 0").limit(1).count():
        loose = messages.join(fit.where("linked = 0").select(*SESSION), SESSION, "left_semi")
        loose = cut_lineage(normalise_timestamps(loose.join(one.select("id", "at"), "id"), ("at",)).select(*SESSION, "id", "arrival", "listed", "at_utc_us"))
        timed = blocked_row_number(loose.where("at_utc_us is not null and listed"), SESSION, [F.col("at_utc_us"), F.col("arrival"), F.col("id")], "turn_no")
        turns = turns.unionByName(timed.select(*SESSION, "id", F.col("turn_no").cast("long").alias("turn_no")))
        whole = whole.unionByName(fit.where("linked = 0").select(*SESSION).join(loose.where("at_utc_us is null").select(*SESSION), SESSION, "left_anti"))
    listed = cut_lineage(turns.join(messages.where("listed").select("id", "asks"), "id"))
    # a question must be followed by a reply: whoever speaks at k meets whoever speaks at k + 1
    meets = listed.select(*SESSION, "turn_no", F.col("asks").cast("int").alias("here"), F.lit(None).cast("int").alias("next"))
    meets = meets.unionByName(listed.select(*SESSION, F.col("turn_no") - 1, F.lit(None).cast("int"), F.col("asks").cast("int")).toDF(*SESSION, "turn_no", "here", "next"))
    pairs = meets.groupBy(*SESSION, "turn_no").agg(F.max("here").alias("here"), F.max("next").alias("next"))
    unanswered = (F.col("here") == 1) & ~F.col("next").eqNullSafe(0)
    talk = pairs.groupBy(*SESSION).agg(F.count_if(unanswered).alias("bad"), F.count_if((F.col("turn_no") == 1) & (F.col("here") == 1)).alias("opened"))
    good = whole.join(talk.where("bad = 0 and opened = 1"), SESSION, "left_semi")
    out = listed.join(good, SESSION, "left_semi").select("id", "turn_no", "asks")
    names = one.where(is_message).select("id", "uuid", "session")
    out = out.join(names, "id")
    if found is not None:
        out = out.join(found, "id", "left").withColumn("session", F.coalesce("session", "found"))
    speaker = F.when(F.col("asks"), "user").otherwise("assistant")
    return out.select(F.col("session").alias("sessionid"), F.col("turn_no").cast("int").alias("turn_no"), speaker.alias("speaker"), "uuid")
