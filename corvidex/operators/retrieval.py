"""Retrieval paths put together from the pools, fusion, re-ranking, routing, neighbours and packing.

Pools and fused lists are bounded by the options (at most ``pool`` rows per pool), so they
are written once and sent to the tasks; what they meet (documents, postings, turns) stays
distributed and is read in the columns needed. Texts are read for the survivors only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions import text as T
from corvidex.operators import evaluation as E
from corvidex.operators import evidence as EV
from corvidex.operators import filters as FL
from corvidex.operators import fts, fusion, passages, vectors
from corvidex.operators import scorers as S
from corvidex.plans import planner as P
from corvidex.session import cut_lineage

# fixed values: budgets and sizes of the retrieval paths
CONTEXT_BYTES, TICKET_BYTES, DIGEST_RESERVE, RECENT = 22_000, 12_000, 320, 12
# fixed values: a route needs so many of the first chat rows, and fewer query words covered than this
ROUTE_WINDOW, ROUTE_SHARE, ROUTE_COVERED = 10, 3, 0.8
# fixed values: order of worklog categories of a ticket
CATEGORY_ORDER = ("status", "blockers", "next-action", "delivery", "decisions", "summary", "findings")
_META_QUERY = re.compile(r"(?is)retriev|memory|snippet|worklog\s+comparison|stale")


@dataclass(frozen=True)
class Options:
    """Knobs of a search; values out of their bounds are an error."""

    limit: int = 30
    pool: int = fusion.POOL_LIMIT
    relax: str = "auto"
    rerank: str = "rrf"
    weight: int = 12
    depth: int = 30
    per_document: int = 3
    min_scored: int = 10
    neighbours: str = "adjacent"
    radius: int = 1
    route: bool = False
    ticket_select: str = "coverage"
    budget: int = CONTEXT_BYTES

    def __post_init__(self):
        bounds = ((self.limit, 1, 1000), (self.pool, 1, 1000), (self.radius, 0, 5), (self.weight, 1, 100), (self.depth, 1, 1000), (self.per_document, 1, 5), (self.budget, 1, 1 << 40))
        if any(not low <= x <= high for x, low, high in bounds):
            raise ValueError("an option is out of bounds")
        if self.rerank not in ("off", "rrf", "score", "cut") or self.neighbours not in ("off", "adjacent", "after"):
            raise ValueError("unknown mode")
        if self.relax not in ("off", "auto", "on") or self.ticket_select not in ("off", "coverage"):
            raise ValueError("unknown mode")


#: Option sets of the systems that an evaluation compares.
SYSTEMS = {"S0": Options(rerank="off", neighbours="off", relax="off"), "S1": Options(rerank="off"), "S2": Options(), "S5": Options(rerank="score"), "S6": Options(rerank="cut")}


# --- pools ---
def authority_rank() -> Column:
    return F.when(F.col("source") == "worklog:state", 0).when(F.col("source") == "worklog:chunks", 1).when(F.col("source") == "chat:turns", 2).otherwise(3)


def turn_columns(docs: DataFrame) -> DataFrame:
    """Adds ``ticket`` (facet), ``sequence`` and ``impact`` of a turn's path; other paths have NULL or ''."""
    f = FL.facet_columns()
    number = F.regexp_extract("file_name", r"^(?:turn|artifact)-0*(\d+)\.md$", 1).try_cast("long")
    return docs.withColumns({"ticket": f["ticket"], "impact": f["impact"], "sequence": F.coalesce(f["sequence"], number)})


def of_ticket(docs: DataFrame, ticket: str) -> DataFrame:
    """Documents with the ticket's facet in their path."""
    facet = "".join(c for c in ticket.lower() if c.isalnum())
    return docs.where(F.array_contains(F.split(F.lower("file_path"), "/"), facet))


def pool_exact(docs: DataFrame, ticket: str, n: int = fusion.POOL_LIMIT) -> DataFrame:
    """Documents of a ticket: authorities first, then the newest."""
    return fusion.ranked_pool(of_ticket(docs, ticket), "exact", [authority_rank(), F.col("doc_id").desc()], n, "doc_id")


def pool_recency(docs: DataFrame, n: int = fusion.POOL_LIMIT) -> DataFrame:
    return fusion.ranked_pool(docs.where("source = 'chat:turns'"), "recency", [F.col("doc_id").desc()], n, "doc_id")


def pool_authority(docs: DataFrame, n: int = fusion.POOL_LIMIT) -> DataFrame:
    return fusion.ranked_pool(docs.where(F.col("source").isin(*FL.AUTHORITY_ARCHIVES)), "authority", [authority_rank(), F.col("doc_id").desc()], n, "doc_id")


def high_impact() -> Column:
    return F.col("content").rlike(r'(?m)^impact: "?high"?\s*$')


def pool_impact(docs: DataFrame, n: int = fusion.POOL_LIMIT) -> DataFrame:
    """High-impact documents by their front matter; enriched from the document, not from search rows."""
    return fusion.ranked_pool(docs.where(high_impact()), "impact", [F.col("doc_id").desc()], n, "doc_id")


def pool_artifact(docs: DataFrame, n: int = fusion.POOL_LIMIT) -> DataFrame:
    return fusion.ranked_pool(docs.where("source = 'chat:artifacts'"), "artifact", [F.col("doc_id").desc()], n, "doc_id")


def pool_bm25(index: fts.Index, query: str, signal: str = "bm25", n: int = fusion.POOL_LIMIT) -> DataFrame:
    """Body hits of all databases by raw score; statistics are those of each database."""
    return fusion.ranked_pool(index.search(query), signal, [F.col("score"), F.col("origin_db"), F.col("doc_id")], n, "doc_id")


def pool_late(vecs: DataFrame, query: list[list[float]], n: int = fusion.POOL_LIMIT) -> DataFrame:
    hits = vectors.search(vecs, query, "doc_id", "vector", n)
    return fusion.ranked_pool(hits, "late", [F.col("score").desc(), F.col("doc_id")], n, "doc_id")


def lexical_pools(index: fts.Index, plan: P.QueryPlan, o: Options) -> DataFrame:
    """Strict hits and, where the options and their number ask for it, those of the relaxed form."""
    strict = cut_lineage(pool_bm25(index, P.normalize_query(plan.strict), n=o.pool))
    if o.relax == "off" or plan.explicit or not plan.relaxed or (o.relax == "auto" and strict.count() >= P.RELAX_BELOW):
        return strict
    return cut_lineage(strict.unionByName(pool_bm25(index, plan.relaxed, "bm25_relaxed", o.pool)))


def derived_pools(docs: DataFrame, lexical: DataFrame, o: Options) -> DataFrame:
    """Without a ticket the other pools are orders of the lexical hits: newest, authorities, high impact."""
    ids = F.broadcast(lexical.groupBy("stable_id").agg(F.min("rank").alias("found")))
    rows = turn_columns(docs.join(ids, docs.doc_id == ids.stable_id))
    newest = fusion.ranked_pool(rows, "recency", [F.coalesce("sequence", F.lit(0)).desc(), F.col("found"), F.col("doc_id")], o.pool, "doc_id")
    authorities = rows.where(F.col("source").isin(*FL.AUTHORITY_ARCHIVES))
    authority = fusion.ranked_pool(authorities, "authority", [authority_rank(), F.col("found"), F.col("doc_id")], o.pool, "doc_id")
    impact = fusion.ranked_pool(rows.where((F.col("source") == "chat:turns") & high_impact()), "impact", [F.coalesce("sequence", F.lit(0)).desc(), F.col("doc_id")], o.pool, "doc_id")
    return newest.unionByName(authority).unionByName(impact)


def ticket_pools(docs: DataFrame, ticket: str, o: Options, body: str) -> DataFrame:
    """With a ticket: its documents, its newest turns, its worklogs and its high-impact turns."""
    own = turn_columns(of_ticket(docs, ticket))
    turns = own.where("source = 'chat:turns'")
    newest = fusion.ranked_pool(turns, "recency", [F.coalesce("sequence", F.lit(0)).desc(), F.col("doc_id").desc()], o.pool, "doc_id")
    impact = turns.where((F.col("impact") == "high") & ~EV.is_retrieval_meta(F.col(body)))
    impact = fusion.ranked_pool(impact, "impact", [F.coalesce("sequence", F.lit(0)).desc(), F.col("doc_id").desc()], o.pool, "doc_id")
    return pool_exact(docs, ticket, o.pool).unionByName(newest).unionByName(pool_authority(own, o.pool)).unionByName(impact)


# --- stages on a fused list ---
def placed(fused: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their place (``pos``, from 1), written once."""
    top = fused.orderBy(*order).limit(limit)
    return cut_lineage(top.withColumn("pos", F.row_number().over(Window.orderBy(*order))))


def overlap_scores(docs: DataFrame, ids: DataFrame, words: list[str], body: str) -> DataFrame:
    """Best share of query words in a window of each candidate (no sections, no scorer)."""
    cand = docs.join(F.broadcast(ids.select(F.col("stable_id").alias("doc_id"))), "doc_id").select("doc_id", body)
    p = fusion.passages(cand, ["doc_id"], body)
    scored = p.select(F.col("doc_id").alias("stable_id"), fusion.overlap_score(T.tokens(F.col("passage")), words).alias("score"))
    return scored.groupBy("stable_id").agg(F.max("score").alias("score"))


def passage_scores(docs: DataFrame, head: DataFrame, query: str, words: list[str], scorer: S.Scorer, per_document: int, body: str) -> DataFrame:
    """``stable_id, score, passage``: the best scored passage of each candidate."""
    cand = docs.join(F.broadcast(head.select(F.col("stable_id").alias("doc_id"))), "doc_id")
    chosen = passages.best_passages(passages.structured_passages(cand, body), words, per_document)
    scored = chosen.withColumn("score", S.score_column(scorer, query, F.col("passage"))).where("score is not null")
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("score", "passage"), F.struct("score", -F.col("char_start"), "passage_id")).alias("b"))
    return best.select(F.col("doc_id").alias("stable_id"), "b.score", "b.passage")


def rerank_stage(docs: DataFrame, ranked: DataFrame, query: str, words: list[str], scorer: S.Scorer, o: Options, body: str) -> tuple[DataFrame, str | None]:
    """The list with model scores applied to its first ``depth`` rows, and why not if they are not.

    Degrades to the order it was given if the scorer is not available or if fewer than
    ``min_scored`` candidates (or all, if there are fewer) got a score. A ticket's capsule
    is pinned by the caller.
    """
    try:
        scorer.check()
    except S.ScorerUnavailable as x:
        return ranked, str(x)
    head = ranked.where(F.col("pos") <= o.depth)
    scores = cut_lineage(passage_scores(docs, head, query, words, scorer, o.per_document, body))
    if scores.count() < min(o.min_scored, head.count()) or not scores.limit(1).count():
        return ranked, "too few scored"
    out = fusion.rerank(ranked.drop("pos"), scores, o.rerank, float(o.weight))
    order = ([F.col("cut_rank").asc_nulls_last()] if o.rerank == "cut" else []) + fusion.fused_order()
    return placed(out.drop("passage"), order, 1 << 30), None


def dominant_ticket(docs: DataFrame, ranked: DataFrame, window: int = ROUTE_WINDOW) -> tuple[str | None, int]:
    """The ticket folder that holds most of the first chat rows, and how many (first seen wins)."""
    rows = ranked.select("pos", F.col("stable_id").alias("doc_id"))
    chat = turn_columns(docs.where("source = 'chat:turns'").join(F.broadcast(rows), "doc_id").select("pos", "file_path", "file_name")).orderBy("pos").limit(window)
    named = chat.where(~F.col("ticket").isin("", "noticket", "sha256", "utf8"))
    best = named.groupBy("ticket").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p")).orderBy(F.col("n").desc(), "p").first()
    return (best.ticket, best.n) if best else (None, 0)


def covered(docs: DataFrame, ranked: DataFrame, terms: str, body: str, window: int = ROUTE_WINDOW) -> float:
    """Share of the query's words that the first chat rows hold."""
    ids = ranked.select("pos", F.col("stable_id").alias("doc_id"))
    first = docs.where("source = 'chat:turns'").join(F.broadcast(ids), "doc_id").orderBy("pos").limit(window)
    return E.covered_share(first, P.query_words(terms, frozenset(T.ENGLISH_STOP_WORDS) | frozenset(T.POLISH_STOP_WORDS)), body).first().covered


def token_frequencies(docs: DataFrame, body: str = "text") -> DataFrame:
    """``token, df`` over all turns: a table to keep (see ``change_stamp``), not to make per search."""
    rows = docs.where("source = 'chat:turns'").select(F.explode(F.array_distinct(coverage_tokens(F.col(body)))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def coverage_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9][a-z0-9_#./-]{2,})"))


def coverage_choice(docs: DataFrame, ticket: str, frequencies: DataFrame, n_turns: int, count: int, body: str) -> DataFrame:
    """``doc_id, pick``: the turns of a ticket that together cover most, the newest 5,000 considered."""
    own = turn_columns(of_ticket(docs.where("source = 'chat:turns'"), ticket)).orderBy(F.coalesce("sequence", F.lit(0)).desc(), F.col("doc_id").desc()).limit(5000)
    rows = own.select(F.lit(0).alias("g"), F.col("doc_id").alias("id"), F.coalesce("sequence", F.lit(0)).alias("sequence"), coverage_tokens(F.col(body)).alias("tokens"))
    return E.greedy_coverage(rows, ["g"], frequencies, max(1, n_turns), count).select(F.col("id").alias("doc_id"), "pick")


def splice(ranked: DataFrame, chat: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen rows in the places of the list's chat rows, further ones behind, chat rows left over last.

    ``ranked``: ``stable_id, pos`` and others; ``chat``: ids of chat rows; ``chosen``: ``doc_id,
    pick``. All three are bounded by the options. Returns ``stable_id, pos, pool``.
    """
    marked = ranked.join(F.broadcast(chat.select(F.col("doc_id").alias("stable_id"), F.lit(True).alias("is_chat"))), "stable_id", "left")
    slots = marked.where("is_chat").withColumn("pick", F.row_number().over(Window.orderBy("pos"))).select("pick", F.col("pos").alias("slot"))
    end = F.lit(1 << 20)
    picked = chosen.join(slots, "pick", "left").select(F.col("doc_id").alias("stable_id"), F.coalesce("slot", end + F.col("pick")).alias("at"), F.lit("coverage").alias("pool"))
    others = marked.where("is_chat is null").select("stable_id", F.col("pos").alias("at"), F.lit("ranked").alias("pool"))
    left = marked.where("is_chat").join(F.broadcast(chosen.select(F.col("doc_id").alias("stable_id"))), "stable_id", "left_anti").select("stable_id", (2 * end + F.col("pos")).alias("at"), F.lit("ranked").alias("pool"))
    rows = others.unionByName(picked).unionByName(left)
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("at", "stable_id"))).drop("at")


def expand(docs: DataFrame, ranked: DataFrame, body: str, radius: int = 1, mode: str = "adjacent", allow_meta: bool = False) -> DataFrame:
    """The list with the turns around its turns: ``stable_id, pos, pool``.

    A turn reaches the turns of its ticket and database with numbers within ``radius``; the
    reach is listed and met by an equality join. Turns about retrieval neither reach nor are
    reached. Of several places of a document the first counts. ``adjacent`` puts neighbours
    behind their turn, ``after`` behind the list.
    """
    base = ranked.select("stable_id", "pos", F.lit("ranked").alias("pool"))
    if mode == "off" or radius < 1:
        return base
    turns = turn_columns(docs.where("source = 'chat:turns'")).where("sequence > 0").select("doc_id", "origin_db", "ticket", "sequence", "file_path", body)
    anchors = turns.join(F.broadcast(base.select(F.col("stable_id").alias("doc_id"), "pos")), "doc_id")
    if not allow_meta:
        anchors = anchors.where(~EV.is_retrieval_meta(F.col(body)))
    offsets = [i for i in range(-radius, radius + 1) if i]
    reach = anchors.select("origin_db", "ticket", "pos", F.explode(F.array(*[F.col("sequence") + i for i in offsets])).alias("sequence"))
    near = turns.join(F.broadcast(reach), ["origin_db", "ticket", "sequence"])
    if not allow_meta:
        near = near.where(~EV.is_retrieval_meta(F.col(body)))
    near = near.select(F.col("doc_id").alias("stable_id"), "pos", "sequence", "file_path")
    rows = base.select("stable_id", "pos", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("sequence"), F.lit("").alias("file_path"))
    rows = rows.unionByName(near.withColumn("kind", F.lit(1)))
    place = F.struct(*((["pos", "kind"]) if mode == "adjacent" else (["kind", "pos"])), "sequence", "file_path")
    one = rows.groupBy("stable_id").agg(F.min(place).alias("p"))
    first = one.select("stable_id", "p", F.when(F.col("p.kind") == 1, "neighbour").otherwise("ranked").alias("pool"))
    return first.withColumn("pos", F.row_number().over(Window.orderBy("p", "stable_id"))).select("stable_id", "pos", "pool")


def packed(items: DataFrame, docs: DataFrame, body: str, budget: int) -> DataFrame:
    """The first rows by ``pos`` that fit a byte budget, those that do not fit being passed over.

    Content is fetched for the rows of the list only. Hand-off noise is left out. Adds
    ``position`` and ``used_before``.
    """
    text = docs.select(F.col("doc_id").alias("stable_id"), F.octet_length(F.coalesce(body, F.lit(""))).alias("bytes"), T.is_handoff_noise(F.col(body)).alias("noise"))
    rows = text.join(F.broadcast(items), "stable_id").where("bytes > 0 and not noise").withColumn("g", F.lit(0))
    kept = fusion.pack_budget(rows, ["g"], [F.col("pos"), F.col("stable_id")], "bytes", budget).drop("g", "noise")
    return kept.withColumn("position", F.row_number().over(Window.orderBy("pos", "stable_id"))).withColumnRenamed("stable_id", "doc_id")


# --- the paths ---
@dataclass
class Found:
    """A ranked list (``stable_id, pos, pool, fused_score``), and how it came about."""

    rows: DataFrame
    form: str = "strict"
    degraded: str | None = None
    routed: str | None = None


def topic_list(docs: DataFrame, index: fts.Index, raw: str, options: Options | None = None, body: str = "text", scorer: S.Scorer | None = None, frequencies: DataFrame | None = None, late: DataFrame | None = None) -> Found:
    """Plan, pools, fusion, route or re-ranking or coverage, neighbours.

    ``frequencies`` (``token, df``) is needed where coverage may be asked for; ``late`` is a
    ready pool of vector hits.
    """
    o = options or Options()
    ticket, rest = P.split_ticket(raw)
    plan = P.plan_query(rest or raw)
    lexical = lexical_pools(index, plan, o)
    pools = lexical.unionByName(ticket_pools(docs, ticket, o, body) if ticket else derived_pools(docs, lexical, o))
    if late is not None:
        pools = pools.unionByName(late)
    ranked = placed(fusion.rrf(pools), fusion.fused_order(), max(2 * o.limit, o.depth))
    form = "relaxed" if lexical.where("signal = 'bm25_relaxed'").limit(1).count() else "explicit" if plan.explicit else "strict"
    found = Found(ranked, form)
    words = [P.ascii_fold(w) for w in plan.terms]
    generic = bool(ticket) and o.ticket_select != "off" and P.is_generic(plan.terms)
    cover = ticket if generic and o.ticket_select == "coverage" else None
    if o.route and not ticket and not plan.explicit:
        dominant, share = dominant_ticket(docs, ranked)
        if dominant and share >= ROUTE_SHARE and covered(docs, ranked, rest or raw, body) < ROUTE_COVERED:
            found.routed = cover = dominant
    if cover and frequencies is not None:
        chat = docs.where("source = 'chat:turns'").select("doc_id")
        n = chat.count()
        chosen = cut_lineage(coverage_choice(docs, cover, frequencies, n, max(2 * o.limit, o.limit), body))
        if chosen.limit(1).count():
            own = chat.join(F.broadcast(ranked.select(F.col("stable_id").alias("doc_id"))), "doc_id", "left_semi")
            found.rows = with_scores(splice(ranked, own, chosen), ranked)
            return found
    if o.rerank != "off" and not plan.explicit and not generic and not found.routed:
        ranked, found.degraded = rerank_stage(docs, ranked, rest or raw, words, scorer or S.OverlapScorer(), o, body)
    if ticket:
        ranked = pin_capsule(docs, ranked, ticket)
    allow_meta = bool(_META_QUERY.search(rest or ""))
    found.rows = with_scores(expand(docs, ranked, body, o.radius, o.neighbours, allow_meta), ranked)
    return found


def with_scores(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """A re-arranged list with the fused scores of the rows that have one."""
    return cut_lineage(rows.join(F.broadcast(ranked.select("stable_id", "fused_score")), "stable_id", "left"))


def pin_capsule(docs: DataFrame, ranked: DataFrame, ticket: str) -> DataFrame:
    """The state of the ticket itself comes first; the rest keeps its order."""
    facet = "".join(c for c in ticket.lower() if c.isalnum())
    state = docs.where((F.col("source") == "worklog:state") & (F.col("file_name") == f"{facet}.md")).select(F.col("doc_id").alias("stable_id"), F.lit(0).alias("first"))
    rows = ranked.join(state, "stable_id", "left")
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(F.coalesce("first", F.lit(1)), "pos"))).drop("first")


def topic_search(docs: DataFrame, index: fts.Index, raw: str, options: Options | None = None, body: str = "text", scorer: S.Scorer | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """``position, doc_id, pool, fused_score, used_before``: the list cut to what fits the byte budget."""
    o = options or Options()
    found = topic_list(docs, index, raw, o, body, scorer, frequencies)
    rows = packed(found.rows.where(F.col("pos") <= max(2 * o.limit, o.limit)), docs, body, o.budget).where(F.col("position") <= o.limit)
    return rows.select("position", "doc_id", "pool", F.round("fused_score", 9).alias("fused_score"), "used_before")


def ticket_candidates(docs: DataFrame, index: fts.Index, ticket: str, terms: str = "", body: str = "text", limit: int = 50) -> DataFrame:
    """``doc_id, pool, place, freshness``: state, newer evidence, authoritative, recent, semantic or fill.

    The state is stale if a later turn is evidence; then that evidence comes before the
    authoritative sections. Each document stands in the first pool that has it.
    """
    facet = "".join(c for c in ticket.lower() if c.isalnum())
    own = turn_columns(of_ticket(docs, ticket))
    indexed = F.unix_micros("indexed_at")
    state = docs.where((F.col("source") == "worklog:state") & ((F.col("file_name") == f"{facet}.md") | F.array_contains(T.tickets(F.col(body)), ticket.upper())))
    state = cut_lineage(state.select("doc_id", indexed.alias("latest_us")).orderBy(F.col("doc_id").desc()).limit(1))
    turns = own.where("source = 'chat:turns'").select("doc_id", "sequence", "impact", "file_path", indexed.alias("event_us"), F.lit("exact").alias("confidence"), F.col(body).alias("body"), F.lit(ticket).alias("ticket"))
    verdict = EV.classify(turns, state.withColumn("ticket", F.lit(ticket))).first()
    fresh = verdict.freshness if verdict else "undetermined"
    order = EV.evidence_order("confidence", "event_us", "sequence", "file_path")

    def pool(rows: DataFrame, name: str, at: int, n: int, by: list[Column]) -> DataFrame:
        top = rows.orderBy(*by).limit(n)
        return top.select("doc_id", F.lit(name).alias("pool"), F.lit(at).alias("pool_order"), F.row_number().over(Window.orderBy(*by)).alias("place"))

    category = F.lit(len(CATEGORY_ORDER))
    for i, c in reversed(list(enumerate(CATEGORY_ORDER))):
        category = F.when(F.contains("file_path", F.lit(f"/{c}/")), i).otherwise(category)
    chunks = docs.where((F.col("source") == "worklog:chunks") & (F.array_contains(F.split(F.lower("file_path"), "/"), facet) | F.array_contains(T.tickets(F.col(body)), ticket.upper())))
    chunks = chunks.withColumn("c", category).select("doc_id", "c", F.coalesce(F.col("content").contains('state: "current"'), F.lit(False)).alias("current"))
    by_category = [F.col("c"), F.col("current").desc(), F.col("doc_id").desc()]
    parts = [pool(state, "state", 0, 1, [F.col("doc_id").desc()])]
    if fresh == "stale":
        newer = turns.where(F.col("event_us") > verdict.authoritative_through).where(EV.names_ticket(F.col("body"), F.col("ticket")) & EV.is_material(F.col("body")) & ~EV.is_retrieval_meta(F.col("body")))
        parts.append(pool(newer, "newer-evidence", 1, 5, order))
    parts.append(pool(chunks, "authoritative", 2, 4, by_category))
    parts.append(pool(turns, "recent", 3, 5, order))
    if fresh != "stale":
        parts.append(pool(turns.where("impact = 'high'"), "impact", 4, 5, order))
    if terms.strip():
        plan = P.plan_query(terms)
        strict = cut_lineage(fts.best(index.search(f"file_path:{facet} AND ({P.normalize_query(terms)})"), 5).select("doc_id", "score"))
        parts.append(pool(strict, "semantic", 5, 5, [F.col("score"), F.col("doc_id")]))
        if plan.relaxed and not plan.explicit and strict.count() < P.RELAX_BELOW:
            parts.append(pool(index.search(f"file_path:{facet} AND ({plan.relaxed})"), "semantic", 6, 5, [F.col("score"), F.col("doc_id")]))
    else:
        parts += [pool(chunks, "authoritative", 5, 12, by_category), pool(turns, "recent", 6, 10, order)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    one = rows.groupBy("doc_id").agg(F.min(F.struct("pool_order", "place", "pool")).alias("p"))
    label = F.when(F.col("p.pool") == "newer-evidence", "newer-evidence").when((F.col("p.pool") == "state") & F.lit(fresh == "stale"), "stale").otherwise(F.lit(fresh))
    out = one.select("doc_id", F.col("p.pool").alias("pool"), F.row_number().over(Window.orderBy("p", "doc_id")).alias("place"), label.alias("freshness"))
    return cut_lineage(out.where(F.col("place") <= limit))


#: The signals that a ticket's pools stand for.
_SIGNALS = (("exact", ("state",)), ("bm25", ("semantic",)), ("recency", ("newer-evidence", "recent")), ("authority", ("state", "authoritative")), ("impact", ("newer-evidence", "impact")))


def ticket_result(docs: DataFrame, index: fts.Index, ticket: str, terms: str = "", limit: int = 20, body: str = "text") -> DataFrame:
    """``position, doc_id, pool, freshness, fused_score``: a ticket's pools, fused, with neighbours and labels."""
    found = ticket_candidates(docs, index, ticket, terms, body, max(limit * 5, fusion.POOL_LIMIT))
    signals = None
    for name, pools in _SIGNALS:
        own = found.where(F.col("pool").isin(*pools))
        rows = own.select(F.lit(name).alias("signal"), F.col("doc_id").alias("stable_id"), F.row_number().over(Window.orderBy("place")).alias("rank"))
        signals = rows if signals is None else signals.unionByName(rows)
    ranked = placed(fusion.rrf(signals), fusion.fused_order(), max(2 * limit, limit))
    rows = with_scores(expand(docs, ranked, body), ranked)
    labelled = rows.join(F.broadcast(found.select(F.col("doc_id").alias("stable_id"), F.col("pool").alias("own"), "freshness")), "stable_id", "left")
    out = labelled.where(F.col("pos") <= limit)
    return out.select(F.col("pos").alias("position"), F.col("stable_id").alias("doc_id"), F.coalesce("own", "pool").alias("pool"), "freshness", F.round("fused_score", 9).alias("fused_score"))


def ticket_context(docs: DataFrame, index: fts.Index, ticket: str, terms: str = "", budget: int = TICKET_BYTES, body: str = "text") -> DataFrame:
    """``position, doc_id, pool, used_before``: the ticket's result packed into a byte budget."""
    rows = ticket_result(docs, index, ticket, terms, 20, body).select(F.col("doc_id").alias("stable_id"), F.col("position").alias("pos"), "pool")
    return packed(cut_lineage(rows), docs, body, budget).select("position", "doc_id", "pool", "used_before")


def resume(docs: DataFrame, budget: int = CONTEXT_BYTES, body: str = "text", ticket: str | None = None) -> DataFrame:
    """``position, doc_id, pool, used_before``: recent turns, then what belongs to the ticket most of them have.

    A ticket is dominant if at least half of the recent turns have it; its documents,
    authorities and high-impact turns join the newest artifacts, are fused, and their
    neighbours added.
    """
    recent = FL.recent_turns(docs, RECENT).select("doc_id", "sequence", "origin_db", "file_path")
    order = [F.col("sequence").desc_nulls_last(), F.col("origin_db"), F.col("file_path"), F.col("doc_id").desc()]
    recent = cut_lineage(recent.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select(F.col("doc_id").alias("stable_id"), "pos"))
    if ticket is None:
        name, n = dominant_ticket(docs, recent, RECENT)
        ticket = name if name and n >= -(-recent.count() // 2) else None
    pools = pool_artifact(docs, 10)
    if ticket:
        own = turn_columns(of_ticket(docs, ticket))
        impact = own.where((F.col("source") == "chat:turns") & (F.col("impact") == "high") & ~EV.is_retrieval_meta(F.col(body)))
        impact = fusion.ranked_pool(impact, "impact", [F.coalesce("sequence", F.lit(0)).desc(), F.col("doc_id").desc()], 10, "doc_id")
        pools = pools.unionByName(pool_exact(docs, ticket, 10)).unionByName(pool_authority(own, 10)).unionByName(impact)
    fused = placed(fusion.rrf(pools), fusion.fused_order(), 30)
    rest = expand(docs, fused, body).join(F.broadcast(recent.select("stable_id")), "stable_id", "left_anti")
    items = recent.withColumn("pool", F.lit("recent")).unionByName(rest.select("stable_id", (F.col("pos") + RECENT).alias("pos"), "pool"))
    return packed(cut_lineage(items), docs, body, budget).select("position", "doc_id", "pool", "used_before")


def digest(items: DataFrame, budget: int = CONTEXT_BYTES, reserve: int = DIGEST_RESERVE) -> DataFrame:
    """Three tiers of items, one per turn hash, packed into the budget less a reserve.

    ``items``: ``tier, position, turn_hash, bytes``; the first tier that has a hash keeps it.
    """
    one = fusion.merge_pools(items.withColumn("id", F.coalesce("turn_hash", F.concat_ws("-", "tier", "position"))), "tier", "position", "id")
    return fusion.pack_budget(one.withColumn("g", F.lit(0)), ["g"], [F.col("tier"), F.col("position")], "bytes", budget - reserve).drop("g", "id")


def capsule(chunks: DataFrame, group: str, category: str, order: list[str], wanted: tuple[str, ...]) -> DataFrame:
    """The latest chunk of each wanted category per group, in the order of ``wanted``."""
    rows = chunks.where(F.col(category).isin(*wanted))
    newest = rows.groupBy(group, category).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")
    place = F.lit(0)
    for i, w in enumerate(wanted):
        place = F.when(F.col(category) == w, i).otherwise(place)
    return newest.withColumn("place", place)
