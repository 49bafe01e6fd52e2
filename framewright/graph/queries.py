"""Grounding queries from graphs: generation, de-duplication, limits, track expansion, polishing, solver comparison.

A video is one row and its queries come from that row alone, so generation is
a narrow map. The synonym maps are two small tables of distinct phrases; they
are collected only up to a stated size.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright import schemas
from framewright.graph import engine, solve, tables
from framewright.graph.templates import CATALOGUE, LABELS
from framewright.operators import spans
from framewright.operators.records import map_records
from framewright.session import settle, shuffle_partitions

#: Phrases that a synonym map may hold; vocabularies of predicates and attributes are far smaller.
MOST_SYNONYMS = 2_000_000


def _as_map(df: DataFrame) -> dict[str, str]:
    rows = df.limit(MOST_SYNONYMS + 1).collect()
    if len(rows) > MOST_SYNONYMS:
        raise ValueError(f"more than {MOST_SYNONYMS} synonyms: clean the phrases first")
    return {r.value: r.representative for r in rows}


def generate(graphs: DataFrame, cfg: engine.Settings = engine.Settings(), synonyms: bool = True) -> DataFrame:
    """Query records of all graphs, in the order they were picked (query_id holds the number)."""
    rel, attr = map(_as_map, tables.synonyms(graphs)) if synonyms else ({}, {})
    shared = graphs.sparkSession.sparkContext.broadcast((rel, attr))

    def one(g: dict):
        boxes = boxes_of(g)
        for n in engine.generate(g, *shared.value, cfg):
            if r := record(g, n, boxes):
                yield r

    return map_records(_dealt(graphs), one, schemas.RECORD, batch=1)


def _dealt(graphs: DataFrame) -> DataFrame:
    """Graphs dealt out evenly: they are few, and each is much work."""
    return graphs.repartition(max(shuffle_partitions(graphs.sparkSession), 4 * graphs.sparkSession.sparkContext.defaultParallelism))


def boxes_of(g: dict) -> dict[str, dict]:
    return {str(o["node_id"]).strip(): o.get("bboxes") or {} for o in g.get("object_nodes") or [] if o.get("node_id")}


def record(g: dict, n: dict, boxes: dict[str, dict] | None = None) -> dict | None:
    """The node with its members' boxes; members without a box in their span go, and the others are numbered anew."""
    boxes = boxes_of(g) if boxes is None else boxes
    members = []
    for name, (s, e) in n["members"]:
        own = {int(k): v for k, v in boxes.get(name, {}).items() if k.strip().isdigit() and s <= int(k) <= e}
        if own:
            members.append({"object_id": name, "start_frame": s, "end_frame": e, "target_index": len(members) + 1, "boxes": {str(k): own[k] for k in sorted(own)}})
    if not members:
        return None
    return {k: g.get(k) for k in ("video_path", "video_width", "video_height")} | {k: v for k, v in n.items() if k != "members"} | {"llm_polished": False, "target_arity": len(members), "target_members": members, "per_target_queries": {}}


def _picked(c: Column) -> Column:
    """The number in the query's id."""
    return F.regexp_extract(c, r"^[^_]*_([0-9]+)_", 1).try_cast("int")


def level(c: Column) -> Column:
    """The difficulty label's place; an unknown one counts as medium."""
    out = F.lit(2)
    for i, name in enumerate(LABELS):
        out = F.when(c == name, i).otherwise(out)
    return out


def dedupe(records: DataFrame) -> DataFrame:
    """The first query of each set of (object, start, end) in a video."""
    sig = F.transform("target_members", lambda m: F.concat_ws("@", m["object_id"], m["start_frame"].cast("string"), m["end_frame"].cast("string")))
    return spans.first_by_signature(records, ["video_path"], sig, [_picked(F.col("query_id")), "query_id"])


def limit(records: DataFrame, most: int | None = None, per_label: int | None = None) -> DataFrame:
    """At most so many queries of a video and of a label in it: one of each label first."""
    if most is None and per_label is None:
        return records
    return spans.limit_round_robin(records, ["video_path"], level(F.col("difficulty_bucket")), ["target_arity", "D", "query_id"], most, per_label).drop("__rank")


def expand_tracks(records: DataFrame, graphs: DataFrame) -> DataFrame:
    """Members none of whose clues is evidence in time get their whole track.

    A record meets the tracks of its own members, not all of its video.
    """
    o = graphs.select("video_path", F.posexplode("object_nodes").alias("pos", "o")).select("video_path", "pos", F.trim("o.node_id").alias("id"), F.struct(F.col("o.start_frame").alias("s"), F.col("o.end_frame").alias("e"), F.coalesce("o.bboxes", F.create_map().cast(schemas.BOXES)).alias("b")).alias("t")).where("id <> ''")
    wanted = records.select("video_path", "query_id", F.explode("target_members.object_id").alias("id")).distinct()
    last = o.join(wanted.select("video_path", "id").distinct(), ["video_path", "id"], "left_semi").groupBy("video_path", "id").agg(F.max_by("t", "pos").alias("t"))
    tracks = wanted.join(last, ["video_path", "id"]).groupBy("video_path", "query_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "t"))).alias("__t"))
    names = records.columns

    def one(r: dict):
        known = r["__t"] or {}
        told = {c["target_index"]: c for c in (r["clues"] or {}).get("per_target") or []}
        for m in r["target_members"] or []:
            c, t = told.get(m["target_index"]), known.get(m["object_id"])
            if t and not any(x["is_temporal_evidence"] for x in (c or {}).get("clues") or []):
                m |= {"start_frame": t["s"], "end_frame": t["e"], "boxes": t["b"]}
                if c:
                    c |= {"start_frame": t["s"], "end_frame": t["e"]}
        yield r

    return map_records(records.join(tracks, ["video_path", "query_id"], "left"), one, records.schema).select(*names)


def run(graphs: DataFrame, cfg: engine.Settings = engine.Settings(), most: int | None = None, per_label: int | None = None, expand: bool = True) -> DataFrame:
    """All steps from graphs to final records."""
    graphs = settle(graphs)  # synonyms, generation and tracks read them
    out = settle(limit(dedupe(generate(graphs, cfg)), most, per_label))
    return expand_tracks(out, graphs) if expand else out


# ---- polishing --------------------------------------------------------------------------------------

#: The order in which clues are listed, and what each kind is called.
CLUE_ORDER = {"cls": "class", "app": "appearance", "act": "action", "seq": "sequence", "spa": "spatial relation", "int": "interaction", "env": "environment"}
REQUEST = """Write one natural question that singles out the targets below in a video, using only the clues.
Answer with JSON: {{"query": "...", "target_queries": {{"target 1": "..."}}}}

Targets:
{targets}

Clues:
{clues}"""


def polish_prompt(r: dict) -> str:
    """Targets with their classes and clues by kind; clues that all targets share are listed with each."""
    targets, lines = [], []
    for t in r["clues"]["per_target"]:
        targets.append(f"- target {t['target_index']}: {engine.squeeze(t['class']) or 'object'}")
        lines.append(f"  target {t['target_index']}:")
        said = False
        for kind, name in CLUE_ORDER.items():
            texts = list(dict.fromkeys(engine.squeeze(c["text"]) for c in [*t["clues"], *(r["clues"].get("shared") or [])] if c["type"] == kind))
            texts = [x for x in (_bare(x) for x in texts) if x]
            if texts:
                lines.append(f"    - {name}: {', '.join(texts)}")
                said = True
        if not said:
            lines.append("    - none")
    return REQUEST.format(targets="\n".join(targets) or "- target 1: object", clues="\n".join(lines))


def _bare(t: str) -> str:
    for p in ("that is ", "that ", "the "):
        if t.lower().startswith(p):
            t = engine.squeeze(t[len(p) :])
    return t


def polished(response: str | None) -> tuple[str, dict[str, str]] | None:
    """(query, text by target) of a valid answer: a JSON object with a query and at least one target's text."""
    text = response or ""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    try:
        got = json.loads(fenced[1] if fenced else text)
    except ValueError:
        return None
    if not isinstance(got, dict) or not isinstance(got.get("query"), str) or not isinstance(got.get("target_queries"), dict):
        return None
    each = {engine.squeeze(k): engine.squeeze(v).rstrip(".").strip() for k, v in got["target_queries"].items()}
    each = {k: v for k, v in each.items() if k and v}
    query = engine.squeeze(got["query"])
    return (query, each) if query and each else None


def polish(records: DataFrame, ask: Callable[[str], str | None], tries: int = 5) -> DataFrame:
    """Records with the text that `ask` (a model client made on the executor) writes; those it can't polish go."""

    def one(r: dict):
        prompt = polish_prompt(r)
        for _ in range(tries):
            if got := polished(ask(prompt)):
                yield r | {"query": got[0], "per_target_queries": got[1], "llm_polished": True}
                return

    return map_records(records, one, records.schema)


# ---- comparison of solvers ----------------------------------------------------------------------------

RESULT = "video_path string, candidate_id string, template string, solver string, feasible boolean, proven boolean, objective int, time_sec double"


def solver_cases(graphs: DataFrame, cfg: engine.Settings = engine.Settings(), solvers: tuple[str, ...] = ("exact", "ilp", "greedy", "random")) -> DataFrame:
    """(video, candidate, template, solver, feasible, proven, objective, time_sec) over all templates and candidates of their labels."""

    def one(g: dict):
        single, multi = engine.prepared(g, None, None, cfg)
        for t in CATALOGUE:
            pool = single if t.arity[1] == 1 else multi
            for c in pool:
                if t.arity[0] <= c.arity <= t.arity[1] and c.label in t.labels():
                    # a rival with the very facts of c leaves no solver anything to find
                    p = None if pool.twin(c, t, cfg) else engine.problem(c, pool, c.clues(cfg.chain_length), t, cfg)
                    for name in solvers:
                        began = time.perf_counter()
                        got = solve.SOLVERS[name](p) if p else None
                        yield {"video_path": g["video_path"], "candidate_id": c.id, "template": t.name, "solver": name, "feasible": got is not None, "proven": got is not None and got["status"] == "OPTIMAL", "objective": got and got["objective"], "time_sec": time.perf_counter() - began}

    return map_records(_dealt(graphs), one, RESULT, batch=1)


def solver_summary(cases: DataFrame, case: list[str], by: list[str] | None = None) -> DataFrame:
    """Success, optimality, gap, strict wins, ratios and times of each solver, overall or by more columns.

    The best known objective of a case is the least of all solvers; p95 is the
    element at int(0.95 n) - 1 of the sorted times. proven_rate, where cases say
    it, is the share of answers that were proven within the nodes of a search.
    """
    w = Window.partitionBy(*case)
    best = F.min("objective").over(w)
    firsts = F.sum((F.col("objective") == F.col("__best")).cast("int")).over(w)
    d = cases.withColumn("__best", best).withColumn("__ties", firsts)
    ratio = F.when(F.col("feasible") & (F.col("__best") > 0), F.col("objective") / F.col("__best"))
    t = F.sort_array(F.collect_list("time_sec"))
    n = F.count("*")
    out = d.groupBy(*(by or []), "solver").agg(
        n.alias("n_cases"),
        *([(F.sum(F.col("proven").cast("int")) / F.nullif(F.sum(F.col("feasible").cast("int")), F.lit(0))).alias("proven_rate")] if "proven" in cases.columns else []),
        F.avg(F.col("feasible").cast("double")).alias("success_rate"),
        (F.sum((ratio == 1).cast("int")) / F.nullif(F.sum(F.col("feasible").cast("int")), F.lit(0))).alias("optimality_rate"),
        F.avg(ratio - 1).alias("mean_opt_gap"),
        (F.sum((F.col("feasible") & (F.col("objective") == F.col("__best")) & (F.col("__ties") == 1)).cast("int")) / n).alias("win_rate"),
        F.avg(ratio).alias("approx_ratio_mean"),
        F.max(ratio).alias("approx_ratio_max"),
        F.avg("time_sec").alias("mean_time_sec"),
        t.alias("__t"),
    )
    at = F.greatest(F.lit(0), F.floor(0.95 * F.size("__t")).cast("int") - 1)
    return out.withColumn("p95_time_sec", F.element_at("__t", at + 1)).drop("__t")
