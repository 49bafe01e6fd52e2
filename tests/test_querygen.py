import itertools

import pytest
from graphs import random_graph, walkers

from framewright import schemas
from framewright.graph import engine, queries, solve, tables
from framewright.graph.templates import CATALOGUE, label_of
from framewright.plans import q_graphs, registry



def problems(seeds):
    cfg = engine.Settings()
    for s in seeds:
        single, multi = engine.prepared(random_graph(s, 4), None, None, cfg)
        for t in CATALOGUE:
            pool = single if t.arity[1] == 1 else multi
            for c in pool[:12]:
                if t.arity[0] <= c.arity <= t.arity[1]:
                    yield engine.problem(c, pool, c.clues(4)[:11], t, cfg)


def test_exact_is_the_smallest_and_first():
    solved = 0
    for p in problems(range(2)):
        want = next((list(s) for k in range(max(1, p.template.k[0]), p.template.k[1] + 1) for s in itertools.combinations(range(len(p.kinds)), k) if p.feasible(s)), None)
        got = solve.exact(p)
        assert (got and got["selected_indices"]) == want
        for other in (solve.greedy(p), solve.at_random(p, 50)):
            if other:
                assert want and p.feasible(other["selected_indices"]) and other["objective"] >= len(want)
        solved += want is not None
    assert solved > 20


def test_integer_program_finds_the_least_number():
    solved = 0
    for p in problems(range(2)):
        want, got = solve.exact(p), solve.integer_program(p)
        assert (got and got["objective"]) == (want and want["objective"]) and (got is None or got["status"] == "OPTIMAL" and p.feasible(got["selected_indices"]))
        solved += got is not None
    assert solved > 20
    for p in problems([3]):
        if solve.greedy(p):  # out of nodes it says so
            assert solve.integer_program(p, nodes=0)["status"] == "FEASIBLE"
            break


def test_labels():
    assert [label_of(x) for x in (0.19999, 0.2, 0.6, 0.8, 1.0)] == ["very_easy", "easy", "hard", "very_hard", "very_hard"]


def test_shares():
    class C:
        length, share = 1, ""

        def __init__(self, d):
            self.d = d

    for n, want in ((10, (3, 5, 2)), (7, (2, 3, 2)), (1, (0, 1, 0)), (3, (1, 1, 1))):
        cs = [C(i) for i in range(n)]
        engine.share_out(cs)
        assert tuple(sum(c.share == x for c in cs) for x in ("easy", "medium", "hard")) == want


def test_chains_go_forward_and_stop_at_the_cap():
    e = [(0, 4, "a"), (2, 3, "b"), (2, 9, "a"), (5, 6, "c")]
    got = engine.chains(e, 3, 128)
    assert ("a", "b") in got and ("a", "b", "c") in got and ("b", "a") not in got and ("a", "a") not in got
    assert len(engine.chains([(i, i, str(i)) for i in range(20)], 4, 128)) == 128


def test_d_s_and_d_t():
    g = {"video_path": "v", "object_nodes": [{"node_id": "a_0", "object_class": "cat", "start_frame": 0, "end_frame": 9}, {"node_id": "b_1", "object_class": "cat", "start_frame": 0, "end_frame": 4}]}
    single, _ = engine.prepared(g, None, None, engine.Settings(max_arity=1))
    a, b = single
    assert a.d_t == 0 and a.d_s == pytest.approx(0.25 / 1.25) and b.d_s == a.d_s


def test_records_of_all_videos(spark):
    graphs = [walkers()] + [random_graph(s) for s in range(10, 16)]
    df = spark.createDataFrame(graphs, schemas.GRAPH)
    got = queries.run(df).collect()
    assert len(got) > 10 and len({r.video_path for r in got}) == 7
    for r in got:
        frames = sorted(int(f) for m in r.target_members for f in m.boxes)
        assert r.query and r.target_arity == len(r.target_members) and frames
        assert all(m.start_frame <= int(f) <= m.end_frame for m in r.target_members for f in m.boxes)
        for m, c in zip(r.target_members, r.clues.per_target):
            if not any(x.is_temporal_evidence for x in c.clues):
                o = next(o for g in graphs if g["video_path"] == r.video_path for o in g["object_nodes"] if o["node_id"] == m.object_id)
                assert (m.start_frame, m.end_frame) == (o["start_frame"], o["end_frame"])
    few = queries.run(df, most=2).groupBy("video_path").count().collect()
    assert all(r["count"] <= 2 for r in few)
    assert queries.run(df.limit(0)).count() == 0


def test_polish(spark):
    df = queries.generate(spark.createDataFrame([walkers()], schemas.GRAPH))
    good = queries.polish(df, lambda p: '```json\n{"query": " who  sits ", "target_queries": {"target 1": "the one."}}\n```' if "target 1" in p else None)
    r = good.collect()
    assert r and all(x.query == "who sits" and x.per_target_queries == {"target 1": "the one"} and x.llm_polished for x in r)
    assert queries.polish(df, lambda p: "no").count() == 0


def test_solver_summary(spark):
    df = spark.createDataFrame([(1, "exact", True, 2, 0.1), (1, "greedy", True, 3, 0.2), (2, "exact", True, 2, 0.3), (2, "greedy", True, 2, 0.1), (3, "exact", False, None, 0.5), (3, "greedy", False, None, 0.1)], "c int, solver string, feasible boolean, objective int, time_sec double")
    got = {r.solver: r for r in queries.solver_summary(df, ["c"]).collect()}
    assert got["exact"].win_rate == pytest.approx(1 / 3) and got["greedy"].mean_opt_gap == pytest.approx(0.25) and got["greedy"].approx_ratio_max == 1.5
    assert got["exact"].optimality_rate == 1 and got["exact"].success_rate == pytest.approx(2 / 3) and got["exact"].p95_time_sec == 0.3
    cases = queries.solver_cases(spark.createDataFrame([walkers()], schemas.GRAPH), solvers=("exact", "ilp", "greedy"))
    assert cases.count() > 0
    rates = {r.solver: r.proven_rate for r in queries.solver_summary(cases, ["video_path", "candidate_id", "template"]).collect()}
    assert set(rates) == {"exact", "ilp", "greedy"} and rates["ilp"] in (1.0, None) and rates["greedy"] in (0.0, None)


def test_tables(spark):
    df = spark.createDataFrame([walkers()], schemas.GRAPH)
    assert [(r.label, r.s, r.e, r.targets) for r in tables.actions(df).orderBy("s").collect()] == [("walk", 0, 4, []), ("sit", 5, 9, ["dog_1"])]
    assert [(r.predicate, r.s, r.e, r.ref_class) for r in tables.relations(df).orderBy("s").collect()] == [("left of", 2, 4, "dog"), ("left of", 5, 7, "dog")]
    o = {r.object_id: r for r in tables.objects(df).collect()}
    assert (o["dog_1"].s, o["dog_1"].e, o["dog_1"].frames) == (2, 7, [2, 7])
    m = tables.member_tags(spark.createDataFrame([("v1.mp4", 3, 5), ("v1.mp4", 20, 30)], "video_path string, s long, e long"), tables.shots(df))
    assert sorted((r.s, r.tags) for r in m.collect()) == [(3, ["clip_0"]), (20, [])]
    assert tables.pair_infos(df, 1).count() == 0 and tables.visible_ids(df).count() == 4
    assert tables.boxes(df).count() == 4


def test_queries_of_graphs_have_no_limit(spark, monkeypatch):
    """A video of more than 20 target sets: all of them are asked for and exported."""
    df = spark.createDataFrame([random_graph(2, 8)], schemas.GRAPH)
    every = queries.dedupe(queries.generate(df)).select("query_id").collect()
    monkeypatch.setattr(q_graphs, "few_graphs", lambda *_: df)
    asked = registry.queries()["grounding_queries"](spark, "").collect()
    told = registry.queries()["training_records"](spark, "").collect()
    assert len(every) > 20
    assert sorted(r.query_id for r in asked) == sorted(r.query_id for r in every) == sorted(r.queryid for r in told)


def test_rivals_alike_are_one_with_a_weight():
    """A graph of many equal objects: work goes with what differs, figures are those of all pairs."""
    g = random_graph(3, 4)
    for k in range(40):
        o = dict(g["object_nodes"][0], node_id=f"copy_{k}", object_class="cat")
        g["object_nodes"].append(o)
    cfg = engine.Settings()
    single, _ = engine.prepared(g, None, None, cfg)
    like = lambda a, b: (len(a.lasting & b.lasting) / len(a.lasting | b.lasting) * engine.tiou(a.hull, b.hull)) ** 2
    for c in single:
        mass = sum(like(c, r) for r in single if r.names != c.names)
        assert c.d_s == pytest.approx(mass / (1 + mass), abs=1e-12)
    for t in (CATALOGUE[0], CATALOGUE[2]):
        for c in single:
            clues = c.clues(cfg.chain_length)
            rows = [r.profile for r in single if r is not c and (t.unique_in_time or r.names != c.names)]
            p = engine.problem(c, single, clues, t, cfg)
            plain = solve.Problem(t, 1, p.kinds, p.slots, p.chains, [sum(1 << i for i, r in enumerate(rows) if x.fact not in r) for x in clues], len(rows))
            assert p.rivals <= len(single.at) < len(single) and p.count(p.full) == len(rows)
            assert [p.count(x) for x in p.cover] == [x.bit_count() for x in plain.cover]
            for solver in (solve.exact, solve.greedy):
                assert solver(p) == solver(plain) and (solver(p) is None or not single.twin(c, t, cfg))
