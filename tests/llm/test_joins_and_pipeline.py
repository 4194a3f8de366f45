import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelake.llm import chat_tools, decontaminate, license_scan, mixing, ngram_join, registry, tokens
from changelake.llm.scratch import Scratch
from tests.compare import oracle, rows

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, name, data=DATA):
    assert rows(registry.queries()[name](spark, data).toPandas()) == rows(oracle(registry.oracle_sql()[name], data))


# --- 3 ---------------------------------------------------------------------------------------

CALLS = "conv_id long, call_id string, seq long, name string, arguments string"
RESULTS = "conv_id long, call_id string, seq long, content string"
WAITS = "conv_id long, call_id string, `on` string"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False), "note": ("string", False)}, "now": {}}


def linked(spark, calls, results, waits=()):
    frames = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(list(waits), WAITS)
    return {(r["conv_id"], r["call_id"]): r for r in chat_tools.link(frames[0].withColumn("level", F.lit("clash")), frames[1], frames[2], SCHEMAS).collect()}


def test_links_validation_and_canonical_json(spark):
    got = linked(
        spark,
        [(1, "x", 1, "add", '{ "b": 2.50, "a": 1 }'), (1, "y", 2, "add", '{"b":"no","z":1}'), (1, "y", 9, "now", "{}"), (1, "q\"", 3, "now", "{}"), (2, "x", 1, "now", None), (2, "w", 1, "now", "[1]"), (2, "u", 1, "fly", "{}"), (None, "x", 1, "now", "{}"), (2, None, 1, "now", "{}")],
        [(1, "x", 5, "line\n\"two\" é"), (1, "gone", 6, "r"), (2, "x", 2, None), (None, "x", 1, "r")],
    )
    assert set(got) == {(1, "x"), (1, "y"), (1, 'q"'), (1, "gone"), (2, "x"), (2, "w"), (2, "u")}
    assert got[1, "x"]["message"] == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","result":"line\\n\\"two\\" é"}' and got[1, "x"]["valid"] and got[1, "x"]["status"] == "linked"
    assert got[1, "y"]["errors"] == "missing a; b is not number; unknown z" and got[1, "y"]["status"] == "open" and got[1, "y"]["seq"] == 2
    assert got[1, 'q"']["message"] == '{"arguments":{},"id":"q\\"","name":"now","result":null}'
    assert got[1, "gone"]["status"] == "orphan" and not got[1, "gone"]["valid"] and got[1, "gone"]["level"] is None
    assert not got[2, "x"]["valid"] and not got[2, "w"]["valid"] and got[2, "u"]["errors"] == "unknown tool"
    assert linked(spark, [], []) == {}


def test_turns_without_number_or_role_as_in_the_oracle(spark, tmp_path):
    from pathlib import Path

    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "user", "c"), (1, None, "user", "d"), (1, None, "assistant", "e"), (1, 2, None, "f"), (1, 3, "user", None), (None, 1, "user", "g"), (2, None, "user", "h")]
    spark.createDataFrame(turns, spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").schema).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    for table in Path(DATA).glob("*.parquet"):
        if table.name != "conversations.parquet":
            (tmp_path / table.name).symlink_to(table)
    got = rows(chat_tools.op3_chat_tools(spark, str(tmp_path)).toPandas())
    assert got == rows(oracle(chat_tools.ORACLES["op3_chat_tools"], str(tmp_path))) and len(got[1]) == 2


def test_levels_of_chains_graphs_and_cycles(spark):
    calls = [(1, str(i), i, "now", "{}") for i in range(20)] + [(2, c, 0, "now", "{}") for c in "abc"]
    chain = [(1, str(i), str(i + 1)) for i in range(19)] + [(2, "a", "b"), (2, "b", "a"), (2, "c", "a"), (1, "19", "nobody")]
    got = linked(spark, calls, [], chain)
    assert all(got[1, str(i)]["level"] == 19 - i for i in range(20)) and all(got[2, c]["level"] is None for c in "abc")
    got = linked(spark, calls[:6] + calls[20:], [], [(1, "1", "0"), (1, "2", "1"), (1, "2", "0"), (1, "3", "0"), (1, "4", "2"), (1, "4", "3"), (2, "a", "b"), (2, "b", "a"), (2, "c", "a")])
    assert [got[1, str(i)]["level"] for i in range(6)] == [0, 1, 2, 1, 3, 0] and got[2, "c"]["level"] is None


def test_a_fork_costs_no_rounds_for_long_chains(spark, monkeypatch):
    """A forked conversation beside a chain of 10,000 calls: rounds are logarithmic in the chain."""
    n, saves = 10_000, []
    calls = [(1, str(i), i, "now", "{}") for i in range(n)] + [(2, c, k, "now", "{}") for k, c in enumerate("abcdefgh")]
    waits = [(1, str(i), str(i - 1)) for i in range(1, n)] + [(2, "b", "a"), (2, "c", "b"), (2, "d", "c"), (2, "d", "a"), (2, "e", "d"), (2, "f", "e"), (2, "f", "b"), (2, "g", "f"), (2, "g", "h"), (2, "h", "g")]
    frames = spark.createDataFrame(calls, CALLS), spark.createDataFrame(waits, WAITS)
    real = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df: saves.append(1) or real(self, df))
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in chat_tools.levels(*frames, Scratch(spark)).collect()}
    assert all(got[1, str(i)] == i for i in range(n)) and [got[2, c] for c in "abcdefgh"] == [0, 1, 2, 3, 4, 5, None, None]
    assert len(saves) < 50


def test_levels_of_random_graphs(spark):
    """Against a plain search for the longest path; some graphs have cycles."""
    r = random.Random(9)
    calls, waits, want = [], [], {}
    for conv in range(30):
        n, on = r.randint(1, 14), defaultdict(set)
        for i in range(n):
            calls.append((conv, str(i), i, "now", "{}"))
            for _ in range(r.choice([0, 1, 1, 1, 2, 3])):
                j = r.randrange(n) if conv % 5 == 0 else r.randrange(i) if i else 99
                if j != i:
                    on[i].add(j)
                    waits.append((conv, str(i), str(j)))

        def level(i, path=(), on=on, n=n):
            if i in path:
                return None
            below = [level(j, (*path, i)) for j in on[i] if j < n]
            return None if None in below else 1 + max(below) if below else 0

        want |= {(conv, str(i)): level(i) for i in range(n)}
    got = {(x["conv_id"], x["call_id"]): x["level"] for x in chat_tools.levels(spark.createDataFrame(calls, CALLS), spark.createDataFrame(waits, WAITS), Scratch(spark)).collect()}
    assert got == want


def test_nested_schemas_and_names_with_dots(spark):
    schemas = {"put": {"a.b": ("integer", True), "at": ({"x": ("number", True), "in": ({"y": ("string", False)}, False)}, True), "tags": ("array", False)}}
    cases = ['{"a.b":1,"at":{"x":2}}', '{"a.b":"1","at":{"x":2,"in":{"y":3}}}', '{"at":{"z":1},"tags":{}}', '{"a.b":1,"at":[1]}', '{"a.b":1,"at":{"x":1.5,"in":{"y":"ok"}},"tags":[1]}', '{"a":{"b":1},"at":{"x":1}}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, arguments string")
    got = {r["i"]: r["e"] for r in df.select("i", chat_tools.errors(F.lit("put"), F.col("arguments"), schemas).alias("e")).collect()}
    assert got == {0: "", 1: "a.b is not integer; at.in.y is not string", 2: "missing a.b; missing at.x; unknown at.z; tags is not array", 3: "at is not object", 4: "", 5: "missing a.b; unknown a"}


def test_chat_tools_joins_by_hash_and_takes_long_texts(spark):
    long = "x" * 2_000_000
    frames = spark.createDataFrame([(1, "a", 1, "now", "{}")] * 3, CALLS), spark.createDataFrame([(1, "a", 2, long)] * 2, RESULTS), spark.createDataFrame([], WAITS)
    out = chat_tools.link(*frames, SCHEMAS)
    got = out.collect()
    assert len(got) == 1 and got[0]["status"] == "linked" and len(got[0]["message"]) > 2_000_000
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_chat_tools_runs_no_python(spark):
    plan = chat_tools.op3_chat_tools(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 4 ---------------------------------------------------------------------------------------


def brute_overlaps(docs, items):
    """Every window of every item along every diagonal."""
    out = set()
    tok = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").translate({**{i: i + 32 for i in range(65, 91)}, **{i: i + 32 for i in range(0xC0, 0xDF) if i != 0xD7}}))
    for d, t in docs:
        a = tok(t)
        for i, s in items:
            b = tok(s)
            n = min(len(b), decontaminate.OVERLAP)
            if len(b) < decontaminate.SHORTEST:
                continue
            if any(sum(x == y for x, y in zip(a[p : p + n], b[q : q + n], strict=True)) >= decontaminate.AGREE * n for q in range(len(b) - n + 1) for p in range(len(a) - n + 1)):
                out.add((d, i))
    return out


def test_overlaps_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([5, 7, 8, 10, 12, 13, 20, 40, 60])] + [(20, None), (21, "")]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 80)))) for k in range(40)] + [(1000, None), (1001, "")]
    for k in range(60):  # passages with some substitutions
        s = r.choice(items[:9])[1].split()
        part = s[r.randint(0, len(s) // 3) :]
        part = [r.choice(words) if r.random() < 0.08 else w.upper() for w in part]
        docs.append((100 + k, " ".join([r.choice(words)] * r.randint(0, 9) + part + ["end,"] * r.randint(0, 3))))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("agree", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.overlaps(df, bench).collect()}
    want = brute_overlaps(docs, items)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 20
    kept = {x["doc_id"] for x in decontaminate.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    old, decontaminate.blocks.__defaults__ = decontaminate.blocks.__defaults__, ("item_id", "text", 60)
    try:
        assert len(list(decontaminate.blocks(bench))) > 4
        assert {(x["doc_id"], x["item_id"]) for x in decontaminate.overlaps(df, bench).collect()} == got
        assert {x["doc_id"] for x in decontaminate.clean(df, bench).collect()} == kept
    finally:
        decontaminate.blocks.__defaults__ = old
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0 and decontaminate.overlaps(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", range(1, 15))
def test_no_substitution_of_short_items_is_missed(n):
    """All choices of substituted places, with as many as still agree and with one more."""
    from itertools import combinations

    item = [f"w{i}" for i in range(n)]
    block = decontaminate.Block([(7, " ".join(item).encode()), (8, b"")], shortest=1)
    maybe = block.filter()
    size = min(n, decontaminate.OVERLAP)
    free = size - int(np.ceil(decontaminate.AGREE * size - 1e-9)) if n >= decontaminate.SHORTEST else 0
    for most in (free, free + 1):
        for places in combinations(range(size), most):
            changed = [f"x{i}" if i in places else t for i, t in enumerate(item[:size])]
            w = tokens.hash_words([" ".join(["a", *changed, "b"]).encode()], tokens.ALNUM, fold=True)
            assert [(i, agree, s) for _, i, agree, s in block.match(w, maybe)] == ([(0, size - most, size)] if most == free else []), places


def test_short_items_match_whole_where_asked(spark):
    docs = spark.createDataFrame([(1, "say: What is it? now"), (2, "what is that"), (3, "what is"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "what is it"), (2, ""), (3, None), (4, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.overlaps(docs, bench, shortest=1).collect()] == [(1, 1, 3, 3)]
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench, shortest=3).collect()} == {2, 3, 4}
    assert decontaminate.overlaps(docs, bench).count() == 0 and decontaminate.overlaps(docs, bench.where("item_id = 2")).count() == 0


def test_contamination_of_the_test_tables(spark):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op4_decontamination(spark, "/root/testdata/sf0.001").collect()}
    read = lambda t, k: [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(k, "text").collect()]
    assert got == brute_overlaps(read("documents", "doc_id"), read("benchmark", "item_id"))


# --- 5 ---------------------------------------------------------------------------------------


def test_mix_reaches_targets_and_limits(spark):
    got = mixing.op5_mixing(spark, DATA).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    taken, target, sizes = Counter(), {}, Counter()
    for r in got:
        d = docs[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
        sizes[d["source"]] += r["size"]
        target[d["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken) and all(target[s] <= 3 * sizes[s] for s in taken)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_mix_edge_cases(spark):
    data = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (None, "q r", None), (5, "s " * 5000, "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == 6 and sum(r["taken"] for r in got) <= sum(r["size"] for r in got) + 4
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str)
    assert mixing.mix(df.limit(0)).count() == 0


def test_schedules_move_a_source_in_time(spark):
    df = spark.createDataFrame([(i, "w " * 10, "early" if i % 2 else "late") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(df, keep=["doc_id", "source"], schedules={"early": [(0.0, 2.0), (1.0, 0.0)], "late": [(0.0, 0.0), (1.0, 2.0)]})
    mean = {r[0]: r[1] for r in got.groupBy("source").agg(F.avg("position")).collect()}
    assert mean["early"] == pytest.approx(1 / 3, abs=0.02) and mean["late"] == pytest.approx(2 / 3, abs=0.02)
    positions = [r["position"] for r in got.collect()]
    assert positions == sorted(positions)


def test_positions_of_all_passes_follow_the_integrated_schedules(spark):
    """Against a numeric integration of the schedules, inverted by bisection; every pass has a position."""
    docs = [(i, "w " * (1 + i % 7), ["a", "b", "c", None][i % 13 % 4]) for i in range(500)] + [(900, "", "a"), (901, None, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    shape = lambda k, t: [1.6 - 1.2 * t, 0.5 + 2 * t if t < 0.5 else 2.5 - 2 * t, 0.4 + 1.2 * t][k]
    steps = 4000
    integral = [np.concatenate([[0], np.cumsum([(shape(k, i / steps) + shape(k, (i + 1) / steps)) / 2 / steps for i in range(steps)])]) for k in range(3)]
    assert all(abs(i[-1] - 1) < 1e-6 for i in integral)
    mixed = mixing.mix(df, keep=["doc_id", "source"]).cache()
    order = {s: k % 3 for k, s in enumerate(["a", "b", "c", None])}
    by_source = defaultdict(list)
    for r in mixed.collect():
        passes = [r[n] for n in mixing.position_names()]
        assert sum(p is not None for p in passes) == (-(-r["taken"] // r["size"]) if r["size"] else 0)
        by_source[r["source"]] += [(p, min(r["size"], r["taken"] - k * r["size"])) for k, p in enumerate(passes) if p is not None]
    for source, rows_ in by_source.items():
        target = next(r["target"] for r in mixed.collect() if r["source"] == source)
        before = 0
        for position, words_ in sorted(rows_):
            assert np.interp(position, np.linspace(0, 1, steps + 1), integral[order[source]]) == pytest.approx(before / target, abs=1e-5)
            before += words_
        assert abs(before - target) <= 1
    turns = mixing.training_order(mixed).collect()
    assert [t["position"] for t in turns] == sorted(t["position"] for t in turns) and sum(t["words"] for t in turns) == sum(r["taken"] for r in mixed.collect())
    assert {(t["doc_id"], t["pass"]) for t in turns} == {(r["doc_id"], k + 1) for r in mixed.collect() for k in range(-(-r["taken"] // r["size"]) if r["size"] else 0)}


# --- 7 ---------------------------------------------------------------------------------------


def brute_components(docs):
    """(size of the set, smallest key of the component) by key; unique keys."""
    sets = {}
    for d, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for d in sorted(sets):
        seen = Counter(o for g in sets[d] for o in index[g])
        for o, i in seen.items():
            if 100 * i >= 75 * (len(sets[d]) + len(sets[o]) - i):
                parent[find(d)] = find(o)
        for g in sets[d]:
            index[g].append(d)
    least = {}
    for d in sorted(sets):
        least.setdefault(find(d), d)
    return {d: (len(sets[d]), least[find(d)]) for d in sets}


def varied(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    docs, common = [], " ".join(r.choice(words) for _ in range(30))
    while len(docs) < n:
        base = [r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 6, 20, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 5, 40])):
            w = [x if r.random() > r.choice([0, 0.01, 0.03]) else r.choice(words) for x in base]
            docs.append((len(docs), " ".join(w) + (" " + common if r.random() < 0.3 else "")))
    return docs + [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "   "), (len(docs) + 3, docs[7][1].upper())]


@pytest.mark.parametrize("sizes", [(256, 128, 8, 512), (3, 2, 1, 2), (4, 3, 2, 5)])
def test_components_against_brute_force(spark, sizes, monkeypatch):
    tokens.small_batches(spark)
    for name, value in zip(("SPLIT", "BLOCK", "PIVOTS", "MEET"), sizes, strict=True):
        monkeypatch.setattr(ngram_join, name, value)
    docs = varied(sizes[0], 400)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()}
    assert got == brute_components(docs)


def test_query_against_brute_force_on_a_whole_table(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op7_ngram_join(spark, DATA).collect()}
    assert got == brute_components(docs)


@pytest.mark.parametrize("alike", [True, False])
def test_members_of_large_clusters_are_sent_a_few_times(spark, alike, monkeypatch):
    """Near copies go to about one block each; a cluster without links to as many as it fills blocks, and no link is lost."""
    tokens.small_batches(spark)
    for name, value in (("SPLIT", 60), ("BLOCK", 30), ("PIVOTS", 4), ("MEET", 200)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    base = [r.choice(words) for _ in range(60)]
    docs = []
    for k in range(1500):
        w = list(base)
        for _ in range(1 if alike else 9):  # nine changes leave less than 75 % of the shingles to any two
            w[r.randrange(60)] = f"x{r.randrange(10**9)}"
        docs.append((k, " ".join(w)))
    sent = {"dealt": [], "meeting": []}
    real_dealt, real_meeting = ngram_join._dealt, ngram_join._meeting
    monkeypatch.setattr(ngram_join, "_dealt", lambda *a: (out := real_dealt(*a)) and sent["dealt"].append(out.count() / max(1, a[0].count())) or out)
    monkeypatch.setattr(ngram_join, "_meeting", lambda *a: (out := real_meeting(*a)) and sent["meeting"].append(out.count() / max(1, a[0].count())) or out)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(docs)
    if alike:
        assert max(sent["dealt"]) <= 1.3 and sum(sent["meeting"]) <= 2, sent  # times of each membership


@pytest.mark.parametrize("kind", ["int", "string", "date", "decimal(12,2)", "binary"])
def test_keys_of_other_types(spark, kind):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(2, text), (1, text + " eight"), (3, None), (4, "other words than these are here")], "k int, text string")
    cast = F.to_date(F.lit("2020-01-01")) + F.col("k") if kind == "date" else F.col("k").cast("string").cast(kind) if kind == "binary" else F.col("k").cast(kind)
    got = ngram_join.join(df.withColumn("doc_id", cast)).collect()
    names = [r["component_id"] for r in got]
    assert len(got) == 4 and len({str(n) for n in names}) == 3 and sum(r["doc_id"] != r["component_id"] for r in got) == 1


def test_hot_shingles_are_dealt_out(spark, monkeypatch):
    """Shingles of more than SALT classes skip the meeting in one task."""
    docs = varied(11, 400)
    hot, salted = np.array([], np.uint64), None
    pieces = list(ngram_join._sets([(t or "").encode() for _, t in docs]))
    counts = Counter(x for _, u, _ in pieces for x in u.tolist())
    hot = np.array(sorted(x for x, c in counts.items() if c > 20), np.uint64)
    rank = np.argsort(np.argsort([counts[int(x)] for x in hot], kind="stable"), kind="stable")
    salted = hot[:: max(1, len(hot) // 50)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for _, t in docs], pa.binary())], ["text"])
    pairs = {}
    for name, direct in (("plain", np.array([], np.uint64)), ("salted", salted)):
        packed = pa.Table.from_batches(list(ngram_join._packed_keys(3, hot, rank, direct)([batch])))
        met = defaultdict(set)
        for p in range(3):
            t = ngram_join._clusters_of(packed.filter(pa.compute.equal(packed["p"], p)))
            for c, m in zip(t["centre"].to_pylist(), t["member"].to_pylist(), strict=True):
                met[c].add(m)
        pairs[name] = {(a, b) for group in met.values() for a in group for b in group if a < b}
    digests = {d: u for _, u, d in pieces if d}
    linked_pairs = {(a, b) for a in digests for b in digests if a < b and (i := len(np.intersect1d(digests[a], digests[b], True))) * 100 >= 75 * (len(digests[a]) + len(digests[b]) - i)}
    assert len(hot) > 0 and linked_pairs <= pairs["plain"] and linked_pairs <= pairs["salted"]


def test_tree_prunes_only_what_cannot_be_linked():
    pieces = [(u, ngram_join.bitmap(u)) for _, u, d in ngram_join._sets([(t or "").encode() for _, t in varied(3, 500)]) if d]
    sizes = np.array([len(u) for u, _ in pieces])
    found = ngram_join.partners(sizes, [b for _, b in pieces])
    for i, (u, _) in enumerate(pieces):
        if not found[i]:
            assert not any(j != i and (n := len(np.intersect1d(u, v, True))) * 100 >= 75 * (len(u) + len(v) - n) for j, (v, _) in enumerate(pieces))
    assert 0 < found.sum() < len(found)


def test_join_edge_cases(spark):
    same = "one two three four five six seven"
    df = spark.createDataFrame([(3, same), (3, same), (1, same + " eight"), (None, same), (9, None), (8, "x " * 20_000)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()), key=str)
    assert got == sorted([(3, 3, 1), (3, 3, 1), (1, 4, 1), (None, 3, 1), (9, 0, 9), (8, 1, 8)], key=str)
    assert ngram_join.join(df.limit(0)).count() == 0 and ngram_join.join(df.where("doc_id = 9")).first()["component_id"] == 9


def test_components_of_hubs(spark):
    """A label of many nodes is joined in parts."""
    hub = [(bytes([0, 0, 9]), bytes([1, i // 256, i % 256])) for i in range(600)] + [(bytes([0, 0, 1]), bytes([0, 0, 9])), (bytes([5]), bytes([6]))]
    got = {bytes(r["node"]): bytes(r["label"]) for r in ngram_join.components(spark.createDataFrame(hub, "a binary, b binary"), Scratch(spark)).collect()}
    assert len(got) == 604 and sum(v == bytes([0, 0, 1]) for v in got.values()) == 602 and got[bytes([6])] == bytes([5])


def test_components_of_long_paths(spark):
    path = [(bytes([i // 256, i % 256]), bytes([(i + 1) // 256, (i + 1) % 256])) for i in range(30)]
    got = ngram_join.components(spark.createDataFrame(path, "a binary, b binary"), Scratch(spark)).collect()
    assert len(got) == 31 and {bytes(r["label"]) for r in got} == {b"\0\0"}


# --- 8 ---------------------------------------------------------------------------------------


def test_known_license_texts_in_other_spellings(spark):
    mit = license_scan.TEXTS["MIT"]
    df = spark.createDataFrame([(1, mit), (2, "Copyright (c) 2020 Some One\nAll rights reserved.\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " , ")), (3, mit + "\nExtra words."), (4, None), (5, ""), (6, "prose\nReleased under the MIT Licence!\nmore\nreleased under the mit license\nLicensed under CC BY-NC 4.0")], "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in license_scan.scan(df).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, ""), 5: (None, ""), 6: (None, "CC-BY-NC-4.0,MIT")}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_whole_texts_under_other_titles_and_of_further_licenses(spark):
    body = license_scan.TEXTS["MIT"].split("\n", 1)[1]
    isc, bsd, more = license_scan.TEXTS["ISC"].split("\n", 1)[1], license_scan.TEXTS["BSD-2-Clause"], dict(license_scan.MORE)
    wrapped = "\n".join(re.findall(r".{1,68}(?:\s|$)", more["BSD-3-Clause"]))
    texts = [("MIT", body), ("MIT", "The MIT License (MIT)\n\nCopyright Some One\n\n" + body), ("MIT", "MIT License\nCopyright 2020-2022, A and B\n" + body), ("ISC", "The ISC License\nCopyright Some One and others\n" + isc)]
    texts += [("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, X\n\n" + bsd), ("BSD-3-Clause", "BSD 3-Clause License\nCopyright X\n" + wrapped), ("Unlicense", more["Unlicense"]), ("own", "Own License\nDo as we say."), (None, "MIT License\nCopyright X"), (None, body + "\nBut not on Sundays.")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(df, more=[("own", "Do as we say!")]).collect()}
    assert [got[i] for i in range(len(texts))] == [k for k, _ in texts]


@pytest.mark.parametrize(("file", "name"), [("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_license_texts(spark, file, name):
    from pathlib import Path

    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no copy of the text on this machine")
    df = spark.createDataFrame([(1, path.read_text()), (2, path.read_text() + "\nmore")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in license_scan.scan(df).collect()} == {1: name, 2: None}


def test_canonical_forms_agree(spark):
    texts = list(license_scan.TEXTS.values()) + ["Licence — organisation's  ©2020", "(c) 2021 X", "Copyright owner 2020"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.filter(F.transform(F.split("t", "\n"), license_scan.canonical), lambda x: x != "")).collect()
    assert [r[0] for r in got] == [license_scan.canonical_text(t) for t in texts]


# --- the pipeline ----------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    from changelake.llm import secret_scan, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("extra", F.lit(1))
    docs = docs.unionByName(docs.where("doc_id = 40")).unionByName(docs.where("doc_id = 41").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    stages = [s for _, s in corpus_pipeline.STAGES]
    model = toxicity.fit_documents(spark, docs, DATA)
    a = docs.collect()
    toxic = toxicity.probabilities(model, [(r["text"] or "").encode() for r in a])[:, 1] >= model["thresholds"][1]
    one = stages[0](spark, docs, DATA).cache()
    assert sorted(map(str, one.collect())) == sorted(str(r) for r, t in zip(a, toxic, strict=True) if not t)
    two = stages[1](spark, one, DATA).cache()
    kept = {d for d, (_, c) in brute_components({r["doc_id"]: r["text"] for r in one.collect() if r["doc_id"] is not None}.items()).items() if d == c}
    assert sorted(r["doc_id"] for r in two.where("doc_id is not null").collect()) == sorted(kept) and two.where("doc_id is null").count() == 1
    three = stages[2](spark, two, DATA).cache()
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in two.collect()} - {r["doc_id"] for r in three.collect()}
    assert gone and gone == {d for d, _ in brute_overlaps([(r["doc_id"], r["text"]) for r in two.collect() if r["doc_id"] in gone], items)}
    four = stages[3](spark, three, DATA).cache()
    before = {r["doc_id"]: r for r in three.collect()}
    for r in four.collect():
        assert r["text"] == secret_scan.redacted(before[r["doc_id"]]["text"]) and r["n_chars"] == (len(r["text"]) if r["text"] is not None else before[r["doc_id"]]["n_chars"])
    assert four.columns == three.columns == two.columns == one.columns == docs.columns
    five = stages[4](spark, four, DATA)
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in four.collect()}
    got = five.collect()
    assert got and all(0 < r["taken"] <= 3 * sizes[r["doc_id"]] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(sizes.values()), abs=25)


def test_rows_that_share_a_doc_id_are_judged_by_their_texts(spark):
    import corpus_pipeline

    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", "red green blue cyan pink teal grey")
    rows_ = [(1, b, "x"), (5, a, "x"), (5, b, "x"), (7, c, "z"), (7, c, "y"), (7, c, "y"), (None, c, "n"), (None, "only this here with no id", "n"), (-3, a + " eight", "x"), (9, None, "x"), (9, None, "x"), (10, "", "x")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string").withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
    got = sorted(((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.keep_one_of_each_group(spark, df, DATA).collect()), key=str)
    assert got == sorted([(1, b, "x"), (-3, a + " eight", "x"), (7, c, "y"), (None, "only this here with no id", "n"), (9, None, "x"), (9, None, "x"), (10, "", "x")], key=str)
    alone = spark.createDataFrame([(1, b), (5, a), (5, b)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.keep_one_of_each_group(spark, alone, DATA).collect())) == [(1, b), (5, a)]


def test_stages_carry_columns_of_clashing_names(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    names = ["__text", "__key", "place", "y0", "p_toxic", "is_toxic", "count", "first", "component_id", "n", "d", "found", "skey", "bucket", "before", "kept0", "Size", "target"]
    more = docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        got, plain = stage(spark, more, DATA), stage(spark, docs, DATA)
        last = name == corpus_pipeline.STAGES[-1][0]
        carried = [c for c in names if not last or c.lower() not in ("size", "target")]
        assert set(got.columns) == set(plain.columns) | set(carried) and len(got.columns) == len(plain.columns) + len(carried), name
        rows = got.collect()
        assert all(r[c] == f"x{names.index(c)}" for r in rows for c in carried), name
        assert sorted(str([r[c] for c in plain.columns]) for r in rows) == sorted(str(list(r)) for r in plain.collect()), name


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "text", "taken", "position"} <= set(got.columns)
