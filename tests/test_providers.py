"""The provider stage: retries, refusals, stores and what becomes of odd answers; without waiting."""

from pyspark.sql import functions as F

from clausewell.operators import providers
from clausewell.plans.engine import SCAN, Engine, RetrievalConfig

NOW = providers.Policy(least=0.0)


class Scripted:
    """Replies from a list per prompt, in order; counts calls."""

    def __init__(self, script):
        self.script, self.calls = {k: list(v) for k, v in script.items()}, []

    def answer(self, prompts):
        self.calls.append(list(prompts))
        return [self.script[p].pop(0) for p in prompts]


def test_attempts_and_waits():
    slept, down = [], ConnectionError("down")
    one = Scripted({"a": ["yes"], "b": [down, down, "late"], "c": [down] * 9, "d": [providers.Refused("no"), "never"]})
    found = providers.call(one, ["a", "b", "c", "d"], providers.Policy(budget=1e9), slept.append, lambda: 0.0)
    assert found == [("yes", "answered", 1, None), ("late", "answered", 3, None), (None, "failed", 5, "ConnectionError: down"), (None, "refused", 1, "no")]
    assert slept == [10.0, 20.0, 40.0, 80.0] and one.calls == [["a", "b", "c", "d"], ["b", "c"], ["b", "c"], ["c"], ["c"]]
    assert [providers.Policy().wait(k) for k in range(1, 7)] == [10, 20, 40, 80, 160, 240]


def test_the_time_budget_ends_attempts():
    now = [0.0]
    down = Scripted({"a": [ConnectionError("x")] * 9})
    found = providers.call(down, ["a"], providers.Policy(attempts=9, budget=100.0), lambda s: now.__setitem__(0, now[0] + s), lambda: now[0])
    assert found[0][1:3] == ("failed", 4) and now[0] == 70.0


def test_a_raising_call_and_a_short_reply_are_failures():
    class Broken:
        def answer(self, prompts):
            if "short" in prompts:
                return []
            raise providers.Refused("all") if "refuse" in prompts else TimeoutError("slow")

    call = lambda *p: providers.call(Broken(), list(p), NOW)
    assert call("a", "refuse") == [(None, "refused", 1, "all")] * 2
    assert call("a") == [(None, "failed", 5, "TimeoutError: slow")]
    assert call("short", "b")[1][1:] == ("failed", 5, "ValueError: 0 replies to 2 prompts")


def test_batches_distinct_prompts_and_a_store(spark, tmp_path):
    class Sized:
        def answer(self, prompts):
            return [f"{len(prompts)}" if "bad" not in p else ConnectionError("bad") for p in prompts]

    rows = spark.range(1000).select("id", F.concat(F.lit("p"), (F.col("id") % 250).cast("string")).alias("prompt")).union(spark.createDataFrame([(5000, "bad"), (5001, None)], "id bigint, prompt string"))
    store = f"file://{tmp_path}/store"
    policy = providers.Policy(batch=40, parallel=2, least=0.0)
    found = providers.with_replies(rows, F.col("prompt"), Sized(), policy, store).collect()
    assert len(found) == 1002 and max(int(r.reply.answer) for r in found if r.id < 1000) == 40
    assert {r.id: r.reply and r.reply.status for r in found if r.id > 1000} == {5000: "failed", 5001: None}
    assert spark.read.parquet(store).count() == 251

    class Second:
        def answer(self, prompts):
            return ["again"] * len(prompts)

    again = providers.ask(rows.union(spark.createDataFrame([(1, "new")], "id bigint, prompt string")), Second(), policy, store)
    assert again.filter("answer = 'again'").count() == 2 and again.filter("status = 'answered'").count() == 252
    assert spark.read.parquet(store).count() == 253
    assert providers.ask(rows.limit(0), Second(), policy).count() == 0


def test_odd_answers(spark):
    table = providers.Lookup({"judge\na": "Green", "judge\nb": "blue", "gate\na": "{", "gate\nb": '{"kind": "guide"}', "gate\nc": '{"kind": "other"}'})
    rows = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "clause string")
    assert {r.clause: (r.verdict, r.status) for r in providers.judged(rows, table, policy=NOW).collect()} == {
        "a": ("green", "answered"), "b": (None, "malformed"), "z": (None, "refused"), None: (None, None)}
    gates = providers.classified(spark.createDataFrame([("a",), ("b",), ("c",)], "text string"), table, policy=NOW)
    assert {r.text: (r.kind, r.jurisdiction, r.status) for r in gates.collect()} == {"a": (None, None, "malformed"), "b": (None, None, "malformed"), "c": ("other", None, "answered")}


def test_an_engine_with_a_provider(spark):
    class Model:
        """Answers every kind of prompt of the engine."""

        def answer(self, prompts):
            out = []
            for p in prompts:
                kind, _, text = p.partition("\n")
                out.append({"grade": "false", "rerank": "[2, 1, 2, 99]", "rewrite plain": "heat", "rewrite statutory": "  ", "judge": "red" if "Heat" in text else "green"}[kind])
            return out

    docs = spark.createDataFrame([(1, "the deposit is held"), (2, "heat and water"), (3, "deposit and heat")], "doc_id bigint, text string")
    engine = Engine(docs, provider=Model(), policy=NOW)
    asked = spark.createDataFrame([(7, "deposit")], "item_id bigint, text string")
    plain = [r.doc_id for r in engine.retrieve(asked).orderBy("position").collect()]
    assert plain == [3, 1]
    found = engine.retrieve(asked, RetrievalConfig(rewritten=True, graded=True, reranked=True)).orderBy("position").collect()
    # fused with the hits for "heat", and once more with those of the question itself, then the second, the first, the second
    fused = [r.doc_id for r in Engine(docs).retrieve(asked, RetrievalConfig(rewritten=True, graded=True), *engine_tables(spark)).orderBy("position").collect()]
    assert [r.doc_id for r in found] == [fused[1], fused[0], fused[1]]
    clauses = Engine(spark.createDataFrame([(1, "Heat is not provided here, " * 4)], "doc_id bigint, text string"), provider=Model(), policy=NOW).findings().collect()
    assert [(r.doc_id, r["index"], r.verdict, r.status) for r in clauses] == [(1, 1, "red", "answered")]


def engine_tables(spark):
    rewrites = spark.createDataFrame([(7, "plain", "heat"), (7, "statutory", "deposit")], "item_id bigint, angle string, text string")
    return rewrites, spark.createDataFrame([(7, False)], "item_id bigint, sufficient boolean")


def test_questions_are_searched_whole_and_clauses_cut(spark):
    long = "filler " * 300 + "zebra"
    docs = spark.createDataFrame([(1, "zebra stripes"), (2, "filler alone")], "doc_id bigint, text string")
    engine, asked = Engine(docs), spark.createDataFrame([(7, long)], "item_id bigint, text string")
    assert {r.doc_id for r in engine.retrieve(asked).collect()} == {1, 2}
    assert {r.doc_id for r in engine.retrieve(asked, SCAN).collect()} == {2}
    hits = Engine(spark.createDataFrame([(1, "A clause about zebra stripes. " * 5), (2, "none")], "doc_id bigint, text string")).clause_hits().collect()
    assert {(r.doc_id, r["index"], r.hit.doc_id, r.position) for r in hits} == {(1, 1, 1, 1), (2, 1, 2, 1)}
