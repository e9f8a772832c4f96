"""Reply repair/parse (F-F), cache joins (F-G), annotation with a stub."""

import glob
import json
import os
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import annotate as A
from shelfrank.operators import cache
from shelfrank.plans.stub_model import stub_annotator


def parsed(spark, replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "id int, reply string")
    return A.parse_replies(df, ["id"])


def test_reply_repair_and_parse(spark):
    replies = [
        '[{"produto": "A", "diagnostico": "d1", "acao": "x"}]',
        '```json\n[{"produto": "B", "diagnostico": "d2"},\n]\n```',
        'Sure! Here it is: [{"produto": "C", "diagnostico": "d3", "acao": "y"}] hope it helps',
        '{"produto": "D", "diagnostico": "bare"}',
        'not json at all',
        '[7, {"produto": "E", "diagnostico": "d5"}]',
    ]
    rows = parsed(spark, replies).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.id, []).append(r)
    assert [r.produto for r in by_id[0]] == ["A"]
    assert by_id[1][0].produto == "B" and by_id[1][0].acao is None  # default applied on attach
    assert by_id[2][0].produto == "C"
    assert 3 not in by_id and 4 not in by_id  # bare object / junk -> no entries
    assert [r.produto for r in by_id[5]] == ["E"]  # number skipped


def test_attach_last_wins_and_defaults(spark):
    rows = spark.createDataFrame([(1, [("A", "TOP"), ("B", "TOP")], False,
                                   '[{"produto": "A", "diagnostico": "old"}, {"produto": "A", "diagnostico": "new"}]'),
                                  (2, [("A", "TOP")], True, None)],
                                 "id int, items array<struct<product: string, kind: string>>, _failed boolean, reply string")
    rows = rows.withColumn("_entries", A.entries()).drop("reply")
    out = {r.id: {x.product: (x.diagnosis, x.action) for x in r["items"]} for r in A.attach(rows, **A._INSIGHT).collect()}
    assert out == {1: {"A": ("new", "-"), "B": (A.UNAVAILABLE, "-")}, 2: {"A": (A.CALL_ERROR, "-")}}


LISTS = ("granularity string, store_id string, period string, total decimal(18,2), "
         "items array<struct<i: int, product: string, kind: string, value: decimal(18,2), pos: int, diagnosis: string, action: string>>")
KEYS = ["granularity", "store_id", "period"]


def texts(df):
    return {(r.period, r.product): (r.diagnosis, r.action) for r in A.flat_items(df, KEYS).collect()}


def test_stub_annotator_periods(spark):
    D = Decimal
    lists = spark.createDataFrame([("day", "s", f"2024-01-{d:02d}", D(15), [(1, "X", "TOP", D(10), 1, None, None), (2, "Y", "BOTTOM", D(5), 1, None, None)])
                                   for d in range(1, 9)] + [("day", "t", "2024-01-01", D(0), [])], LISTS)
    out = texts(A.annotate_periods(lists, stub_annotator, KEYS))
    assert len(out) == 16
    assert out["2024-01-08", "X"] == ("revisado [a, ]", "rever")  # first product repeated at the end: last wins
    assert out["2024-01-02", "Y"] == ("BOTTOM #2", "manter")
    assert out["2024-01-01", "Y"] == (A.HISTORICAL, "-")  # the eighth newest period
    assert {d for d, _ in texts(A.annotate_periods(lists, None, KEYS)).values()} == {A.NO_MODEL}

    def broken(_):
        raise RuntimeError("service down")

    assert {v for k, v in texts(A.annotate_periods(lists, broken, KEYS)).items() if k[0] > "2024-01-01"} == {(A.CALL_ERROR, "-")}


def test_annotated_items_never_leave_their_row(spark):
    """No explode and no join between the prompts and the annotated rows."""
    lists = spark.createDataFrame([("day", "s", "2024-01-01", Decimal(15), [(1, "X", "TOP", Decimal(10), 1, None, None)])], LISTS)
    plan = A.annotate_periods(lists, stub_annotator, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Exchange" not in plan


ITEMS = "store_id string, product string, abc_class string, rank int, value decimal(18,2)"


def test_cache_hits_misses_upsert(spark):
    D = Decimal
    items = spark.createDataFrame([("1", "A", "A", 1, D(10)), ("1", "B", "B", 2, D(5)), ("1", "C", "C", 3, D(1)),
                                   ("1", "E", "C", 4, D(1)), ("2", "A", "A", 1, D(9))], ITEMS)
    old = spark.createDataFrame([("1", "A", "A", "cached A"), ("1", "B", "A", "class changed"),
                                 ("1", "C", "C", ""), ("3", "A", "A", "other store")], cache.CACHE_SCHEMA)
    hits = {(r.store_id, r.product) for r in cache.hits(items, old).collect()}
    assert hits == {("1", "A")}
    miss = {(r.store_id, r.product) for r in cache.misses(items, old).collect()}
    assert miss == {("1", "B"), ("1", "C"), ("1", "E"), ("2", "A")}
    out, new = cache.annotate_abc(items, old, stub_annotator)
    got = {(r.store_id, r.product): (r.analysis, r.from_cache) for r in out.collect()}
    assert got[("1", "A")] == ("cached A", True)
    assert got[("1", "C")] == ("Classe C item 2", False)
    assert got[("1", "E")] == (A.UNAVAILABLE, False)  # third item of its batch: the stub skips it
    up = {(r.store_id, r.product, r.abc_class): r.analysis for r in cache.upsert(old, new).collect()}
    assert up[("1", "B", "B")].startswith("Classe B")
    assert up[("1", "C", "C")] == "Classe C item 2"  # overwrites the empty text
    assert ("1", "E", "C") not in up  # the unavailable text is not stored
    assert up[("3", "A", "A")] == "other store"
    stats = {r.store_id: (r.hits, r.misses) for r in cache.hit_miss_by_store(out).collect()}
    assert stats == {"1": (1, 3), "2": (0, 1)}


def test_cache_json_round_trip(spark, tmp_dir):
    old = spark.createDataFrame([("1", "PAO|X", "A", "t1"), ("1", "B", "C", "t2"), ("12", "A", "B", "t3")],
                                cache.CACHE_SCHEMA)
    cache.write_json(old, f"{tmp_dir}/cache")
    back = cache.read_json(spark, f"{tmp_dir}/cache")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in old.collect())
    assert cache.read_json(spark, f"{tmp_dir}/missing").count() == 0


def test_cache_json_lines_hold_one_entry(spark, tmp_dir):
    big = spark.range(5000).select(F.lit("7").alias("store_id"), F.concat(F.lit("P"), F.col("id").cast("string"))
                                   .alias("product"), F.lit("C").alias("abc_class"), F.lit("t").alias("analysis"))
    lines = cache.to_json_lines(big).collect()
    assert len(lines) == 5000 and all(len(json.loads(r.value)["7"]) == 1 for r in lines)
    cache.write_json(big, f"{tmp_dir}/big")
    assert cache.read_json(spark, f"{tmp_dir}/big").count() == 5000


def test_cache_is_replaced_in_place(spark, tmp_dir):
    path = f"{tmp_dir}/cache"
    old = spark.createDataFrame([("1", "A", "A", "t1"), ("1", "B", "C", "t2")], cache.CACHE_SCHEMA)
    cache.write_json(old, path)
    read = cache.read_json(spark, path)
    new = spark.createDataFrame([("1", "B", "C", "t3"), ("2", "A", "B", "t4")], cache.CACHE_SCHEMA)
    cache.write_json(cache.upsert(read, new), path)  # reads the path that it replaces
    assert sorted(tuple(r) for r in cache.read_json(spark, path).collect()) == [
        ("1", "A", "A", "t1"), ("1", "B", "C", "t3"), ("2", "A", "B", "t4")]
    assert os.listdir(tmp_dir) == ["cache"]


def test_repeated_cache_keys_give_one_hit(spark):
    items = spark.createDataFrame([("1", "A", "A", 1, Decimal(10))], ITEMS)
    old = spark.createDataFrame([("1", "A", "A", "x"), ("1", "A", "A", "y"), ("1", "A", "A", "")], cache.CACHE_SCHEMA)
    assert [r.analysis for r in cache.hits(items, old).collect()] == ["y"]
    assert cache.upsert(old, old.limit(0)).count() == 1


def test_only_a_missing_cache_is_empty(spark, tmp_dir):
    assert cache.read_json(spark, f"{tmp_dir}/missing").count() == 0
    with pytest.raises(Exception, match="nosuchscheme"):
        cache.read_json(spark, "nosuchscheme://x/y").count()


def test_prompts_are_dealt_over_tasks_and_errors_reported(spark):
    prompts = spark.range(65).select(F.col("id"), F.col("id").cast("string").alias("prompt"))

    def model(p):
        from pyspark import TaskContext
        if p == "7":
            raise TimeoutError("slow")
        return str(TaskContext.get().partitionId())

    replies = A.call_annotator(prompts, model, ["id"])
    assert replies.columns == ["id", "reply", "error"]
    rows = replies.collect()
    assert len(rows) == 65 and len({r.reply for r in rows}) > 8
    assert [r.error for r in rows if r.id == 7] == ["TimeoutError: slow"]
    assert tuple(A.call_errors(replies).first()) == (65, 1, ["TimeoutError"])


def test_repair_json_leaves_strings_alone(spark):
    cases = ['x [ {"a": "1, ]", } , ] y', '```json\n[1, 2,\n]\n```', '{"a": 1}', '["q\\", ]", ]', "junk", "[", "] [", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, reply string")
    got = {r.i: r.x for r in df.select("i", A.repair_json("reply").alias("x")).collect()}
    assert got == {0: '[ {"a": "1, ]" }  ]', 1: "[1, 2\n]", 2: '{"a": 1}', 3: '["q\\", ]" ]', 4: "junk", 5: "[", 6: "] [", 7: None}


# ------------------------------------------------------------ call journal

def test_a_task_that_fails_late_repeats_no_call(tmp_dir):
    """In a session that tries tasks again: the last prompt of each task kills it
    at the first attempt, after all other calls of the task."""
    code = f"""
import os, sys, uuid
sys.path.insert(0, {os.getcwd()!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from shelfrank.operators import annotate as A
spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {tmp_dir + "/ckpt"!r}).getOrCreate())
os.makedirs({tmp_dir + "/calls"!r})
def model(p):
    open({tmp_dir + "/calls/"!r} + p + "." + uuid.uuid4().hex, "w").close()
    return "reply " + p
def late(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("executor lost")
prompts = spark.range(40).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
for run in range(2):
    replies = A.call_annotator(prompts, model, ["id"], tasks=3, journal={tmp_dir + "/journal"!r})
    rows = replies.mapInArrow(late, replies.schema).collect()
    assert sorted((r.id, r.reply, r.error) for r in rows) == [(i, f"reply p{{i}}", None) for i in range(40)], rows
from shelfrank.operators import journal
kept = journal.replies(spark, {tmp_dir + "/journal"!r})
assert kept.count() == 40 and kept.where("reply = 'reply p7'").count() == 1
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    calls = [f.split(".")[0] for f in os.listdir(f"{tmp_dir}/calls")]
    assert sorted(calls) == sorted(f"p{i}" for i in range(40))


def test_failed_calls_are_asked_again(spark, tmp_dir):
    prompts = spark.createDataFrame([(1, "é\n1"), (2, "2")], "id int, prompt string")

    def half(p):
        if p == "2":
            raise TimeoutError("slow")
        return ""
    first = A.call_annotator(prompts, half, ["id"], journal=f"{tmp_dir}/j").collect()
    assert sorted((r.id, r.reply) for r in first) == [(1, ""), (2, None)]
    again = A.call_annotator(prompts, lambda p: "later", ["id"], journal=f"{tmp_dir}/j").collect()
    assert sorted((r.id, r.reply) for r in again) == [(1, ""), (2, "later")]


# ------------------------------------------------------------ a cache that is never lost

def entries(spark, path):
    return sorted(tuple(r) for r in cache.read_json(spark, path).collect())


OLD = [("1", "A", "A", "t1"), ("1", "B", "C", "t2"), ("2", "A", "A", "t3")]
FRESH = [("1", "B", "C", "new"), ("9", "Z", "B", "t9")]
BOTH = [("1", "A", "A", "t1"), ("1", "B", "C", "new"), ("2", "A", "A", "t3"), ("9", "Z", "B", "t9")]


@pytest.mark.parametrize("write", ["update", "replace"])
@pytest.mark.parametrize("step, left", [("write_data", OLD), ("publish", OLD), ("rename", OLD), ("tidy", BOTH)])
def test_a_crash_at_any_step_leaves_a_whole_cache(spark, tmp_dir, monkeypatch, write, step, left):
    path = f"{tmp_dir}/cache"
    cache.write_json(spark.createDataFrame(OLD, cache.CACHE_SCHEMA), path)
    new = spark.createDataFrame(FRESH, cache.CACHE_SCHEMA)

    def run():
        if write == "update":
            cache.update_json(new, path)
        else:
            cache.write_json(cache.upsert(cache.read_json(spark, path), new), path)

    def stop(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "rename":  # the draft of the manifest is written, but not named
            real = cache._Folder.publish

            def publish(self, number, buckets):
                class Fs:
                    def __getattr__(self, name, fs=self.fs):
                        return stop if name == "rename" else getattr(fs, name)
                self.fs = Fs()
                real(self, number, buckets)
            m.setattr(cache._Folder, "publish", publish)
        elif step == "write_data":  # the data is written in part
            def half(self, entries):
                real_write(self, entries.limit(1))
                stop()
            real_write = cache._Folder.write_data
            m.setattr(cache._Folder, "write_data", half)
        else:
            m.setattr(cache._Folder, step, stop)
        with pytest.raises(KeyboardInterrupt):
            run()
    assert entries(spark, path) == left
    run()
    assert entries(spark, path) == BOTH
    assert len([f for f in os.listdir(path) if f[0] != "."]) <= (3 if write == "update" else 2)


def test_an_update_leaves_other_stores_files_alone(spark, tmp_dir):
    path = f"{tmp_dir}/cache"
    many = [(str(i), "A", "A", f"t{i}") for i in range(300)]
    cache.write_json(spark.createDataFrame(many, cache.CACHE_SCHEMA), path)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data-*/bucket=*/part-*")}
    cache.update_json(spark.createDataFrame([("7", "A", "A", "x"), ("7", "B", "A", "y")], cache.CACHE_SCHEMA), path)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data-*/bucket=*/part-*")}
    assert sum(f in after and after[f] == t for f, t in before.items()) == len(before)  # files that stay are as they were
    assert len(set(after) - set(before)) == 1
    got = dict((r[0] + r[1], r[3]) for r in entries(spark, path))
    assert got["7A"] == "x" and got["7B"] == "y" and got["8A"] == "t8" and len(got) == 301
    cache.update_json(spark.createDataFrame([], cache.CACHE_SCHEMA), path)
    assert len(entries(spark, path)) == 301


def test_two_runs_at_once_do_not_mix(spark, tmp_dir):
    path = f"{tmp_dir}/cache"
    cache.write_json(spark.createDataFrame(OLD, cache.CACHE_SCHEMA), path)
    folder = cache._Folder(spark, path)
    number, buckets = folder.current()
    folder.publish(number + 1, buckets)
    with pytest.raises(OSError):
        folder.publish(number + 1, {})


def test_plain_objects_are_read_and_updated(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/cache")
    with open(f"{tmp_dir}/cache/old.json", "w") as f:
        f.write('{"1": {"A|A": "t1", "B|C": "t2"}, "2": {"A|A": "t3"}}')
    assert entries(spark, f"{tmp_dir}/cache") == OLD
    cache.update_json(spark.createDataFrame(FRESH, cache.CACHE_SCHEMA), f"{tmp_dir}/cache")
    assert entries(spark, f"{tmp_dir}/cache") == BOTH


def test_documents_of_any_shape(spark, tmp_dir):
    from shelfrank.operators import documents
    lines = ['{"granularidade": "day", "dados_lojas": [{"id_loja": 1, "analises": {"2024-01-01": {"total": 5, "itens": '
             '[{"produto": "A", "valor": 2, "tipo": "TOP", "analise_ia": {"diagnostico": "d", "acao": "x"}}, 7, "no", {"produto": "B", "novo": [1]}]}}}]}',
             '[{"id_loja": "02", "analises": [{"periodo": "p", "total": "2.5", "itens": [{"produto": "C", "valor": "x", "analise_ia": "said"}]}]}]',
             'junk', '', '{"dados_lojas": {"a": 1}}', '{"granularidade": 3, "dados_lojas": [{"id_loja": "X", "analises": {"q": {"itens": null}}}, 5]}', '[]']
    with open(f"{tmp_dir}/f.json", "w") as f:
        f.write("\n".join(lines))
    got = [tuple(r) for r in documents.read_mixed_documents(spark, tmp_dir).orderBy("produto").collect()]
    assert got == [("day", 1, "1", "2024-01-01", 5.0, 0, "A", 2.0, "TOP", "d", "x"), ("day", 1, "1", "2024-01-01", 5.0, 3, "B", None, None, None, None),
                   (None, 2, "02", "p", 2.5, 0, "C", None, None, "said", None)]
