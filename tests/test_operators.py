"""Operators: generation, resuming, pairing, metrics, files."""

import json
import time

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.operators.backends import get_backend
from promptloom.operators.chat import chunk_delta, chunk_final, chunk_sample, side_by_side
from promptloom.operators.embeddings import mean_pool
from promptloom.operators.generate import Answer, ExpressionBackend, PythonBackend, generate
from promptloom.operators.metrics import confusion_matrix, multilabel_pairs, router_loss
from promptloom.operators.pairing import (
    align_n_answers,
    criteria_cross,
    pair_answers,
    template_lookup,
)
from promptloom.operators.resume import skip_done
from promptloom.operators.stats import tokenizer_counter
from promptloom.plans import schedulers
from promptloom.plans.dump import dump
from promptloom.plans.experiment import grid_answers, run_grid
from promptloom.plans.judge import judge_list, judge_pair, judge_pair_by_category
from promptloom.plans.router import (
    RouterModel,
    composite_loss,
    labelled_features,
    logistic_start,
    choice_label,
    exact_split,
    hashed_split,
    predict,
    train_router,
)
from promptloom.session import materialise, scratch_path, shared_dir
from promptloom.functions.template import list_judge_prompt
from promptloom.sources.answers import read_answers_csv, read_judge_templates
from promptloom.sources.prompts import OutlinePrompts, naive_template, outline_templates
from promptloom.sources.requests import number_rows, read_requests_csv, read_router_csv
from promptloom.sources.results import export_csv, write_predictions, write_results
from workload import fixtures, sources


def asked(spark, texts):
    return spark.createDataFrame(
        [(i, [t]) for i, t in enumerate(texts)], "request_id long, messages array<string>"
    )


# ---- generation -------------------------------------------------------------


def test_retry_error_and_timeout(spark):
    def open_call():
        seen = {}

        def call(messages, settings):
            text = messages[0][0]
            seen[text] = seen.get(text, 0) + 1
            if text == "slow":
                time.sleep(5)
            if text == "bad":
                raise PermissionError("no")
            if text == "late" and seen[text] < 3:
                raise ConnectionError("busy")
            return [text.upper()]

        return call

    backend = PythonBackend(
        open_call, attempts=3, wait_min=0, wait_max=0, timeout=0.5, fatal=(PermissionError,)
    )
    out = generate(asked(spark, ["ok", "slow", "bad", "late"]), backend, ["request_id"], partitions=2)
    texts = ["ok", "slow", "bad", "late"]
    got = {
        texts[r["request_id"]]: (r["text"], r["attempts"], r["error"])
        for r in materialise(out).collect()
    }
    assert got["ok"] == ("OK", 1, None)
    assert got["late"] == ("LATE", 3, None)
    assert got["bad"] == (None, 1, "PermissionError: no")
    assert got["slow"][:2] == (None, 3) and "TimeoutError" in got["slow"][2]


def test_wrong_number_of_answers_is_an_error(spark):
    backend = PythonBackend(lambda: lambda m, s: ["only one"], batch=True, attempts=1)
    out = generate(asked(spark, ["a", "b"]).coalesce(1), backend, ["request_id"], partitions=1)
    assert {r["error"] for r in out.collect()} == {"ValueError: 1 answers to 2 requests"}


def test_batches_span_requests(spark):
    backend = PythonBackend(lambda: lambda m, s: [str(len(m))] * len(m), batch=True, batch_rows=8)
    out = generate(asked(spark, ["x"] * 20), backend, ["request_id"], partitions=1)
    assert sorted(r["text"] for r in out.collect()) == ["4"] * 4 + ["8"] * 16


def test_backends_by_name(spark):
    for name, layout, want in [
        ("openai", "Be brief", ['{"role":"system","content":"Be brief"}', '{"role":"user","content":"hi"}']),
        ("claude_slack", "U7", ["<@U7> hi"]),
        ("fastchat", "orca", None),
    ]:
        lay_out, backend = get_backend(name, layout, lambda: None)
        got = asked(spark, ["hi"]).select(lay_out(F.col("messages"))).first()[0]
        assert want is None or got == want
        assert backend.batch == (name == "fastchat")
    with pytest.raises(ValueError):
        get_backend("nobody", "", lambda: None)
    with pytest.raises(ValueError):
        schedulers.get_scheduler("nobody")
    assert schedulers.get_scheduler("outline") is schedulers.outline


PROMPTS = OutlinePrompts(
    "Outline {request}[ROLESWITCHING assistant:] 1.",
    "{request}/{outline}/{point}[ROLESWITCHING assistant:]{point}. {point_outline}",
)


def test_outline_runs(spark):
    def open_call():
        def call(messages, settings):
            out = []
            for m in messages:
                if m[0].startswith("Outline none"):
                    out.append("")
                elif m[0].startswith("Outline fail"):
                    raise ValueError("outline")
                elif m[0].startswith("Outline"):
                    out.append(" A\n2. B\n1. C")
                elif m[0].startswith("half") and m[0].endswith("/2"):
                    raise ValueError("point")
                else:
                    out.append(" said ")
            return out

        return call

    backend = PythonBackend(open_call, attempts=1)
    questions = spark.createDataFrame(
        [(1, "two"), (2, "none"), (3, "fail"), (4, "half")], "request_id long, request string"
    )
    rows = {r["request_id"]: r for r in schedulers.outline(questions, backend, PROMPTS).collect()}
    assert rows[1]["points"] == ["1", "2"] and rows[1]["point_outlines"] == ["A", "B"]
    assert rows[1]["response"] == "1. A  said \n\n2. B  said "
    assert len(rows[1]["contents_time"]) == 2 and rows[1]["error"] is None
    assert rows[2]["outline"] == " 1." and rows[2]["points"] == [] and rows[2]["response"] == ""
    assert rows[3]["response"] == "" and rows[3]["error"] == "ValueError: outline"
    assert rows[4]["contents"][0] == "1. A  said " and rows[4]["error"] == "ValueError: point"

    batch = {r["request_id"]: r for r in schedulers.batch_outline(questions, backend, PROMPTS).collect()}
    assert batch[1]["response"] == "1. A said\n2. B said" and batch[1]["point_time"] >= 0
    assert batch[2]["response"] == "" and batch[2]["point_time"] is None


def test_model_is_called_once_per_row(spark):
    calls = spark.sparkContext.accumulator(0)

    def open_call():
        def call(messages, settings):
            calls.add(len(messages))
            return ["1. A\n2. B" if m[0].startswith("Outline") else "x" for m in messages]

        return call

    questions = spark.createDataFrame([(i, str(i)) for i in range(10)], "request_id long, request string")
    answered = schedulers.outline(questions, PythonBackend(open_call), PROMPTS)
    for _ in range(2):
        assert answered.count() == 10
    # ten outlines, whose partial answer " 1." makes "1.1. A" one point and "2." another
    assert calls.value == 10 + 20


# ---- resuming and pairing ---------------------------------------------------


def test_resume(spark, tmp_path):
    questions = spark.createDataFrame(
        [(i, f"q{i % 4}") for i in range(10)], "request_id long, request string"
    )
    path = str(tmp_path / "results")

    def run(todo):
        write_results(todo.withColumn("response", F.upper("request")), path)

    run(questions.where("request = 'q1'"))
    rest = skip_done(questions, spark.read.parquet(path))
    # copies of an unfinished question are all answered
    assert rest.count() == 7
    run(materialise(rest))
    assert spark.read.parquet(path).count() == 10
    assert skip_done(questions, spark.read.parquet(path)).count() == 0


def test_a_run_that_breaks_off_goes_on(spark, tmp_path):
    questions = spark.createDataFrame(
        [(i, f"q{i % 7}") for i in range(40)], "request_id long, request string"
    )
    path, slices = str(tmp_path / "answers"), 4
    started = []

    def run(part, break_at=None):
        started.append(part)
        if len(started) == break_at:
            raise KeyboardInterrupt
        return schedulers.naive(part, ExpressionBackend(lambda m: F.upper(F.get(m, F.lit(0)))))

    with pytest.raises(KeyboardInterrupt):
        dump(questions, lambda part: run(part, break_at=3), path, slices=slices)
    before = spark.read.parquet(path).count()
    assert 0 < before < 40
    dump(questions, run, path, slices=slices)
    rows = spark.read.parquet(path).collect()
    assert sorted(r["request_id"] for r in rows) == list(range(40))
    assert all(r["response"] == r["request"].upper() for r in rows)
    dump(questions, run, path, slices=slices)
    assert spark.read.parquet(path).count() == 40
    dump(questions.where("request_id < 5"), run, path, overwrite=True, slices=2)
    assert spark.read.parquet(path).count() == 5


def test_judged_requests_are_left_out(spark):
    tables = [answers(spark, [(1, "p", x), (2, "q", x)]) for x in "ab"]
    judge = ExpressionBackend(lambda m: F.lit("8 9"))
    done = spark.createDataFrame([("p",)], "request string")
    pairs = judge_pair(tables[0], tables[1], judge, "{question}{answer_1}{answer_2}{prompt}", "x", done=done)
    assert [(r["request_id"], r["1_score1"], r["2_score1"]) for r in pairs.collect()] == [(2, 8.0, 9.0)]
    assert {r["request_id"] for r in judge_list(tables, judge, "{num}", done=done).collect()} == {2}
    template = "{question}{answer_1}{answer_2}{prompt}"
    paired = pair_answers(tables[0], tables[1], ["request_id"]).selectExpr(
        "*", "'x' AS prompt", f"'{template}' AS prompt_template", "'any' AS category"
    )
    some = judge_pair_by_category(paired, judge, [template], done=done)
    assert {r["request_id"] for r in some.collect()} == {2}


def answers(spark, rows):
    return spark.createDataFrame(rows, "request_id long, request string, response string")


@pytest.mark.parametrize(
    "other",
    [[(1, "a", "x")], [(1, "a", "x"), (2, "c", "y")], [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]],
)
def test_tables_that_do_not_match(spark, other):
    first, second = answers(spark, [(1, "a", "u"), (2, "b", "v")]), answers(spark, other)
    with pytest.raises(Exception, match="differ in rows or requests"):
        pair_answers(first, second, ["request_id"]).collect()
    with pytest.raises(Exception, match="differ in rows or requests"):
        align_n_answers([first, second]).collect()


def test_a_failed_judge_call(spark):
    tables = [answers(spark, [(1, "q", x)]) for x in "abc"]
    refusing = PythonBackend(lambda: lambda m, s: 1 / 0, attempts=1)
    long = judge_list(tables, refusing, "Order {num_str}.").collect()
    assert len(long) == 6
    assert {tuple(r["order"]) for r in long} == {(-2, -2, -2)}
    assert {r["evaluation"] for r in long} == {"-2,-2"}
    wide = judge_pair(tables[0], tables[1], refusing, "{question}{answer_1}{answer_2}{prompt}", "p").first()
    assert wide["1_score1"] == wide["2_score2"] == -2.0
    assert wide["1_evaluation_request"] == "qabp" and wide["2_evaluation_request"] == "qbap"


def test_unknown_question_or_criterion(spark):
    asked_ = answers(spark, [(1, "q", "a")])
    categories = spark.createDataFrame([("other", "x")], "request string, category string")
    templates = spark.createDataFrame(
        [("general", "p", "t")], "category string, prompt string, prompt_template string"
    )
    with pytest.raises(Exception, match="not in the prompt file"):
        template_lookup(asked_, categories, templates).collect()
    with pytest.raises(ValueError):
        criteria_cross(asked_, {"speed": "?"})


# ---- metrics ----------------------------------------------------------------


def matrix(df):
    return {(r["y_true"], r["y_pred"]): r["value"] for r in df.collect()}


def test_confusion_matrix(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 1), (2, 2)], "y_true int, y_pred int")
    full = matrix(confusion_matrix(df))
    assert full[(0, 1)] == 1.0 and full[(1, 1)] == 0.0 and len(full) == 9
    # class 1 is never true: 0/0 is 0
    assert matrix(confusion_matrix(df, normalize="true"))[(1, 2)] == 0.0
    assert matrix(confusion_matrix(df, labels=[2, 0]))[(2, 0)] == 0.0
    assert len(matrix(confusion_matrix(df, labels=[2, 0]))) == 4
    assert matrix(confusion_matrix(df, labels=[0, 7], normalize="all"))[(0, 0)] == 1.0
    with pytest.raises(Exception, match="no label occurs"):
        confusion_matrix(df, labels=[7]).collect()
    with pytest.raises(ValueError):
        confusion_matrix(df, normalize="rows")


def test_multilabel_lengths(spark):
    df = spark.createDataFrame([([0, 1], [0])], "y_true array<int>, y_pred array<int>")
    with pytest.raises(Exception, match="differ in length"):
        multilabel_pairs(df).collect()


def test_router_loss_by_hand(spark):
    import math

    df = spark.createDataFrame([(0.8, 1), (0.3, 0)], "prob double, label int")
    got = router_loss(df).first()
    ce = -(math.log(0.8) + math.log(0.7)) / 2
    both, p, y = 0.8, 1.1, 0.9
    tversky = both / (both + 0.7 * (p - both) + 0.3 * (y - both))
    assert got["loss"] == pytest.approx(0.25 * ce + 0.75 * (1 - tversky))


def test_mean_pool(spark):
    df = spark.createDataFrame(
        [(1, [3.0, 4.0], 1), (1, [100.0, 0.0], 0), (2, [0.0, 0.0], 1)],
        "id int, embedding array<double>, mask int",
    )
    pooled = {r["id"]: r["embedding"] for r in mean_pool(df, ["id"], mask="mask").collect()}
    assert pooled[1] == pytest.approx([0.6, 0.8]) and pooled[2] == [0.0, 0.0]


def test_token_counter_from_python(spark):
    count = tokenizer_counter(lambda: list)
    df = spark.createDataFrame([("abc",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(count("t")).collect()] == [3, None, 0]


@pytest.mark.parametrize("n,ratio", [(0, 0.8), (1, 0.8), (10, 0.8), (101, 0.8), (50, 0.0), (50, 1.0)])
def test_exact_split(spark, n, ratio):
    df = spark.range(n).withColumnRenamed("id", "request_id")
    split = exact_split(df, ratio, seed=3)
    assert split.where("is_train").count() == int(ratio * n)
    assert split.count() == n


def test_hashed_split_is_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "request_id")
    first = hashed_split(df, 0.8, 5).where("is_train")
    again = hashed_split(df.repartition(7), 0.8, 5).where("is_train")
    assert first.exceptAll(again).count() == 0
    assert 1500 < first.count() < 1700


def test_trained_router_routes(spark, tmp_path):
    rows = [(i, "list the ways" if i % 2 else "solve the sum", i % 2) for i in range(40)]
    labelled = spark.createDataFrame(rows, "request_id long, request string, label int")
    train_router(labelled, features=64, iterations=5).save(spark, str(tmp_path / "router"))
    model = RouterModel.load(spark, str(tmp_path / "router"))
    routed = predict(model, labelled.drop("label"))
    assert matrix(confusion_matrix(routed.join(labelled.withColumnRenamed("label", "y"), "request_id"), "y", "label")) == {
        (0, 0): 20.0,
        (0, 1): 0.0,
        (1, 0): 0.0,
        (1, 1): 20.0,
    }
    upper = ExpressionBackend(lambda m: F.concat(F.lit("1. "), F.upper(F.get(m, F.lit(0)))))
    prompts = OutlinePrompts("{request}", "{point_outline}")
    answered = schedulers.router(routed.drop("prob"), upper, prompts).collect()
    kinds = {r["request_id"] % 2: (r["points"], r["response"]) for r in answered}
    assert kinds[0] == (None, "1. SOLVE THE SUM") and kinds[1] == (["1"], "1. LIST THE WAYS")


def test_gradient_of_the_mixed_loss(spark):
    """The distributed gradient against differences, the loss against ``router_loss``."""
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 5)), (i // 2) % 2) for i in range(60)]
    rows.append((60, None, 1))
    labelled = spark.createDataFrame(rows, "request_id long, request string, label int")
    n = 16
    loss = composite_loss(labelled_features(labelled, n, False).repartition(3), n, 0.75)
    weights = np.random.default_rng(5).normal(size=n + 1)
    value, slope = loss(weights)
    for k in (0, 3, 8):
        step = np.zeros(n + 1)
        step[k] = 1e-6
        ahead, behind = loss(weights + step)[0], loss(weights - step)[0]
        assert slope[k] == pytest.approx((ahead - behind) / 2e-6, abs=1e-5)
    scored = predict(RouterModel(weights), labelled.select("request_id", "request"))
    told = scored.drop("label").join(labelled.select("request_id", "label"), "request_id")
    decay = 1e-3 / 2 * float(weights[1:] @ weights[1:])
    assert value == pytest.approx(router_loss(told).first()["loss"] + decay)


def test_mixed_loss_ends_below_the_logistic_start(spark):
    rows = [(i, f"a{i % 9} b{i % 4} c{i % 5}", int((i * 7) % 10 < 3 + 4 * (i % 2))) for i in range(200)]
    labelled = spark.createDataFrame(rows, "request_id long, request string, label int").cache()
    start = logistic_start(labelled, 64, 4)
    ended = train_router(labelled, 64, 4, start=start)
    loss = composite_loss(labelled_features(labelled, 64, False), 64, 0.75)
    assert loss(ended.weights)[0] < loss(start)[0] < loss(np.zeros(65))[0]
    assert train_router(labelled.limit(0), 64, 4).weights.tolist() == [0.0] * 65


def test_choices(spark):
    texts = ["A", " B. because", "C", "Apples", "", "a", "\nA, B"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(choice_label(F.col("t"))).collect()] == [1, 0, 0, None, None, None, 1]


# ---- snapshots --------------------------------------------------------------


def snapshots(spark, rows):
    return spark.createDataFrame(
        [(1, "outline", 0, i, t, e) for i, (t, e) in enumerate(rows)],
        "request_id long, stage string, point_index int, seq int, text string, error_code int",
    )


def test_deltas_make_up_the_text(spark):
    texts = ["a", "a b", "a b c d", "a b c", "a  b c d e "]
    got = chunk_delta(snapshots(spark, [(t, 0) for t in texts])).orderBy("seq").collect()
    assert [r["delta"] for r in got] == ["", "a ", "b c ", "", "c d "]
    assert [r["flush"] for r in got] == [None] * 4 + ["e"]


def test_flush_of_a_text_that_shrank(spark):
    got = chunk_delta(snapshots(spark, [("a b c d", 0), ("a b", 0)])).orderBy("seq").collect()
    assert [(r["delta"], r["flush"]) for r in got] == [("a b c ", None), ("", "")]


def test_nothing_is_shown_after_an_error(spark):
    rows = [(f" t{i} ", 7 if i in (3, 6) else 0) for i in range(9)]
    got = chunk_sample(snapshots(spark, rows)).orderBy("seq").collect()
    assert [(r["seq"], r["kind"], r["shown"]) for r in got] == [
        (0, "partial", "t0▌"),
        (3, "error", " t3 \n\n(error_code: 7)"),
    ]
    coded = snapshots(spark, [("x\n```a\\_b\n```c\\_d", 0)]).withColumn("model", F.lit("vicuna-7b"))
    ends = chunk_sample(coded, model="model").where("kind = 'final'").first()
    assert ends["shown"] == "x\n```a_b\n```c\\_d"
    good = chunk_sample(snapshots(spark, [(f"t{i}", 0) for i in range(6)])).orderBy("seq", "kind")
    assert [(r["seq"], r["kind"]) for r in good.collect()] == [(0, "partial"), (5, "final"), (5, "partial")]


def test_side_by_side(spark):
    left = snapshots(spark, [("a", 0), ("ab", 0), ("abc", 0)])
    right = snapshots(spark, [("x", 0)])
    got = side_by_side(left, right).orderBy("step").collect()
    assert [(r["left_text"], r["right_text"]) for r in got] == [("a", "x"), ("ab", "x"), ("abc", "x")]
    alone = side_by_side(left, right.where("false")).collect()
    assert {r["right_text"] for r in alone} == {None}


# ---- files ------------------------------------------------------------------


def test_csv_quotes_and_newlines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question\n"say ""hi"", now"\n"two\nlines"\nplain\n', encoding="utf-8")
    got = [r["request"] for r in read_requests_csv(spark, str(tmp_path / "q.csv")).collect()]
    assert got == ['say "hi", now', "two\nlines", "plain"]
    (tmp_path / "r.csv").write_text('label;request\n1;"a ""b""; c"\n0;d\n', encoding="utf-8")
    got = [tuple(r) for r in read_router_csv(spark, str(tmp_path / "r.csv")).collect()]
    assert got == [(1, 'a "b"; c'), (0, "d")]


def test_row_numbers_follow_the_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for f, size in enumerate([3, 50, 1, 20]):
        lines = "".join(f'"f{f} r{r}\nmore"\n' for r in range(size))
        (folder / f"part-{f}.csv").write_text("request\n" + lines, encoding="utf-8")
    got = number_rows(read_requests_csv(spark, str(folder))).orderBy("request_id").collect()
    assert [r["request_id"] for r in got] == list(range(74))
    assert [r["request"].split("\n")[0] for r in got][:5] == ["f0 r0", "f0 r1", "f0 r2", "f1 r0", "f1 r1"]


def test_prompt_files(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"prompt": "P {request}", "outline_prompt": "O", "point_prompt": "Q"}))
    assert naive_template(spark) == naive_template(spark, "none") == "{request}"
    assert naive_template(spark, str(path)) == "P {request}"
    assert outline_templates(spark, str(path)) == OutlinePrompts("O", "Q")
    assert outline_templates(spark, None, "O", "Q") == OutlinePrompts("O", "Q")
    for wrong in [(str(path), "O", None), (None, "O", None), (None, None, None)]:
        with pytest.raises(ValueError):
            outline_templates(spark, *wrong)


def test_templates_are_listed_once(spark, tmp_path):
    asked_, told = tmp_path / "asked.jsonl", tmp_path / "told.jsonl"
    told.write_text(json.dumps({"category": "c", "prompt_template": "t", "defaults": {"prompt": "p"}}) + "\n")
    asked_.write_text(json.dumps({"text": "q", "category": "c"}) + "\n")
    categories, templates = read_judge_templates(spark, str(asked_), str(told))
    assert tuple(templates.first()) == ("c", "p", "t") and categories.count() == 1
    asked_.write_text(2 * (json.dumps({"text": "q", "category": "c"}) + "\n"))
    with pytest.raises(ValueError, match="more than once"):
        read_judge_templates(spark, str(asked_), str(told))


def test_export_and_predictions(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", [1, 2]), (1, 'a "x"\n', [])], "request_id long, t string, o array<int>")
    export_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text(encoding="utf-8")
    assert text == '"o","request_id","t"\n"[1,2]","2","b"\n"[]","1","a ""x""\n"\n'
    labels = spark.range(1000).select(F.col("id").alias("request_id"), (F.col("id") % 2).alias("y_pred"))
    write_predictions(labels.repartition(5), str(tmp_path / "pred"))
    parts = sorted((tmp_path / "pred").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "0\n1\n" * 500


def test_empty_texts_stay_empty(spark, tmp_path):
    write_results(answers(spark, [(1, "q", "")]), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first()["response"] == ""


# ---- session ----------------------------------------------------------------


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")




def test_dump_keeps_all_slices_and_asks_again(spark, tmp_path):
    """Partition columns, several slices, and a model that fails in the first run."""
    path = str(tmp_path / "answers")
    asked_ = spark.range(40).select(
        F.col("id").alias("request_id"), F.concat(F.lit("q"), "id").alias("request")
    )
    calls = spark.sparkContext.accumulator(0)

    def run(works):
        def open_call():
            def call(messages, settings):
                calls.add(1)
                if not works and messages[0][0].endswith("7"):
                    raise RuntimeError("down")
                return [m[0].upper() for m in messages]

            return call

        backend = PythonBackend(open_call, attempts=1)
        return lambda part: schedulers.naive(part, backend).withColumns(
            {"dataset": F.lit("d"), "model": F.lit("m")}
        )

    dump(asked_, run(False), path, overwrite=True, slices=4)
    assert spark.read.parquet(path).count() == 36
    assert spark.read.parquet(path + "-failed").count() == 4
    dump(asked_, run(True), path, slices=4)
    told = spark.read.parquet(path).collect()
    assert sorted(r["request_id"] for r in told) == list(range(40))
    assert all(r["response"] == r["request"].upper() and r["error"] is None for r in told)
    # one call per request, and another for each that failed
    assert calls.value == 44


def test_empty_answers_are_judged_as_empty(spark, tmp_path):
    table = spark.createDataFrame([("q", "")], "request string, response string")
    export_csv(table, str(tmp_path / "csv"))
    read = read_answers_csv(spark, str(tmp_path / "csv"))
    assert read.first()["response"] == ""
    told = spark.range(1).select(
        list_judge_prompt(
            F.lit("q"), F.array(F.lit("a"), F.lit(None).cast("string")), F.lit("i")
        ).alias("p")
    )
    assert "[Assistant 2]\n\n\n[End of Assistant 2]" in told.first()["p"]


def test_masked_texts_and_impossible_labels(spark):
    vectors = spark.createDataFrame(
        [(1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0), (2, [1.0, 1.0], 0)],
        "id long, embedding array<double>, mask int",
    )
    told = {r["id"]: r["embedding"] for r in mean_pool(vectors, ["id"], mask="mask").collect()}
    assert [round(x, 9) for x in told[1]] == [0.6, 0.8] and told[2] == [0.0, 0.0]
    sure = spark.createDataFrame([(0.0, 1), (0.5, 1)], "prob double, label int")
    assert router_loss(sure).first()["loss_ce"] == float("inf")


def test_a_broken_run_repeats_one_batch_of_calls(spark, tmp_path):
    """The log has the answers of every batch finished before the model died."""
    log, calls = f"file://{tmp_path}/log", tmp_path / "calls"
    calls.mkdir()
    asked = spark.createDataFrame(
        [(i, [f"q{i % 5}"]) for i in range(40)], "request_id long, messages array<string>"
    )

    def model(dies_after):
        def open_call():
            made = 0

            def call(messages, settings):
                nonlocal made
                if made == dies_after:
                    raise SystemExit("the worker is gone")
                made += 1
                (calls / f"{uuid.uuid4().hex}").write_text(str(len(messages)))
                return [Answer(m[0].upper(), 3, 1, "stop") for m in messages]

            return call

        return PythonBackend(open_call, batch=True, batch_rows=4, rows_per_task=40, log=log)

    with pytest.raises(Exception, match="gone|Python worker"):
        generate(asked, model(6), ["request_id"]).collect()
    assert len(list(calls.iterdir())) == 6
    rows = generate(asked, model(-1), ["request_id"]).collect()
    assert len(list(calls.iterdir())) == 10
    assert {r["request_id"]: r["text"] for r in rows} == {i: f"Q{i % 5}" for i in range(40)}
    assert {(r["usage"]["prompt_tokens"], r["finish_reason"]) for r in rows} == {(3, "stop")}


def test_failed_calls_are_not_in_the_log(spark, tmp_path):
    asked = spark.createDataFrame([(1, ["q"])], "request_id long, messages array<string>")
    log = f"file://{tmp_path}/log"
    failing = PythonBackend(lambda: lambda m, s: 1 / 0, attempts=1, log=log)
    assert generate(asked, failing, ["request_id"]).first()["error"] is not None
    working = PythonBackend(lambda: lambda m, s: ["a"] * len(m), log=log)
    assert generate(asked, working, ["request_id"]).first()["text"] == "a"


def test_tasks_grow_with_the_rows(spark):
    backend = PythonBackend(lambda: lambda m, s: ["a"] * len(m), rows_per_task=10)
    asked = spark.range(95).select(
        F.col("id").alias("request_id"), F.array(F.lit("q")).alias("messages")
    )
    assert generate(asked, backend, ["request_id"]).rdd.getNumPartitions() == 10


def test_finished_requests_by_digest(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "request_id long, request string")
    done = spark.createDataFrame([("a",), (None,), ("a",)], "request string")
    assert sorted(r[0] for r in skip_done(df, done).collect()) == [2, 3]
    lists = df.select("request_id", F.array("request").alias("request"))
    assert sorted(r[0] for r in skip_done(lists, lists.where("request_id = 2")).collect()) == [1, 3, 4]
    plan = skip_done(df, done)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_digest" in plan and "hashpartitioning(request" not in plan


def test_grid_goes_on_where_it_broke_off(spark, tmp_path):
    rows = [(i, f"q{i}", "d/1" if i % 2 else "d2") for i in range(6)]
    asked = spark.createDataFrame(rows, "request_id long, request string, dataset string")
    upper = ExpressionBackend(lambda m: F.upper(F.get(m, F.lit(0))))
    runs = []

    def way(name, dies=False):
        def schedule(part, model):
            runs.append(name)
            if dies:
                raise InterruptedError
            return schedulers.naive(part, model)

        return schedule

    path = str(tmp_path / "grid")
    with pytest.raises(InterruptedError):
        run_grid(asked, ["d/1", "d2"], {"m": upper}, {"a": way("a"), "b": way("b", True)}, path)
    assert runs == ["a", "b"]
    run_grid(asked, ["d/1", "d2"], {"m": upper}, {"a": way("a"), "b": way("b")}, path)
    assert runs == ["a", "b", "b", "a", "b"]
    run_grid(asked, ["d/1", "d2"], {"m": upper}, {"a": way("a"), "b": way("b")}, path)
    assert len(runs) == 5
    told = grid_answers(spark, path).groupBy("dataset", "scheduler").count().collect()
    assert sorted(map(tuple, told)) == [("d/1", "a", 3), ("d/1", "b", 3), ("d2", "a", 3), ("d2", "b", 3)]


def test_prompts_are_made_where_the_call_is(spark):
    backend = PythonBackend(lambda: lambda m, s: ["a"] * len(m))
    asked = spark.createDataFrame([(1, "question")], "request_id long, request string")
    answered = generate(
        asked, backend, ["request_id"], render=F.array(F.concat(F.lit("a long prompt: "), "request"))
    )
    plan = answered._jdf.queryExecution().executedPlan().toString()
    assert plan.index("a long prompt") < plan.index("Exchange hashpartitioning")
    assert answered.first()["text"] == "a"


def test_a_question_with_two_categories_fails(spark):
    questions = spark.createDataFrame([(1, "q"), (2, "r")], "request_id long, request string")
    templates = spark.createDataFrame(
        [("general", "p", "t"), ("x", "p2", "t2")], "category string, prompt string, prompt_template string"
    )
    twice = spark.createDataFrame([("q", "x"), ("q", "x"), ("r", "other")], "request string, category string")
    told = template_lookup(questions, twice, templates).collect()
    assert sorted((r["request_id"], r["prompt"]) for r in told) == [(1, "p2"), (2, "p")]
    two = twice.union(spark.createDataFrame([("q", "general")], twice.schema))
    with pytest.raises(Exception, match="two categories for: q"):
        template_lookup(questions, two, templates).collect()


@pytest.mark.parametrize("requests", [1, 400])
def test_an_outline_travels_a_bounded_number_of_times(spark, monkeypatch, requests):
    """Not once per point: what is dealt are at most eight pieces of an outline, or in a
    small table a few pieces per task."""
    points = 300

    def open_call():
        def call(messages, settings):
            outline = " p1\n" + "\n".join(f"{i}. p{i}" for i in range(2, points + 1))
            return [outline if m[0].startswith("Outline") else " " + m[-1] for m in messages]

        return call

    dealt = []

    def spied(df, *args, **kwargs):
        dealt.append(df.count())
        return generate(df, *args, **kwargs)

    monkeypatch.setattr(schedulers, "generate", spied)
    questions = spark.range(requests).selectExpr("id AS request_id", "'q' AS request")
    backend = PythonBackend(open_call, batch=True)
    rows = schedulers.batch_outline(questions, backend, PROMPTS).collect()
    assert len(rows) == requests and dealt[0] == requests
    assert dealt[1] == (16 if requests == 1 else 2 * requests)
    want = [f"{i}. p{i} {i}. p{i}" for i in range(1, points + 1)]
    assert all(r["response"].split("\n") == want for r in rows)


def test_answers_of_an_expression_are_written_once(spark, tmp_path, monkeypatch):
    """Their error is null by construction; a model's answers are written before they are split."""
    written = []
    monkeypatch.setattr(
        "promptloom.plans.dump.materialise", lambda df, label: written.append(label) or materialise(df)
    )
    questions = spark.createDataFrame([(1, "q"), (2, "r")], "request_id long, request string")
    upper = ExpressionBackend(lambda m: F.upper(F.get(m, F.lit(0))))
    for name in ("naive", "outline", "batch_outline"):
        path = str(tmp_path / name)
        way = schedulers.get_scheduler(name)
        more = [] if name == "naive" else [PROMPTS]
        dump(questions, lambda part: way(part, upper, *more), path)
        assert written == [] and spark.read.parquet(path).count() == 2
        assert spark.read.parquet(path + "-failed").count() == 0
    python = PythonBackend(lambda: lambda m, s: [x[0] for x in m])
    dump(questions, lambda part: schedulers.naive(part, python), str(tmp_path / "python"))
    assert written == ["answered"]


def test_the_requests_of_a_grid_are_worked_out_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    rows = [(i, f"q{i}", "d1" if i % 2 else "d2") for i in range(6)]
    asked = spark.createDataFrame(rows, "request_id long, request string, dataset string")
    asked = asked.withColumn("request", counted("request"))
    upper = ExpressionBackend(lambda m: F.upper(F.get(m, F.lit(0))))
    ways = {"a": schedulers.naive, "b": schedulers.naive}
    path = str(tmp_path / "grid")
    run_grid(asked, ["d1", "d2"], {"m": upper}, ways, path, slices=2)
    assert grid_answers(spark, path).count() == 12 and made.value == 6


def test_snapshots_are_made_by_tasks_of_bounded_text(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(200))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(fixtures, "CHUNK_TASK_BYTES", 10_000)
    made = fixtures.chunks(spark, str(tmp_path))
    size = sum(len(text) for _, text in rows)
    assert made.rdd.getNumPartitions() == -(-size // 10_000) > 10
    final = chunk_final(made.select("request_id", "seq", "text"))
    plan = final._jdf.queryExecution().executedPlan().toString()
    # the snapshots themselves are not shuffled
    assert plan.count("Exchange") == 1
    assert sorted((r["request_id"], r["text"]) for r in final.collect()) == rows


def test_answer_tables_are_written_compressed(spark, sf_dir, monkeypatch):
    paths = []
    monkeypatch.setattr(
        sources, "scratch_path", lambda s, label: paths.append(scratch_path(s, label)) or paths[-1]
    )
    told = sources.q_read_answers(spark, sf_dir)
    assert told.count() == 3 * spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(".zstd." in f for f in told.inputFiles()) and len(paths) == 3
